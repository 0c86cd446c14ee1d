"""Additive fits of factors with any number of levels: sums of squares without a matrix of levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.functions.ordered import lookup_join
from plumbline.functions.settings import cut_lineage
from plumbline.operators.neighbors import components

SMALL = 1e-20       # squared residual of the normal equations, against that of no fit, at which a fit is done
MOST_ROUNDS = 1000


def level_tables(rows: DataFrame, y: Column, factors: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, cells) of ``rows`` without null factors.

    ``cells``: one row per combination of levels that occurs, v0, v1, ..., with its rows n and the sum s of ``y``.
    ``levels``: for each factor one row per level v with its n and s.  Rows are shuffled once; the rest comes from cells.
    """
    whole = {f.name for f in rows.schema if isinstance(f.dataType, IntegralType)}    # other levels go by their text
    named = [(F.col(c) if c in whole else F.col(c).cast("string")).alias(f"v{i}") for i, c in enumerate(factors)]
    cells = cut_lineage(rows.select(*named, y.alias("y")).groupBy(*[f"v{i}" for i in range(len(named))]).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")))
    return [cut_lineage(cells.groupBy(F.col(f"v{i}").alias("v")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))) for i in range(len(named))], cells


def explained(levels: list[DataFrame], cells: DataFrame, sizes: Sequence[int]) -> float:
    """Sum of squares of the centred ``y`` that the first ``len(sizes)`` factors, with so many levels, explain together.

    The effects of the factor with most levels are means of what the others leave, so they are put into the normal
    equations of the others, which are solved by conjugate gradients, scaled by the rows of a level.  The state is a row
    per level of the other factors; a round joins the cells with the direction of each of their levels (broadcast where
    these are few, salted beyond), takes off the means over the largest factor and sums back per level.  Two numbers per
    round reach the driver.  The equations are singular (factors share the mean) but consistent, which leaves the fit
    itself unique.  Lineage is cut in every round.
    """
    large = max(range(len(sizes)), key=lambda i: sizes[i])
    rest = [i for i in range(len(sizes)) if i != large]
    squares = levels[large].agg(F.sum(F.col("s") * F.col("s") / F.col("n"))).first()[0] or 0.0
    if not rest:
        return squares
    names = [f"v{i}" for i in range(len(sizes))]
    if len(sizes) < len(levels):
        cells = cut_lineage(cells.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))

    def back(held: DataFrame, value: str) -> DataFrame:
        """Per level of the other factors the sum of ``value`` less its mean over the rows of the largest factor's level."""
        means = held.groupBy(f"v{large}").agg((F.sum(value) / F.sum("n")).alias("__mean"))
        left = held.join(means, f"v{large}")
        return left.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").cast("string").alias("v"), (F.col(value) - F.col("n") * F.col("__mean")).alias("q")) for i in rest]))) \
            .groupBy("f", "v").agg(F.sum("q").alias("q"))

    own = reduce(DataFrame.unionByName, [levels[i].select(F.lit(i).alias("f"), F.col("v").cast("string").alias("v"), "n", "s") for i in rest])
    state = cut_lineage(own.join(back(cells, "s"), ["f", "v"]).select("f", "v", "n", F.col("q").alias("b"), F.lit(0.0).alias("x"), F.col("q").alias("r"), (F.col("q") / F.col("n")).alias("p")))
    scaled = F.sum(F.col("r") * F.col("r") / F.col("n"))
    first = squares + (own.agg(F.sum(F.col("s") * F.col("s") / F.col("n"))).first()[0] or 0.0)
    size = state.agg(scaled).first()[0] or 0.0
    for _ in range(MOST_ROUNDS):
        if size <= first * SMALL:
            return squares + (state.agg(F.sum(F.col("b") * F.col("x"))).first()[0] or 0.0)
        held = cells
        for i in rest:
            held = lookup_join(held, state.where(F.col("f") == i).select(F.col("v").cast(cells.schema[f"v{i}"].dataType).alias(f"v{i}"), F.col("p").alias(f"p{i}")), [f"v{i}"])
        held = held.withColumn("fit", reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in rest]) * F.col("n"))
        state = cut_lineage(state.join(back(held, "fit"), ["f", "v"]))
        step = size / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = state.select("f", "v", "n", "b", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        size, before = state.agg(scaled).first()[0], size
        state = state.withColumn("p", F.col("r") / F.col("n") + size / before * F.col("p"))
    raise ValueError(f"the level effects of {len(sizes)} factors did not settle in {MOST_ROUNDS} rounds")


def shared_dimensions(cells: DataFrame, a: int, b: int, sizes: Sequence[int]) -> int:
    """Dimensions that the levels of factors ``a`` and ``b`` have in common: the connected parts of the graph of levels that meet.

    Levels of the larger factor only tie those of the smaller one together: each of these is linked with the smallest
    that meets the same level, which leaves the parts as they are and as many nodes as the smaller factor has levels.
    """
    large, small = (a, b) if sizes[a] >= sizes[b] else (b, a)
    met = cells.select(F.col(f"v{large}").alias("at"), F.col(f"v{small}").alias("b")).distinct()
    edges = cut_lineage(met.join(met.groupBy("at").agg(F.min("b").alias("a")), "at").select("a", "b").distinct())
    return components(edges, edges.select(F.col("b").alias("a")).distinct()).select("label").distinct().count()


def sequential_sums(rows: DataFrame, y: Column, factors: Sequence[str]) -> list[tuple[str, int, float]]:
    """(factor, degrees of freedom, sum of squares), each factor after those before it; ``y`` is centred.

    Degrees of freedom are exact for two factors, and for a further one that shares no more with the earlier ones
    together than with one of them (crossed or nested factors); else they are an upper bound.
    """
    levels, cells = level_tables(rows, y, factors)
    sizes = [one.count() for one in levels]
    found, before = [], 0.0
    for i, c in enumerate(factors):
        shared = max([shared_dimensions(cells, j, i, sizes) for j in range(i)], default=1)
        after = explained(levels, cells, sizes[:i + 1])
        found.append((c, sizes[i] - shared, after - before))
        before = after
    return found
