"""Outliers of tables: scores and 0/1 flags."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import column_quantiles, lookup_join, quantile_values, quantiles, running
from plumbline.functions.settings import cut_lineage, use_all_cores
from plumbline.operators import neighbors


def quartile_outliers(df: DataFrame, columns: Sequence[str], coefficient: float = 1.6) -> DataFrame:
    """A 0/1 flag per column (``name_outlier``) outside the quartile fences."""
    fences = column_quantiles(df, columns, [0.25, 0.75])

    def flag(c: str):
        low, high = fences[c]
        if low is None:
            return F.lit(0).alias(f"{c}_outlier")
        reach = (high - low) * coefficient
        return F.coalesce(((F.col(c) < low - reach) | (F.col(c) > high + reach)).cast("int"), F.lit(0)).alias(f"{c}_outlier")
    return df.select("*", *[flag(c) for c in columns])


def sigma_outliers(df: DataFrame, columns: Sequence[str], sigmas: float = 3) -> DataFrame:
    """``name_outlier``: lower, upper or null, by limits rounded to three decimals."""
    row = df.agg(*[f.alias(f"{c}_{n}") for c in columns for n, f in (
        ("lo", F.round(F.avg(c) - F.stddev_samp(c) * sigmas, 3)), ("hi", F.round(F.avg(c) + F.stddev_samp(c) * sigmas, 3)))]).first()
    return df.select("*", *[F.when(F.col(c) < F.lit(row[f"{c}_lo"]), "lower").when(F.col(c) > F.lit(row[f"{c}_hi"]), "upper")
                            .alias(f"{c}_outlier") for c in columns])


def label_top(df: DataFrame, score: str = "score", contamination: float = 0.03, keys: Sequence[str] = ()) -> DataFrame:
    """1 for scores above the (1 - contamination) quantile, of each key.  Scores are materialized, as they are read twice."""
    df = cut_lineage(df)
    if keys:
        limits = quantiles(df, list(keys), score, [1 - contamination]).select(*keys, F.col("q")[0].alias("_limit"))
        flagged = lookup_join(df, limits, list(keys))
        return flagged.withColumn("outlier", F.coalesce((F.col(score) > F.col("_limit")).cast("int"), F.lit(0))).drop("_limit")
    limit = quantile_values(df, score, [1 - contamination])[0]
    return df.withColumn("outlier", F.coalesce((F.col(score) > F.lit(limit)).cast("int"), F.lit(0)))


def density_outliers(df: DataFrame, columns: Sequence[str], eps: float = 0.5, least: int = 5, keys: Sequence[str] = (),
                     metric: str = "euclidean") -> DataFrame:
    return neighbors.attach(df, columns, neighbors.density_noise(df, columns, eps, least, keys, metric), keys)


def neighbour_outliers(df, columns, k: int = 5, contamination: float = 0.03, metric: str = "euclidean") -> DataFrame:
    return label_top(neighbors.attach(df, columns, neighbors.neighbour_scores(df, columns, k, metric)), contamination=contamination)


def local_outliers(df, columns, k: int = 10, contamination: float = 0.03, metric: str = "euclidean", order: str | None = None) -> DataFrame:
    return label_top(neighbors.attach(df, columns, neighbors.local_outlier_factor(df, columns, k, metric, order)), contamination=contamination)


def chain_outliers(df, columns, k: int = 15, contamination: float = 0.03, keys: Sequence[str] = ()) -> DataFrame:
    return label_top(neighbors.attach(df, columns, neighbors.chaining_factor(df, columns, k, keys), keys), contamination=contamination, keys=keys)


# --- isolation forest --------------------------------------------------------------------------------

def average_path(n):
    """Expected search depth in a random tree over n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(all="ignore"):
        c = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def grow_forest(df: DataFrame, ident: Sequence[str], columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 0) -> pd.DataFrame:
    """Node table of random isolation trees; every tree is grown in its own task from a bounded hash sample."""
    rows = neighbors.complete(df, columns)
    total = rows.count()
    share = min(1.0, 1.5 * sample / max(total, 1) + 4 * math.sqrt(sample) / max(total, 1))
    scale = 1 << 40
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *ident), F.lit(scale))
    slot = int(share * scale)
    if share * trees <= 1:      # large tables: one draw decides the tree, if any, that takes the row
        chosen = F.floor(draw(F.lit(-1)) / F.lit(slot)).cast("int")
        taken = rows.withColumn("tree", chosen).where(F.col("tree") < trees)
    else:
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(slot))
        taken = rows.withColumn("tree", F.explode(chosen))
    picked = taken.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *ident, "tree")
    picked = picked.withColumn("draw", draw(F.col("tree"))).select("tree", "draw", *[f"x{i}" for i in range(len(columns))])
    width = len(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["draw", *[f"x{i}" for i in range(width)]]).head(sample)[[f"x{i}" for i in range(width)]].to_numpy()
        random = np.random.default_rng([seed, tree])
        limit, nodes, work = max(1, math.ceil(math.log2(max(len(x), 2)))), [], [(np.arange(len(x)), 0, -1, 0)]
        while work:
            at, depth, parent, side = work.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            low, high = x[at].min(0), x[at].max(0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(at) <= 1 or not len(wide):
                nodes.append([tree, -1, 0.0, -1, -1, depth + float(average_path(len(at)))])
                continue
            c = int(random.choice(wide))
            cut = float(random.uniform(low[c], high[c]))
            nodes.append([tree, c, cut, -1, -1, 0.0])
            left = x[at, c] < cut
            work += [(at[left], depth + 1, me, 0), (at[~left], depth + 1, me, 1)]
        return pd.DataFrame(nodes, columns=["tree", "column", "cut", "left", "right", "depth"]).assign(node=range(len(nodes)), size=len(x))
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)      # few bytes but much work: keep tasks apart
    grown = picked.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, "tree int, column int, cut double, left int, right int, depth double, node int, size int")
    return grown.orderBy("tree", "node").toPandas()      # at most trees * 2 * sample rows


def forest_scores(df: DataFrame, columns: Sequence[str], forest: pd.DataFrame) -> DataFrame:
    """Anomaly score 2^(-mean depth / expected depth) of every row."""
    parts = []
    for _, g in forest.groupby("tree"):
        me, leaf = np.arange(len(g)), (g["column"] < 0).to_numpy()
        sides = np.column_stack([g["right"], g["left"]])           # indexed by "value < cut"; a leaf leads to itself
        parts.append((np.where(leaf, 0, g["column"]), np.where(leaf, np.inf, g["cut"]),
                      np.where(leaf[:, None], me[:, None], sides).ravel(), g["depth"].to_numpy()))
    levels = max(1, math.ceil(math.log2(max(int(forest["size"].max()), 2)))) if len(forest) else 0
    expected = float(np.mean(average_path(forest.groupby("tree")["size"].first()))) if len(forest) else 1.0
    shared = df.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in xs])
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for column, cut, sides, depth in shared.value:
            at = np.zeros(len(x), dtype=int)
            for _ in range(levels):
                at = sides[2 * at + (flat[start + column[at]] < cut[at])]
            total += depth[at]
        return pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / (expected or 1.0)))
    return use_all_cores(df).withColumn("score", score(*[F.col(c).cast("double") for c in columns]))


def isolation_outliers(df: DataFrame, ident: Sequence[str], columns: Sequence[str], trees: int = 100, sample: int = 256,
                       contamination: float = 0.03, seed: int = 0) -> DataFrame:
    forest = grow_forest(df, ident, columns, trees, sample, seed)
    return label_top(forest_scores(neighbors.complete(df, columns), columns, forest), contamination=contamination)


def suspect_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The column with the largest robust z (|x - median| / IQR) of each row: a plain attribution of an outlier."""
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    parts = [F.struct((-F.coalesce(F.abs((F.col(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0)), F.lit(0.0))).alias("z"), F.lit(c).alias("name"))
             for c in columns if q[c][0] is not None]
    return df.withColumn("suspect", F.array_min(F.array(*parts))["name"])


# --- self-organizing map -----------------------------------------------------------------------------

def map_outliers(df: DataFrame, columns: Sequence[str], grid: int = 15, sigma: float = 3, epochs: int = 10,
                 contamination: float = 0.03, seed: int = 0) -> DataFrame:
    """Quantization error on a batch-trained grid of units with a triangular neighbourhood.

    An epoch is one aggregate: tasks assign their rows and add up per unit; only unit sums reach the driver.
    """
    rows = neighbors.complete(df, columns)
    stat = rows.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    centre, spread = np.array(stat[0::2]), np.array([v or 1.0 for v in stat[1::2]])
    random = np.random.default_rng(seed)
    units = centre + spread * random.uniform(-1.5, 1.5, (grid * grid, len(columns)))
    place = np.array([(i // grid, i % grid) for i in range(grid * grid)], dtype=float)
    width = len(columns)
    values = use_all_cores(rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))

    def assign(codes):
        def run(batches):
            for pdf in batches:
                x = pdf.to_numpy()
                unit = ((x[:, None, :] - codes.value[None]) ** 2).sum(2).argmin(1)
                sums = pd.DataFrame(x, columns=[f"x{i}" for i in range(width)]).assign(unit=unit, n=1.0)
                yield sums.groupby("unit", as_index=False).sum()[["unit", "n", *[f"x{i}" for i in range(width)]]]
        return run
    schema = "unit long, n double, " + ", ".join(f"x{i} double" for i in range(width))
    for epoch in range(epochs):
        codes = df.sparkSession.sparkContext.broadcast(units)
        sums = values.mapInPandas(assign(codes), schema).groupBy("unit").agg(*[F.sum(c).alias(c) for c in ["n", *[f"x{i}" for i in range(width)]]])
        got = sums.orderBy("unit").toPandas()
        radius = max(sigma * (1 - epoch / epochs), 0.5) + 1
        reach = np.maximum(1 - np.abs(place[:, None] - place[got["unit"].to_numpy()][None]) / radius, 0).prod(2)
        weight = (reach * got["n"].to_numpy()).sum(1)
        moved = reach @ got[[f"x{i}" for i in range(width)]].to_numpy()
        units = np.where(weight[:, None] > 1e-12, moved / np.maximum(weight, 1e-12)[:, None], units)
    codes = df.sparkSession.sparkContext.broadcast(units)

    @F.pandas_udf("double")
    def error(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in xs])
        return pd.Series(np.sqrt(((x[:, None, :] - codes.value[None]) ** 2).sum(2).min(1)))
    return label_top(rows.withColumn("score", error(*[F.col(c).cast("double") for c in columns])), contamination=contamination)


# --- tail probabilities and ellipses --------------------------------------------------------------------

def tail_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Empirical tail score, within each key: larger of the summed left, right and skew-chosen -ln tail probabilities."""
    keys = list(keys)
    skews = [F.coalesce(F.skewness(c), F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate(columns)]
    if keys:
        out = lookup_join(df, df.groupBy(*keys).agg(*skews), keys)
    else:
        out = df.withColumns({n: F.lit(v) for n, v in df.agg(*skews).first().asDict().items()})
    for i, c in enumerate(columns):
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        ranked = running(counts, keys, c, {"_upto": F.col("_n")}, {"_size": F.col("_n")})
        left = -F.ln(F.col("_upto") / F.col("_size"))
        right = -F.ln((F.col("_size") - F.col("_upto") + F.col("_n")) / F.col("_size"))
        out = lookup_join(out, ranked.select(*keys, c, left.alias(f"_l{i}"), right.alias(f"_r{i}")), [*keys, c])
    total = lambda parts: reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    lefts, rights = [[F.col(f"_{side}{i}") for i in range(len(columns))] for side in "lr"]
    chosen = [F.when(F.col(f"_s{i}") < 0, a).otherwise(b) for i, (a, b) in enumerate(zip(lefts, rights))]
    return out.withColumn("score", F.greatest(total(lefts), total(rights), total(chosen))) \
        .drop(*[f"_{x}{i}" for x in "slr" for i in range(len(columns))])


def tail_outliers(df: DataFrame, columns: Sequence[str], contamination: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    return label_top(tail_scores(df, columns, keys), contamination=contamination, keys=keys)


def ellipse_outliers(df: DataFrame, x: str, y: str, share: float = 0.975) -> DataFrame:
    """Mahalanobis distance of two columns and whether it leaves the chi-square ellipse holding ``share``."""
    row = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"),
                 F.covar_samp(x, y).alias("xy")).first()
    det = row["xx"] * row["yy"] - row["xy"] ** 2
    dx, dy = F.col(x) - row["mx"], F.col(y) - row["my"]
    square = (dx * dx * row["yy"] - 2 * dx * dy * row["xy"] + dy * dy * row["xx"]) / det
    limit = -2 * math.log(1 - share)
    return df.withColumn("distance", F.sqrt(square)).withColumn("outlier", (square > limit).cast("int"))


def ellipse(df: DataFrame, x: str, y: str, share: float = 0.975, points: int = 100) -> DataFrame:
    """Points of that ellipse, from the covariance aggregate."""
    row = df.agg(F.avg(x), F.avg(y), F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)).first()
    mx, my, xx, yy, xy = row
    middle, gap = (xx + yy) / 2, math.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    limit, angle = -2 * math.log(1 - share), math.atan2(2 * xy, xx - yy) / 2
    major, minor = math.sqrt(limit * (middle + gap)), math.sqrt(limit * max(middle - gap, 0.0))
    t = F.col("id") * (2 * math.pi / (points - 1))
    a, b = F.cos(t) * major, F.sin(t) * minor
    return df.sparkSession.range(points).select(
        F.col("id").cast("int").alias("point"), (F.lit(mx) + a * math.cos(angle) - b * math.sin(angle)).alias("x"),
        (F.lit(my) + a * math.sin(angle) + b * math.cos(angle)).alias("y"))
