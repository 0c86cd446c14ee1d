"""Exact nearest neighbours and density clusters without forming all pairs.

Equal points are merged into one weighted point first, so any number of copies costs nothing more.  Neighbours
meet by metric partitioning; those of many keys, and density clusters, through equi joins on grid cells, whose side
adapts so that each point meets a bounded number of others (in up to three dimensions).  Results never depend on either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import lookup_join, null_safe_join, running, salted_join
from plumbline.functions.settings import cut_lineage
from plumbline.operators import metric_space

GRID_DIMENSIONS = 3      # of points with keys that meet in grid cells; others meet by metric partitioning
GRID_METRICS = ("euclidean", "cityblock", "manhattan", "chebyshev")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two equally long double arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    match metric:
        case "euclidean":
            return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))
        case "cityblock" | "manhattan":
            return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
        case "chebyshev":
            return F.array_max(gaps)
        case _:
            raise ValueError(f"unknown metric {metric!r}")


def vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def weighted_points(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct vectors ``p`` with their number of rows ``n``."""
    rows = complete(df, columns).select(*keys, vector(columns).alias("p"))
    return rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))


def attach(df: DataFrame, columns: Sequence[str], points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bring per-point results back to all rows; rows with a missing coordinate get nulls."""
    keyed = df.withColumn("p", F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), vector(columns)))
    return lookup_join(keyed, points, [*keys, "p"]).drop("p")


# --- nearest neighbours -----------------------------------------------------------------------------

def nearest(points: DataFrame, k: int, metric: str = "euclidean", keys: Sequence[str] = ()) -> DataFrame:
    """For each weighted point the other points covering its k nearest rows: ``near`` = sorted [(d, q, m)].

    Without ``keys`` points meet as in ``metric_space.nearest``, which also says what a column ``ids`` does.  With ``keys``
    only points of the same key meet; the key joins like one more cell coordinate.

    A round joins unfinished points with the cells around them.  A point is finished when k rows lie within
    one cell side, because everything that near was met.  The side then doubles for the rest, each of which
    has fewer than k rows in its surroundings, so no round meets many pairs.
    """
    keys, points = list(keys), cut_lineage(points)
    total = points.count()
    if total == 0:
        return points.withColumn("near", F.array().cast("array<struct<d:double,q:array<double>,m:bigint>>"))
    width = len(points.first()["p"])
    if not keys or width > GRID_DIMENSIONS or metric not in GRID_METRICS:
        return metric_space.nearest(points, k, metric, keys)
    ends = points.agg(*[f(F.col("p")[i]) for i in range(width) for f in (F.min, F.max)]).first()
    spreads = [ends[2 * i + 1] - ends[2 * i] for i in range(width)]
    axes = sorted(range(width), key=lambda i: -spreads[i])[:GRID_DIMENSIONS]
    widest = max(spreads[axes[0]], 1e-300)
    cell = lambda side: [F.floor(F.col("p")[i] / F.lit(side)).cast("long") for i in axes]
    side, crowd = widest / max(1.0, (total / (2 * k + 2)) ** (1 / len(axes))), 8 * k + 32
    for _ in range(60):
        fullest = points.groupBy(*keys, *[c.alias(f"c{i}") for i, c in enumerate(cell(side))]).count().agg(F.max("count")).first()[0]
        if fullest <= crowd:
            break
        side /= 2
    names = [f"c{i}" for i in range(len(axes))]
    todo, done = points, []
    while True:
        around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        meet = todo.select(*keys, F.col("p").alias("s"), F.col("n").alias("own"), *[c.alias(n) for n, c in zip(names, cell(side))])
        for n in names:
            meet = meet.withColumn("_o", around).withColumn(n, (F.col(n) + F.col("_o")).cast("long")).drop("_o")
        here = points.select(*keys, F.col("p"), F.col("n"), *[c.alias(n) for n, c in zip(names, cell(side))])
        pairs = salted_join(here, meet, [*keys, *names]).where(F.col("p") != F.col("s"))
        pairs = pairs.select(*keys, "s", "own", distance(F.col("p"), F.col("s"), metric).alias("d"), "p", "n")
        best = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "s").orderBy("d", "p"))).where(F.col("r") <= k)
        lists = best.groupBy(*keys, "s", "own").agg(F.array_sort(F.collect_list(F.struct("d", F.col("p").alias("q"), F.col("n").alias("m")))).alias("near"))
        inside = F.aggregate("near", F.col("own") - 1, lambda a, x: a + F.when(x["d"] <= side, x["m"]).otherwise(F.lit(0)))
        last = side > 2 * widest
        found = lists.where(F.lit(last) | (inside >= k)).select(*keys, F.col("s").alias("p"), F.col("own").alias("n"), "near")
        found = cut_lineage(found)
        done.append(found)
        if last:
            break
        rest = cut_lineage(todo.join(found.select(*keys, "p"), [*keys, "p"], "left_anti"))
        if rest.isEmpty():
            break
        todo, side = rest, side * 2
    return reduce(DataFrame.unionByName, done)


def _weights(k: int) -> Column:
    """Rows of each neighbour that count among the k nearest, after the point's own copies."""
    own = F.least(F.col("n") - 1, F.lit(k))
    start = F.struct((F.lit(k) - own).cast("long").alias("left"), F.array().cast("array<bigint>").alias("w"))

    def step(acc, x):
        take = F.least(acc["left"], x["m"])
        return F.struct((acc["left"] - take).alias("left"), F.concat(acc["w"], F.array(take)).alias("w"))
    return F.aggregate("near", start, step, lambda acc: acc["w"])


def neighbour_scores(df: DataFrame, columns: Sequence[str], k: int = 5, metric: str = "euclidean") -> DataFrame:
    """Mean distance to the k nearest other rows, per distinct point ``p``."""
    near = nearest(weighted_points(df, columns), k, metric).withColumn("w", _weights(k))
    total = F.aggregate(F.arrays_zip("near", "w"), F.lit(0.0), lambda a, x: a + x["near"]["d"] * x["w"])
    counted = F.least(F.col("n") - 1, F.lit(k)) + F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return near.select("p", F.try_divide(total, counted).alias("score"))


def _first_names(df: DataFrame, columns: Sequence[str], order: str, k: int) -> DataFrame:
    """Weighted points with ``ids``, the sorted k smallest values of ``order`` of their rows."""
    rows = complete(df, columns).select(vector(columns).alias("p"), F.col(order).alias("_i"))
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy("_i"))).where(F.col("_r") <= k)
    return weighted_points(df, columns).join(few.groupBy("p").agg(F.array_sort(F.collect_list("_i")).alias("ids")), "p")


def _weights_by_name(k: int) -> Column:
    """As ``_weights``, where equally far rows of several points go by their names."""
    rows = F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("i"), x["q"].alias("q"))))
    taken = F.slice(F.array_sort(F.flatten(rows)), 1, F.lit(k) - F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    return F.transform("near", lambda x: F.size(F.filter(taken, lambda y: y["q"] == x["q"])).cast("long"))


def local_outlier_factor(df: DataFrame, columns: Sequence[str], k: int = 10, metric: str = "euclidean", order: str | None = None) -> DataFrame:
    """Local outlier factor per distinct point from its k nearest rows; of equally far rows those of the smaller ``order``."""
    points = _first_names(df, columns, order, k) if order else weighted_points(df, columns)
    near = cut_lineage(nearest(points, k, metric).withColumn("w", _weights_by_name(k) if order else _weights(k)))
    used = F.filter(F.arrays_zip("near", "w"), lambda x: x["w"] > 0)
    base = near.select("p", F.least(F.col("n") - 1, F.lit(k)).alias("own"), used.alias("used"))
    base = base.withColumn("reach", F.coalesce(F.element_at(F.transform("used", lambda x: x["near"]["d"]), -1), F.lit(0.0)))
    links = base.select("p", "own", "reach", F.explode_outer("used").alias("u"))
    links = links.select("p", "own", "reach", F.col("u.near.q").alias("q"), F.col("u.near.d").alias("d"), F.coalesce("u.w", F.lit(0)).alias("w"))
    far = links.join(base.select(F.col("p").alias("q"), F.col("reach").alias("q_reach")), "q", "left")
    sums = far.groupBy("p", "own", "reach").agg(F.sum(F.greatest("d", "q_reach") * F.col("w")).alias("_s"), F.sum("w").alias("_w"))
    mean = (F.coalesce("_s", F.lit(0.0)) + F.col("own") * F.col("reach")) / (F.col("_w") + F.col("own"))
    density = cut_lineage(sums.select("p", "own", (1 / (mean + 1e-10)).alias("lrd")))
    back = links.select("p", "q", "w").join(density.select(F.col("p").alias("q"), F.col("lrd").alias("q_lrd")), "q", "left")
    around = back.groupBy("p").agg(F.sum(F.col("q_lrd") * F.col("w")).alias("_s"), F.sum("w").alias("_w"))
    both = density.join(around, "p")
    ratio = (F.coalesce("_s", F.lit(0.0)) + F.col("own") * F.col("lrd")) / (F.col("_w") + F.col("own")) / F.col("lrd")
    return both.select("p", ratio.alias("score"))


def chaining_factor(df: DataFrame, columns: Sequence[str], k: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Connectivity-based factor: weighted length of the chain through the k nearest rows over that of the neighbours."""
    keys = list(keys)
    near = cut_lineage(nearest(weighted_points(df, columns, keys), k, keys=keys).withColumn("w", _weights(k)))
    copies = F.array_repeat("p", F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.arrays_zip("near", "w"), lambda x: F.array_repeat(x["near"]["q"], x["w"].cast("int"))))
    sets = near.select(*keys, "p", F.concat(copies, others).alias("chain"))

    @F.pandas_udf("double")
    def chain_length(p: pd.Series, chain: pd.Series) -> pd.Series:
        out = []
        for start, members in zip(p, chain):
            if members is None or not len(members):
                out.append(0.0)
                continue
            rest = np.array([np.asarray(m, dtype=float) for m in members])
            gap = np.sqrt(((rest - np.asarray(start, dtype=float)) ** 2).sum(1))
            size, total, open_ = len(rest), 0.0, np.ones(len(rest), dtype=bool)
            for i in range(size):
                j = int(np.where(open_, gap, np.inf).argmin())
                total += 2 * (size - i) / (size * (size + 1)) * gap[j]
                open_[j] = False
                gap = np.minimum(gap, np.sqrt(((rest - rest[j]) ** 2).sum(1)))
            out.append(total)
        return pd.Series(out)

    lengths = cut_lineage(sets.select(*keys, "p", "chain", chain_length("p", "chain").alias("length")))
    links = lengths.select(*keys, "p", "length", F.explode("chain").alias("q"))
    joined = links.join(lengths.select(*keys, F.col("p").alias("q"), F.col("length").alias("q_length")), [*keys, "q"])
    return joined.groupBy(*keys, "p", "length").agg(F.avg("q_length").alias("m")).select(
        *keys, "p", F.coalesce(F.try_divide(F.col("length"), F.col("m")), F.lit(1.0)).alias("score"))


# --- density clusters ---------------------------------------------------------------------------------

MOST_DIMENSIONS = 5      # of density clusters by grid cells; others go by metric partitioning


def _length(gaps: Sequence[Column], metric: str) -> Column:
    """Distance from its coordinate gaps."""
    if metric == "euclidean":
        return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    return sum(gaps, F.lit(0.0)) if metric in ("cityblock", "manhattan") else F.greatest(F.lit(0.0), *gaps)


def _density(points: DataFrame, width: int, eps: float, least: int, keys: list[str], metric: str = "euclidean"):
    """Core points and neighbour links.  Any cell of diagonal eps (in the metric) holding ``least`` rows is all core, so only
    points of other cells look for neighbours, and each cell has fewer than ``least`` of those."""
    sides = {"euclidean": math.sqrt(width), "cityblock": width, "manhattan": width, "chebyshev": 1}
    side = eps / sides[metric]
    cells = points.withColumn("cell", F.transform("p", lambda x: F.floor(x / side)))
    sizes = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("held"))
    pts = cut_lineage(lookup_join(cells, sizes, [*keys, "cell"]))
    reach = math.ceil(sides[metric])

    def around(rows: DataFrame, cell: str) -> DataFrame:
        """A row per cell that may hold points within eps, as column ``_at``; coordinates are stepped one by one."""
        out = rows.withColumn("_at", F.array().cast("array<bigint>")).withColumn("_gaps", F.array().cast("array<double>"))
        for i in range(width):
            out = out.withColumn("_step", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
            gap = F.greatest(F.abs("_step") - 1, F.lit(0)) * F.lit(side)
            out = out.withColumn("_at", F.concat("_at", F.array(F.col(cell)[i] + F.col("_step")))).withColumn("_gaps", F.concat("_gaps", F.array(gap)))
            out = out.where(_length([F.col("_gaps")[j] for j in range(i + 1)], metric) <= eps * (1 + 1e-12))
        return out.drop("_step", "_gaps")

    thin = around(pts.where(F.col("held") < least).select(*keys, F.col("p").alias("s"), F.col("cell").alias("_cell")), "_cell")
    thin = thin.select(*keys, "s", F.col("_at").alias("cell"))
    links = salted_join(pts, thin, [*keys, "cell"]).where(distance(F.col("p"), F.col("s"), metric) <= eps)
    links = cut_lineage(links.select(*keys, "s", "p", "n", "cell", (F.col("held") >= least).alias("dense"), distance(F.col("p"), F.col("s"), metric).alias("d")))
    counts = links.groupBy(*keys, "s").agg(F.sum("n").alias("seen"), F.bool_or("dense").alias("by_dense"))
    pts = pts.join(counts.withColumnRenamed("s", "p"), [*keys, "p"], "left")
    dense = F.col("held") >= least
    pts = pts.select(*keys, "p", "n", "cell", dense.alias("dense"), (dense | F.coalesce(F.col("seen") >= least, F.lit(False))).alias("core"),
                     F.coalesce("by_dense", F.lit(False)).alias("by_dense"))
    return cut_lineage(pts), links, side, around


def density_noise(df: DataFrame, columns: Sequence[str], eps: float = 0.5, least: int = 5, keys: Sequence[str] = (),
                  metric: str = "euclidean") -> DataFrame:
    """Per distinct point: 1 when it is neither core nor within eps of a core point."""
    keys = list(keys)
    if len(columns) > MOST_DIMENSIONS or metric not in GRID_METRICS:
        marked, border, _ = metric_space.density(weighted_points(df, columns, keys), eps, least, metric, keys)
        out = null_safe_join(marked, border.withColumnRenamed("ball", "joined"), [*keys, "p"], "left")
        return out.select(*keys, "p", (~F.col("core") & F.col("joined").isNull()).cast("int").alias("outlier"))
    pts, links, *_ = _density(weighted_points(df, columns, keys), len(columns), eps, least, keys, metric)
    thin_core = pts.where("core and not dense").select(*keys, "p")
    touched = links.where(~F.col("dense")).join(thin_core, [*keys, "p"]).select(*keys, F.col("s").alias("p")).distinct().withColumn("touch", F.lit(True))
    out = pts.join(touched, [*keys, "p"], "left")
    noise = ~(F.col("core") | F.col("by_dense") | F.coalesce("touch", F.lit(False)))
    return out.select(*keys, "p", noise.cast("int").alias("outlier"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node name per node, by neighbour minima and label jumping with checkpoints."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("a", F.col("a").alias("label")).distinct())
    while True:
        seen = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(seen, "a", "left").select("a", "label", F.least("label", F.coalesce("low", "label")).alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        moved = lookup_join(step, jump, ["next"])
        moved = cut_lineage(moved.select("a", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = moved.where(F.col("label") != F.col("next")).limit(1).count()
        labels = moved.select("a", F.col("next").alias("label"))
        if not changed:
            return labels


def _dense_links(pts: DataFrame, width: int, side: float, eps: float, around, keys: list[str], metric: str = "euclidean") -> DataFrame:
    """Pairs of neighbouring dense cells with two points within eps.

    Cells are compared by the bounding boxes of their points: surely near, surely far, or split in finer boxes
    until decided; boxes shrink to single points, so the answer is exact.
    """
    dense = pts.where("dense").select(*keys, "cell", "p")

    def boxes(level: int) -> DataFrame:
        fine = F.transform("p", lambda x: F.floor(x / (side / 2 ** level)))
        low = F.array(*[F.min(F.col("p")[i]) for i in range(width)])
        high = F.array(*[F.max(F.col("p")[i]) for i in range(width)])
        return dense.withColumn("box", fine).groupBy(*keys, "cell", "box").agg(low.alias("low"), high.alias("high"))

    def span(far: bool) -> Column:
        def gap(i):
            apart = F.greatest(F.col("a_low")[i] - F.col("b_high")[i], F.col("b_low")[i] - F.col("a_high")[i], F.lit(0.0))
            wide = F.greatest(F.col("a_high")[i] - F.col("b_low")[i], F.col("b_high")[i] - F.col("a_low")[i])
            return wide if far else apart
        return _length([gap(i) for i in range(width)], metric)

    one = boxes(0)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    left = one.select(*keys, F.col("cell").alias("a"), F.col("box").alias("a_box"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    right = one.select(*keys, F.col("cell").alias("b"), F.col("box").alias("b_box"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    pairs = around(left, "a").withColumnRenamed("_at", "b")
    pairs = pairs.join(right, [*keys, "b"]).where(text("a") < text("b"))
    found, level = [], 0
    while True:
        judged = cut_lineage(pairs.withColumn("near", span(True) <= eps).withColumn("far", span(False) > eps))
        yes = judged.where("near").select(*keys, "a", "b").distinct()
        found.append(yes)
        open_ = judged.where(~F.col("near") & ~F.col("far")).select(*keys, "a", "b", "a_box", "b_box").join(yes, [*keys, "a", "b"], "left_anti")
        open_ = cut_lineage(open_)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        level += 1
        finer = boxes(level).withColumn("parent", F.transform("box", lambda x: F.floor(x / 2)))
        a = finer.select(*keys, F.col("cell").alias("a"), F.col("parent").alias("a_box"), F.col("box").alias("a_new"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
        b = finer.select(*keys, F.col("cell").alias("b"), F.col("parent").alias("b_box"), F.col("box").alias("b_new"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
        pairs = open_.join(a, [*keys, "a", "a_box"]).join(b, [*keys, "b", "b_box"])
        pairs = pairs.select(*keys, "a", "b", F.col("a_new").alias("a_box"), F.col("b_new").alias("b_box"), "a_low", "a_high", "b_low", "b_high")


def _numbered(labels: DataFrame) -> DataFrame:
    """(a, cluster): clusters numbered from 0 in the order of their labels."""
    roots = running(labels.select("label").distinct(), [], "label", {"cluster": F.lit(1)}).withColumn("cluster", (F.col("cluster") - 1).cast("int"))
    return cut_lineage(lookup_join(labels, roots, ["label"]).select("a", "cluster"))


def density_clusters(df: DataFrame, columns: Sequence[str], eps: float = 0.5, least: int = 5, keys: Sequence[str] = (),
                     metric: str = "euclidean") -> DataFrame:
    """Per distinct point its cluster number (from 0) or -1 for noise; a border point joins its nearest core point."""
    keys = list(keys)
    width = len(columns)
    if width > MOST_DIMENSIONS or metric not in GRID_METRICS:
        marked, border, edges = metric_space.density(weighted_points(df, columns, keys), eps, least, metric, keys)
        joined = null_safe_join(marked, border.withColumnRenamed("ball", "joined"), [*keys, "p"], "left")
        labels = components(edges, marked.where("core").select(F.col("ball").alias("a")).distinct())
        numbered = _numbered(labels)
        out = lookup_join(joined.withColumn("a", F.coalesce("ball", "joined")), numbered, ["a"])
        return out.select(*keys, "p", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    pts, links, side, around = _density(weighted_points(df, columns, keys), width, eps, least, keys, metric)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    tag = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    named = lambda kind, c: F.concat_ws(":", tag, F.lit(kind), text(c))
    thin_core = pts.where("core and not dense").select(*keys, "p", F.lit(True).alias("thin"))
    rich = links.join(thin_core, [*keys, "p"], "left")
    rich = rich.withColumn("to", F.when(F.col("dense"), named("cell", F.col("cell"))).when(F.col("thin"), named("point", F.col("p"))))
    rich = rich.where(F.col("to").isNotNull()).select(*keys, "s", "to", F.struct("d", "p").alias("gap"))
    cores = pts.where("core").select(F.when(F.col("dense"), named("cell", F.col("cell"))).otherwise(named("point", F.col("p"))).alias("a")).distinct()
    thin_edges = rich.join(thin_core.withColumnRenamed("p", "s"), [*keys, "s"]).select(named("point", F.col("s")).alias("a"), F.col("to").alias("b"))
    cell_edges = _dense_links(pts, width, side, eps, around, keys, metric).select(named("cell", F.col("a")).alias("a"), named("cell", F.col("b")).alias("b"))
    labels = components(thin_edges.union(cell_edges).distinct(), cores)
    numbered = _numbered(labels)
    core_rows = pts.withColumn("a", F.when(F.col("dense"), named("cell", F.col("cell"))).when(F.col("core"), named("point", F.col("p"))))
    core_rows = lookup_join(core_rows, numbered, ["a"])
    border = lookup_join(rich.withColumnRenamed("to", "a"), numbered, ["a"]).groupBy(*keys, F.col("s").alias("p")).agg(F.min_by("cluster", "gap").alias("joined"))
    out = core_rows.join(border, [*keys, "p"], "left")
    return out.select(*keys, "p", F.coalesce("cluster", "joined", F.lit(-1)).alias("cluster"))
