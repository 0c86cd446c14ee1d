"""Clusters of whole series on long rows (series, place, value): no series is ever one cell or one task."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import lookup_join, running
from plumbline.functions.settings import BROADCAST_ROWS, bound, cut_lineage

BLOCK = 1024          # places of a block, whose products of series one task adds up
MOST_SERIES = 4096    # series whose products with each other are decomposed, 128 MB


def placed(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, ``place``, ``v``): values at the place, from 0, that their time has among all times; missing ones are left out."""
    rows = df.select(key, F.col(ts).alias("_ts"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    times = running(df.select(F.col(ts).alias("_ts")).distinct(), [], "_ts", {"place": F.lit(1)})
    return cut_lineage(lookup_join(rows, times.withColumn("place", (F.col("place") - 1).cast("int")), ["_ts"]).select(key, "place", "v"))


def _beside(rows: DataFrame, centres: DataFrame, many: int) -> DataFrame:
    """Rows with the centre points at their place: broadcast where these are few."""
    named = centres.select("cluster", F.col("place").alias("_place"), "c")
    named = F.broadcast(named) if many <= bound(rows.sparkSession, BROADCAST_ROWS) else named
    return rows.join(named, F.col("place") == F.col("_place")).drop("_place")


def _draw(key: str, seed: int, turn: int) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), key), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))


def _seeds(rows: DataFrame, key: str, k: int, seed: int, places: int) -> DataFrame:
    """Centre points (cluster, place, c): k series, each drawn with a chance that grows with its squared distance to those before.

    The draws are hashes of the series' names, so a fit that is repeated starts alike.
    """
    spark = rows.sparkSession
    chosen = [rows.select(key).distinct().orderBy(_draw(key, seed, 0), key).first()[0]]
    centres = rows.where(F.col(key).eqNullSafe(F.lit(chosen[0]))).select(F.lit(0).alias("cluster"), "place", F.col("v").alias("c"))
    for turn in range(1, k):
        gaps = _beside(rows, centres, places * turn).groupBy(key, "cluster").agg(F.sum(F.pow(F.col("v") - F.col("c"), F.lit(2))).alias("d"))
        far = gaps.groupBy(key).agg(F.min("d").alias("d")).where("d > 0")
        found = far.orderBy((F.ln(_draw(key, seed, turn)) / F.col("d")).desc(), key).select(key).first()
        if found is None:    # fewer different series than clusters
            break
        new = rows.where(F.col(key).eqNullSafe(F.lit(found[0]))).select(F.lit(turn).alias("cluster"), "place", F.col("v").alias("c"))
        centres = cut_lineage(centres.union(new))
    return spark.createDataFrame(centres.toArrow(), centres.schema) if places * k <= bound(spark, BROADCAST_ROWS) else cut_lineage(centres)


def cluster_series(df: DataFrame, key: str, ts: str, value: str, k: int = 2, seed: int = 0, rounds: int = 100):
    """(series with their ``cluster``, centre points (cluster, place, value), silhouette or None with one cluster).

    k-means on the values that series have at the same times, by Lloyd's rounds on long rows: squared distances are sums
    per series and cluster, new centres are means per cluster and place, so a series may be of any length and no task
    holds one.  Rounds end when no series changes its cluster.  A time that a series has no value for counts for
    nothing; a cluster that loses its series keeps its centre.  Distances tie to the smaller cluster.
    """
    rows = placed(df, key, ts, value)
    first = rows.agg(F.max("place")).first()[0]
    if first is None:
        raise ValueError("there is no series with a value")
    places = int(first) + 1
    centres, last = _seeds(rows, key, k, seed, places), None
    for _ in range(rounds):
        gaps = _beside(rows, centres, places * k).groupBy(key, "cluster").agg(F.sum(F.pow(F.col("v") - F.col("c"), F.lit(2))).alias("d"))
        nearest = cut_lineage(gaps.groupBy(key).agg(F.min(F.struct("d", "cluster")).alias("n")).select(key, F.col("n.cluster").alias("cluster")))
        now = nearest.agg(F.sum(F.xxhash64(key, "cluster").cast("decimal(38,0)"))).first()[0]
        if now == last:
            break
        last = now
        means = lookup_join(rows, nearest, [key]).groupBy("cluster", "place").agg(F.avg("v").alias("c"))
        kept = centres.join(F.broadcast(means.select("cluster").distinct()), "cluster", "left_anti")    # a row per cluster at most
        centres = cut_lineage(means.unionByName(kept))
    return nearest, centres.select("cluster", "place", F.col("c").alias("value")), _silhouette(rows, key, nearest, places * k)


def _silhouette(rows: DataFrame, key: str, nearest: DataFrame, many: int) -> float | None:
    """Mean silhouette by squared distances, from sums: those of a series to a cluster follow from the cluster's mean."""
    if nearest.select("cluster").distinct().count() < 2:
        return None
    own = lookup_join(rows, nearest, [key])
    size = own.groupBy(key, "cluster").agg(F.sum(F.col("v") * F.col("v")).alias("xx"))
    means = cut_lineage(own.groupBy("cluster", "place").agg(F.avg("v").alias("c")))
    groups = size.groupBy("cluster").agg(F.avg("xx").alias("yy"), F.count(F.lit(1)).alias("n")).withColumnRenamed("cluster", "other")
    products = _beside(rows, means, many).groupBy(key, "cluster").agg(F.sum(F.col("v") * F.col("c")).alias("xy")).withColumnRenamed("cluster", "other")
    apart = products.join(F.broadcast(groups), "other").join(size, key)    # a row per cluster is broadcast
    d = F.greatest(F.col("xx") - 2 * F.col("xy") + F.col("yy"), F.lit(0.0))
    same = F.col("other") == F.col("cluster")
    both = apart.groupBy(key).agg(F.max(F.when(same, F.when(F.col("n") > 1, d * F.col("n") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~same, d)).alias("b"))
    score = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return both.agg(F.avg(score)).first()[0]


def series_products(rows: DataFrame, key: str) -> tuple[list, np.ndarray]:
    """The series in order, and the matrix of products of their values, centred at each place; missing values are the mean.

    Places are dealt into blocks; a task adds up the products of its block, so a calendar may be of any length.
    """
    names = [r[0] for r in rows.select(key).distinct().orderBy(key).limit(MOST_SERIES + 1).collect()]
    if len(names) > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series that are longer than they are many")
    number = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], rows.select(key).schema.add("series", "integer"))
    many = len(names)

    def add(table: pa.Table) -> pa.Table:
        at = table["place"].to_numpy() % BLOCK
        x = np.full((BLOCK, many), np.nan)
        x[at, table["series"].to_numpy()] = table["v"].to_numpy()
        x = x[np.isfinite(x).any(axis=1)]
        x = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
        product = x.T @ x
        return pa.table({"series": pa.array(range(many), pa.int32()), "row": pa.array(product.tolist(), pa.list_(pa.float64()))})

    blocks = rows.join(F.broadcast(number), rows[key].eqNullSafe(number[key])).select("series", "place", "v", F.floor(F.col("place") / BLOCK).alias("block"))
    parts = blocks.groupBy("block").applyInArrow(add, "series int, row array<double>")
    sums = parts.select("series", F.posexplode("row").alias("other", "x")).groupBy("series", "other").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((many, many))
    gram[sums["series"].to_numpy(), sums["other"].to_numpy()] = sums["x"].to_numpy()
    return names, (gram + gram.T) / 2


def series_components(rows: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(key, d0, d1, ...): series on the first ``k`` principal components of the places, from the products of series.

    Where places outnumber series this dual form has the same positions as the decomposition of the places' matrix.
    """
    names, gram = series_products(rows, key)
    values, vectors = np.linalg.eigh(gram)
    best = values.argsort()[::-1][:k]
    scores = vectors[:, best] * np.sqrt(np.maximum(values[best], 0))
    if scores.size:
        scores = scores * np.where(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])] < 0, -1.0, 1.0)
    scores = np.c_[scores, np.zeros((len(names), k - scores.shape[1]))]
    schema = rows.select(key).schema
    for j in range(k):
        schema = schema.add(f"d{j}", "double")
    return rows.sparkSession.createDataFrame([(x, *map(float, s)) for x, s in zip(names, scores)], schema)
