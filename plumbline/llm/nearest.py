"""Approximate nearest neighbours by block matrix products of int8 vectors, made exact by error bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage
from plumbline.llm.vectors import matrix, rows_of, usable

NEIGHBOURS = 10
BLOCK = 8192        # candidates of one block
QUERIES = 1024      # queries of one block
TILE = 2048         # candidates of one matrix product


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding left over."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):    # dimension by dimension: the same sum wherever a row stands
        total += (x[:, d] - y[:, d]) ** 2
    return np.sqrt(total)


def tile_nearest(query_ids, queries, ids, vectors, k: int):
    """Per query the k smallest (distance, id) among ``vectors``, each id once and the query's own left out.

    The product of the int8 rows gives each distance up to a bound from what rounding left over.  A candidate survives
    when its least possible distance is not above the k-th smallest greatest possible one, nor above the worst of the
    heap; survivors are computed again from the original numbers.  Rows of one id count as one place for both limits.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    repeated = bool((ids[1:] == ids[:-1]).any())
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    q8, q_scale, q_rest = quantised(queries)
    q_long = np.sqrt((queries ** 2).sum(axis=1))
    product = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64    # integers stay exact
    for at in range(0, len(ids), TILE):
        own, y = ids[at:at + TILE], vectors[at:at + TILE]
        y8, y_scale, y_rest = quantised(y)
        y_long = np.sqrt((y ** 2).sum(axis=1))
        dots = (q8.astype(product) @ y8.astype(product).T).astype(np.float64) * q_scale[:, None] * y_scale
        squares = q_long[:, None] ** 2 + y_long ** 2
        slack = 2 * (q_rest[:, None] * y_long + (q_long + q_rest)[:, None] * y_rest) + 1e-9 * squares
        around = squares - 2 * dots
        other = own != query_ids[:, None]
        most = np.where(other, around + slack, np.inf)
        if repeated:    # the rows of an id stand together
            most = np.minimum.reduceat(most, np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), axis=1)
        edge = np.partition(most, k - 1, axis=1)[:, k - 1] if most.shape[1] > k else np.full(len(query_ids), np.inf)
        worst = np.array([(-h[0][0]) ** 2 * (1 + 1e-9) if len(h) == k else np.inf for h in heaps])
        i, j = np.nonzero(other & (around - slack <= np.minimum(edge, worst)[:, None]))
        for a, score, name in zip(i.tolist(), _exact(queries[i], y[j]).tolist(), own[j].tolist()):
            held = next((n for n, (_, x) in enumerate(heaps[a]) if x == -name), None) if repeated else None
            if held is not None:
                if -score > heaps[a][held][0]:
                    heaps[a][held] = (-score, -name)
                    heapq.heapify(heaps[a])
            elif len(heaps[a]) < k:
                heapq.heappush(heaps[a], (-score, -name))
            elif (-score, -name) > heaps[a][0]:
                heapq.heapreplace(heaps[a], (-score, -name))
    return heaps


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = 100, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The k nearest rows of each query by Euclidean distance: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own.  Ties go
    to the smaller vec_id.  Distances are in double precision on the original vectors; none is lost, see
    ``tile_nearest``.

    Method: candidates and queries are counted and dealt into blocks by a hash of vec_id, so blocks are even whatever the data.  A
    block of queries meets each block of candidates in one task, which works tile by tile and keeps a heap per query;
    the heaps of a query, k rows per block, are merged by rank with Spark's limit per group ahead of the shuffle.
    Vectors are sent once per block of the other side: that is the whole traffic.

    Rows whose vec_id is null or whose vector is null, empty, zero or not finite take no part; vectors of different
    lengths do not meet.  Rows that repeat vec_id and vector count once; a vec_id with several vectors is at its
    smallest distance.  Only vec_id and embedding are read.  No queries or no candidates: no rows.
    """
    rows = rows_of(embeddings).select("vec_id", "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    rows = cut_lineage(rows)
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    across, along = max(1, math.ceil(n / block)), max(1, math.ceil(m / queries))
    place = F.xxhash64("vec_id")
    span = lambda many: F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))
    wide = F.size("vector").alias("width")
    left = rows.where(F.col("vec_id") % every == 0).select(
        "vec_id", "vector", wide, F.pmod(place, F.lit(along)).alias("q"), F.explode(span(across)).alias("c"))
    right = rows.select("vec_id", "vector", wide, F.pmod(F.shiftright(place, 20), F.lit(across)).alias("c"),
                        F.explode(span(along)).alias("q"))

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if len(queries) and len(candidates):
            width = queries["width"][0].as_py()
            names = queries["vec_id"].to_numpy()
            heaps = tile_nearest(names, matrix(queries["vector"], width), candidates["vec_id"].to_numpy(), matrix(candidates["vector"], width), k)
            out = [(int(name), -b, -a) for name, heap in zip(names, heaps) for a, b in heap]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()),
                         "score": pa.array([o[2] for o in out], pa.float64())})

    keys = ("c", "q", "width")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings)


OP2_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         min(sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
