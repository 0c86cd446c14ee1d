"""Hard negatives: integer tiles by Strassen's recursion, then heaps of positives and of the windows below them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.vectors import matrix, rows_of

EVERY = 100         # anchors are the rows whose vec_id it divides
POSITIVES = 5       # positives of an anchor
NEGATIVES = 10      # negatives of an anchor and a positive
LOW, HIGH = 30, 90  # a negative's score in percent of the positive's
SCALE = 256
BLOCK = 8192        # candidates of one block
ANCHORS = 1024      # anchors of one block
TILE = 2048         # candidates of one product
LEAF = 8           # sides up to which a product is not divided further
NONE = np.iinfo(np.int64).min


# ---- products

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven products of their quarters, down to sides of ``leaf``.

    Odd sides get a row or column of zeros.  Sums wrap around like the machine's integers do, and integers modulo 2^64
    are a ring, so the result is exact wherever the product itself fits into 64 bits, whatever the sums in between.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((2 * i, 2 * l), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :l] = p
    out[i:, l:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[i:, :l] = p
    out[i:, l:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:i, l:] = p
    out[i:, l:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:i, :l] += p
    out[i:, :l] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:i, :l] -= p
    out[:i, l:] += p
    out[i:, l:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :l] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, width)).astype(np.int64) if width else np.zeros((len(column), 0), np.int64)


# ---- heaps

def first_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k highest scores other than ``NONE``; of equal scores the first columns."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, level = scores > edge, scores == edge
        room = k - above.sum(axis=1)
        if (level.sum(axis=1) > room).any():
            level &= np.cumsum(level, axis=1) <= room[:, None]
        return np.nonzero((above | level) & (scores != NONE))
    return np.nonzero(scores != NONE)


def push(heap: list, entry: tuple, k: int) -> None:
    """Keep the k largest entries; an entry is (score, negated id, negated row, ...)."""
    if len(heap) < k:
        heapq.heappush(heap, entry)
    elif entry > heap[0]:
        heapq.heapreplace(heap, entry)


def tile_positives(anchors, candidates, k: int = POSITIVES, tile: int = TILE) -> list[list[tuple]]:
    """Per anchor the heap of its k best candidates of the same label, itself left out.

    Both sides are (ids, rows, labels, integers); ``rows`` are hashes that tell rows of one id apart.
    """
    ids, marks, labels, x = anchors
    heaps: list[list[tuple]] = [[] for _ in ids]
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        others = np.flatnonzero(candidates[2] == label)
        others = others[np.lexsort((candidates[1][others], candidates[0][others]))]
        for at in range(0, len(others), tile):
            some = others[at:at + tile]
            scores = strassen(x[own], candidates[3][some].T)
            scores[(ids[own][:, None] == candidates[0][some]) & (marks[own][:, None] == candidates[1][some])] = NONE
            rows, places = first_k(scores, k)
            for i, j in zip(rows.tolist(), places.tolist()):
                push(heaps[own[i]], (int(scores[i, j]), -int(candidates[0][some[j]]), -int(candidates[1][some[j]])), k)
    return heaps


def tile_negatives(anchors, positives: np.ndarray, candidates, k: int = NEGATIVES, tile: int = TILE) -> list[list[list[tuple]]]:
    """Per anchor and positive the heap of the k best candidates of other labels inside the positive's window.

    ``positives`` has a row of scores per anchor, ``NONE`` where it has fewer.
    """
    ids, _, labels, x = anchors
    heaps: list[list[list[tuple]]] = [[[] for _ in range(positives.shape[1])] for _ in ids]
    order = np.lexsort((candidates[1], candidates[0]))
    for at in range(0, len(order), tile):
        some = order[at:at + tile]
        scores = strassen(x, candidates[3][some].T)
        other = labels[:, None] != candidates[2][some]
        for place in range(positives.shape[1]):
            score = positives[:, place][:, None]
            held = score != NONE
            score = np.where(held, score, 0)
            inside = other & held & (LOW * score <= 100 * scores) & (100 * scores <= HIGH * score)
            rows, places = first_k(np.where(inside, scores, NONE), k)
            for i, j in zip(rows.tolist(), places.tolist()):
                push(heaps[i][place], (int(scores[i, j]), -int(candidates[0][some[j]]), -int(candidates[1][some[j]])), k)
    return heaps


# ---- tables

def _taking_part(embeddings: DataFrame) -> DataFrame:
    vector = F.col("vector")
    most = F.floor(F.sqrt(F.lit(2.0 ** 63) / (100 * F.greatest(F.size(vector), F.lit(1))))) - 1
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE <= most))
    rows = rows_of(embeddings).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10)
                       .otherwise(F.col("label").cast("long")).alias("label"))


def _blocks(many: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))


def _side(table: pa.Table, width: int):
    return (table["vec_id"].to_numpy(), table["mark"].to_numpy(), table["label"].to_numpy(), integers(table["vector"], width))


def hard_negatives(embeddings: DataFrame, every: int = EVERY, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A component x counts as floor(256 x); scores are inner products of these integers, in 64 bits.  Anchors are the
    rows whose vec_id is divisible by ``every``; their positives are the 5 best other rows of their label, and of each
    positive the 10 best rows of other labels that score 30 to 90 percent of it are returned.  Higher scores come
    first, ties go to the smaller vec_id.

    Method: anchors and candidates are dealt into blocks by a hash of the row, as many as their counted numbers need,
    so blocks are even whatever the data, and a block of anchors meets each block of candidates in one task.  That
    happens twice, since a window is known only when all blocks have given their positives.  A task multiplies tile by
    tile and keeps a heap of 5 per anchor, then of 10 per anchor and positive; heaps of blocks merge by rank, with Spark's limit
    per group ahead of the shuffle.  The traffic is each vector once per block of the other side.

    Rows whose vec_id, label or vector is null, or that hold a null or non-finite component, take no part, nor do rows
    with components so large that 100 times a score may leave 64 bits (over 148,000 at 64 components).  Zero vectors do,
    and empty ones.  Vectors of different lengths do not meet.  Rows equal in vec_id, label and vector count once;
    other rows of one vec_id are rows of their own.  A positive of score zero or less has a window of zero alone or
    none.  Only vec_id, embedding and label are read.  No anchors: no rows.
    """
    rows = _taking_part(embeddings).distinct().withColumn("width", F.size("vector")).withColumn("mark", F.xxhash64("vec_id", "label", "vector"))
    rows = written(rows, "negatives-rows")
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    across, along = max(1, math.ceil(n / block)), max(1, math.ceil(m / anchors))
    left = rows.where(F.col("vec_id") % every == 0).withColumn("q", F.pmod("mark", F.lit(along)))
    right = rows.select("*", F.pmod(F.shiftright("mark", 20), F.lit(across)).alias("c"), F.explode(_blocks(along)).alias("q"))
    keys = ("c", "q", "width")

    def meet_positives(own: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(candidates):
            width = own["width"][0].as_py()
            left, right = _side(own, width), _side(candidates, width)
            out = [(a, b, -e[1], -e[2], e[0]) for a, b, heap in zip(left[0].tolist(), left[1].tolist(), tile_positives(left, right)) for e in heap]
        return _columns(out, ("vec_id", "mark", "positive_id", "positive_mark", "score"))

    def meet_negatives(own: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(candidates):
            width = own["width"][0].as_py()
            left, right = _side(own, width), _side(candidates, width)
            found = own["positives"].to_pylist()
            scores = np.full((len(found), max(map(len, found))), NONE, np.int64)
            for i, held in enumerate(found):
                scores[i, :len(held)] = [p["score"] for p in held]
            heaps = tile_negatives(left, scores, right)
            out = [(a, b, p["place"], p["positive_id"], p["score"], -e[1], -e[2], e[0])
                   for a, b, held, own_heaps in zip(left[0].tolist(), left[1].tolist(), found, heaps) for p, heap in zip(held, own_heaps) for e in heap]
        return _columns(out, ("vec_id", "mark", "place", "positive_id", "positive_score", "negative_id", "negative_mark", "negative_score"))

    dealt = left.withColumn("c", F.explode(_blocks(across)))
    best = dealt.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet_positives, "vec_id long, mark long, positive_id long, positive_mark long, score long")
    order = Window.partitionBy("vec_id", "mark").orderBy(F.col("score").desc(), "positive_id", "positive_mark")
    best = best.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= POSITIVES)
    windows = best.groupBy("vec_id", "mark").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))
    dealt = left.join(windows, ["vec_id", "mark"]).withColumn("c", F.explode(_blocks(across)))
    dealt = written(dealt, "negatives-windows")
    found = dealt.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet_negatives, "vec_id long, mark long, place long, positive_id long, positive_score long, negative_id long, negative_mark long, negative_score long")
    order = Window.partitionBy("vec_id", "mark", "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative_mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)})


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)


OP12_SQL = """
WITH part AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (
  SELECT row_number() OVER (ORDER BY vec_id, label, embedding) AS mark, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM part),
scored AS (
  SELECT a.mark AS a_mark, a.vec_id AS anchor_id, c.mark AS c_mark, c.vec_id, a.label = c.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM numbered a JOIN numbered c ON a.vec_id % 100 = 0 AND a.mark <> c.mark AND len(a.v) = len(c.v)),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a_mark ORDER BY score DESC, vec_id, c_mark) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a_mark, p.c_mark ORDER BY n.score DESC, n.vec_id, n.c_mark)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a_mark = p.a_mark AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
