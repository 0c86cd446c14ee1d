"""Quality classifier: compressed sizes under dictionaries built from good and from bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage

FOLDS = 5           # a document is held out when crc32(doc_id) mod FOLDS is 0
HALVES = 2          # the labelled documents are split by a hash; dictionaries of each half are calibrated on the others
SAMPLE = 500        # labelled documents per class and half that the dictionaries are built from, at most
LONGEST = 16_384    # characters; longer ones are left out of that sample (texts that are scored are never cut)
CALIBRATE = 2000    # labelled documents per class that the scores are calibrated on, at most
DICTIONARY = 65_536
PIECE = 512         # bytes that are compressed at a time; a text's own repeats outweigh the dictionary in long pieces
LEVEL = 3
ACCEPT = 0.3


@dataclass(frozen=True)
class Pair:
    """Dictionaries of good and of bad text."""

    good: bytes
    bad: bytes
    raw: bool

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), **plain) for d in (self.good, self.bad)]


@dataclass(frozen=True)
class Model:
    """Pairs of dictionaries, and a rising curve over the difference of compressed sizes per byte, straight between knots.

    ``base`` is the share of good documents among the labelled ones; texts without bytes score it.  Without pairs all
    texts do.
    """

    pairs: tuple[Pair, ...] = ()
    knots: tuple[float, ...] = ()
    shares: tuple[float, ...] = ()
    base: float = 0.5

    def compressors(self) -> list[list[zstandard.ZstdCompressor]]:
        return [p.compressors() for p in self.pairs]

    def score(self, saved: np.ndarray) -> np.ndarray:
        """Scores from differences; where there is none (not a number), the base."""
        known = np.isfinite(saved)
        return np.where(known, np.interp(np.where(known, saved, 0.0), self.knots, self.shares), self.base) if self.pairs else np.full(len(saved), self.base)


def pieces(text: str) -> Iterator[bytes]:
    data = text.encode()
    return (data[at:at + PIECE] for at in range(0, len(data), PIECE))


def saved(text: str | None, compressors: list[list[zstandard.ZstdCompressor]]) -> float:
    """Of a whole text: how many bytes good dictionaries save over bad ones, per byte, as the mean of the pairs."""
    if not text or not compressors:
        return float("nan")
    total = n = 0
    for piece in pieces(text):
        n += len(piece)
        for good, bad in compressors:
            total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / n / len(compressors)


def _pair(good: list[str], bad: list[str]) -> Pair:
    samples = [[p for t in texts for p in pieces(t)] for texts in (good, bad)]
    try:
        return Pair(*[zstandard.train_dictionary(DICTIONARY, some).as_bytes() for some in samples], False)
    except zstandard.ZstdError:    # too little text to choose from, then both are plain text
        return Pair(*[b"".join(some)[-DICTIONARY:] for some in samples], True)


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Knots of a curve that rises with ``x``: neighbours are pooled until the shares of 1 in ``y`` rise.

    Each pool's share counts one row of the ``prior`` besides its own, so none is 0 or 1.
    """
    order = np.lexsort((y, x))
    pools: list[list[float]] = []    # weight, weighted y, weighted x
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([w, w * b, w * a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    shares = np.maximum.accumulate([(p[1] + prior) / (p[0] + 1) for p in pools])
    return tuple(p[2] / p[0] for p in pools), tuple(shares.tolist())


def held_out(doc_id: Column) -> Column:
    """A null doc_id is never held out, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _saved_table(docs: DataFrame, compressors, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and ``__saved``; ``compressors`` makes the pairs in a worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors()
        for batch in batches:
            found = np.array([saved(t.as_py(), made) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found)], [*keep, "__saved"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(run, f"{schema}, __saved double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibrate: int = CALIBRATE) -> Model:
    """Dictionaries and calibration from labelled documents that are not held out.

    The labelled documents are split into two halves by a hash of doc_id before anything is bounded.  Each half gives
    a pair of dictionaries, from the ``sample`` documents of either class that come first in the order of a hash, and
    is calibrated on documents of the other half, so no text is judged by a dictionary that holds it.  A score is the
    mean of both pairs.  Calibration takes up to ``calibrate`` documents per class, weighed so that the classes have
    their natural shares; that holds at any number of labels.  Only the sample's texts and a number per calibration
    document reach the driver.

    Rows without a label of 0 or 1 teach nothing; a doc_id with both labels counts as bad.  A half that lacks a class
    gives no pair, but is calibrated on; without a pair, or with one class in what is left to calibrate on, all texts
    score the share of good documents (without labels 0.5).
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    lengths = docs.where(F.length("text") > 0).groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    known = cut_lineage(known.join(lengths, "doc_id").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(HALVES)).cast("int")))
    many = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(many) < 2:
        return Model()

    def first(rows: DataFrame, name: str, n: int) -> list:
        return rows.orderBy(F.xxhash64(F.lit(name), "doc_id"), "doc_id").limit(n).collect()

    chosen = {(r.quality, r.half, r.doc_id) for q in (0, 1) for h in range(HALVES)
              for r in first(known.where((F.col("quality") == q) & (F.col("half") == h) & (F.col("n") <= LONGEST)), "quality", sample)}
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame(sorted(chosen), f"quality int, half int, doc_id {kind}"))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(named, "doc_id").collect()
    texts = sorted((r.doc_id, r.text, r.quality, r.half) for r in texts)
    pairs = {}
    for h in range(HALVES):
        good, bad = ([t[1] for t in texts if t[2] == q and t[3] == h] for q in (1, 0))
        if good and bad:
            pairs[h] = _pair(good, bad)
    curve = [r for q in (0, 1) for r in first(known.where(F.col("quality") == q), "curve", calibrate) if any(h != r.half for h in pairs)]
    weight = {q: many[q] / max(1, sum(r.quality == q for r in curve)) for q in (0, 1)}
    base = many[1] / (many[0] + many[1])
    if len({r.quality for r in curve}) < 2:
        return Model(base=base)
    named = F.broadcast(spark.createDataFrame([(r.doc_id, r.quality, r.half) for r in curve], f"doc_id {kind}, quality int, half int"))
    rows = docs.select("doc_id", "text").where(F.length("text") > 0).join(named, "doc_id")
    found = []
    for half in sorted({r.half for r in curve}):
        others = [pairs[h] for h in pairs if h != half]
        own = _saved_table(rows.where(F.col("half") == half), lambda others=others: [p.compressors() for p in others], ["doc_id", "quality"])
        found += sorted((r.doc_id, r[2], r.quality) for r in own.collect())
    y = np.array([r[2] for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(base=base)
    return Model(tuple(pairs.values()), *rising(np.array([r[1] for r in found]), y, np.array([weight[r[2]] for r in found]), base), base)


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and ``__score``."""
    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(batch.column("__saved").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(value)], [*keep, "__score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return _saved_table(docs, model.compressors, keep).mapInArrow(curve, f"{schema}, __score double")


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with score (0 to 1) and predicted (0 or 1) of the whole text.

    A null text scores like an empty one: the share of good documents, since nothing speaks for or against it.  Whole
    texts are compressed, in pieces, so a very long one takes no more memory.  Columns named score or predicted are
    replaced.
    """
    rest = [c for c in keep if c not in ("score", "predicted")]
    return _scored(docs, model, rest).select(*rest, F.col("__score").alias("score"), (F.col("__score") >= ACCEPT).cast("int").alias("predicted"))


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    return _scored(docs, train(docs, labels), docs.columns).where(F.col("__score") >= ACCEPT).drop("__score")
