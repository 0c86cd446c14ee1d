"""Embedding near-duplicates by p-stable hashing of normalised vectors, with exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.components import components
from plumbline.llm.vectors import matrix, rows_of, usable

LEAST = 0.93     # cosine of linked vectors
TABLES = 48      # hash tables: a pair at LEAST shares a bucket in one of them with probability 0.977, one at 0.95 with 0.998
DIRECTIONS = 16  # projections of one table
STEP = 2.0       # width of a projection's steps, for vectors of length 1
GROUP = 2048     # vectors that are compared in one group; larger buckets are cut into blocks
ROWS = 256       # rows of one product


@lru_cache(8)
def _projections(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng([7, width])
    shape = (TABLES, DIRECTIONS)
    return (draw.normal(size=(width, TABLES * DIRECTIONS)), draw.uniform(0, STEP, TABLES * DIRECTIONS),
            draw.integers(1, 1 << 62, shape, dtype=np.int64) * 2 + 1)


def bucket_keys(x: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and table: the steps in which the row's projections fall, hashed."""
    along, shift, mixer = _projections(x.shape[1])
    unit = x / np.sqrt((x ** 2).sum(axis=1))[:, None]
    steps = np.floor((unit @ along + shift) / STEP).astype(np.int64).reshape(-1, TABLES, DIRECTIONS)
    mixed = (steps + 1).view(np.uint64) * mixer.view(np.uint64)[None]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _hashed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(pa.compute.list_value_length(batch.column("vector")))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                keys = bucket_keys(matrix(part.column("vector"), int(width)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TABLES, np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(run, f"{schema}, keys array<long>")


def group_links(x: np.ndarray, keys: np.ndarray, copies: np.ndarray, part: np.ndarray, table: int, cross: bool):
    """Links of one group that no earlier table has: per row the copies it links with, and the first row it reaches.

    A pair belongs to the first table in which its rows share a bucket, so every pair counts once overall.
    """
    unit = x / np.sqrt((x ** 2).sum(axis=1))[:, None]
    links, pairs = np.zeros(len(x), np.int64), []
    for at in range(0, len(x), ROWS):
        i, j = np.nonzero(unit[at:at + ROWS] @ unit[at:].T >= LEAST)
        i, j = i + at, j + at
        fit = (i < j) & (part[i] != part[j]) if cross else i < j
        i, j = i[fit], j[fit]
        for t in range(table):
            new = keys[i, t] != keys[j, t]
            i, j = i[new], j[new]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        pairs.append((i, j))
    reach = np.arange(len(x))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    while len(i):
        low = np.minimum(reach[i], reach[j])
        before = reach.copy()
        np.minimum.at(reach, i, low)
        np.minimum.at(reach, j, low)
        reach = reach[reach]
        if (before == reach).all():
            break
    return links, reach


def _verified(groups: DataFrame) -> DataFrame:
    """(nid, links, other) from groups; other is a row of the group that nid is connected with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(held)
            gid = rows["gid"].to_numpy()
            cuts = np.flatnonzero(np.diff(gid)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(gid)]):
                if b - a < 2:
                    continue
                own = rows.slice(a, b - a).combine_chunks()
                names = own["nid"].to_numpy()
                width = len(own["vector"][0])
                links, reach = group_links(matrix(own["vector"], width), own["keys"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES),
                                           own["copies"].to_numpy(), own["part"].to_numpy(), own["t"][0].as_py(), own["cross"][0].as_py())
                hit = links > 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(names[hit]), pa.array(links[hit]), pa.array(names[reach][hit])], ["nid", "links", "other"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("gid").to_numpy()
            cut = int(np.searchsorted(gid, gid[-1]))
            if cut or (held and held[-1].column("gid")[-1].as_py() != gid[0]):    # what came before is whole
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return groups.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "nid long, links long, other long")


def embedding_links(embeddings: DataFrame, group: int = GROUP) -> DataFrame:
    """Near-duplicates within a label: vec_id, n_links, component_id, kept; one row per row of ``embeddings``.

    Vectors are linked when their labels are equal and not null, they share a bucket in one of ``TABLES`` tables, and
    their cosine in double precision is at least ``LEAST``.  n_links is the number of other vectors linked directly,
    component_id the smallest vec_id reachable, kept whether that is the vector's own.

    Method: a table concatenates ``DIRECTIONS`` quantised Gaussian projections of the normalised vector.  Vectors that
    are equal are merged first and count as often as they occur.  Buckets with one vector are dropped before vectors
    are sent.  A bucket is compared whole in products of ``ROWS`` rows; one with over ``group`` vectors is cut into
    blocks, every two of which meet in a task of their own.  No pairs are emitted: a group returns a number and one
    connection per vector.

    Vectors that are null, empty, zero or not finite, and rows with a null vec_id or label, have no links and are their
    own component; a null vec_id gives a null component and kept false.  Vectors of different lengths do not meet.
    Rows that repeat vec_id, label and vector are one vector, returned as often as they occur; a vec_id with several
    vectors gets the links of all.  Further columns are ignored.
    """
    rows = rows_of(embeddings).select("vec_id", "vector", "label")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    nodes = rows.where(fit).distinct().groupBy("label", "vector").agg(F.min("vec_id").alias("nid"), F.count("*").alias("copies"))
    nodes = written(_hashed(nodes), "vector-keys")
    placed = nodes.select("nid", "label", F.size("vector").alias("width"), F.posexplode("keys").alias("t", "key")) \
        .select("nid", "t", F.xxhash64("label", "width", "t", "key").alias("bucket"))
    sized = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") * 2 / group)
    own = F.when(F.col("n") > group, F.pmod(F.xxhash64("nid"), blocks)).otherwise(F.lit(0)).cast("long")
    others = F.when(F.col("n") > group, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long")))
    meeting = placed.join(sized, "bucket").withColumn("part", own).withColumn("with", F.explode(others)) \
        .select("nid", "t", "part", (F.col("part") != F.col("with")).alias("cross"),
                F.xxhash64("bucket", F.least("part", "with"), F.greatest("part", "with")).alias("gid"))
    found = written(_verified(meeting.join(nodes.select("nid", "vector", "copies", "keys"), "nid")), "vector-links")
    counts = found.groupBy("nid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("nid").alias("a"), F.col("other").alias("b")))
    near = nodes.select("label", "vector", "nid", "copies").join(counts, "nid", "left").join(linked, F.col("nid") == F.col("node"), "left") \
        .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), F.coalesce("component", "nid").alias("_component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    joined = rows.join(near, F.col("vec_id").isNotNull() & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    return embedding_links(embeddings)
