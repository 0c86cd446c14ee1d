"""SimHash near-duplicates: fingerprints, one-wildcard segment variants, groups of near fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage
from plumbline.llm.components import components

BITS = 64
NEAR = 3          # differing bits of linked fingerprints, at most
SEGMENTS = 2      # with NEAR bits apart, one of the segments differs in one bit at most
GROUP = 2048      # fingerprints that are compared in one group; larger groups are cut by further segments
CHUNK = 1 << 16   # shingles whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over 3-word shingles of a text, A-Z lower-cased; a text without words has 0."""
    data = b" ".join((text or "").encode().lower().split())    # bytes: only A-Z change, only ASCII white space parts
    if not data:
        return 0
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    first = np.concatenate(([0], ends + 1))
    last = np.concatenate((ends, [len(data)]))
    if len(first) >= 3:
        first, last = first[:-2], last[2:]
    else:
        first, last = first[:1], last[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at:at + CHUNK].tolist(), last[at:at + CHUNK].tolist())
        hashes = np.array([digest(data[i:j], 42) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += _column_sums(bits)
    return sum(1 << int(i) for i in np.flatnonzero(counts * 2 > len(first)))


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums per column of 0/1 bytes: 255 rows at a time fit a byte, so most additions are of bytes."""
    full = len(bits) // 255 * 255
    sums = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        packed = bits[:full].reshape(255, -1, bits.shape[1])
        part = packed[0].copy()
        for row in packed[1:]:
            part += row
        sums += part.sum(axis=0, dtype=np.int64)
    return sums


def fingerprints(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) per row, and the columns of ``more``; fp holds the 64 bits in a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            columns = [batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *more])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *more)}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"{c} {kinds[c]}" for c in more]])
    return docs.select("doc_id", "text", *more).mapInArrow(run, schema)


def _segments(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _near_in_group(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (a, b) that join all fingerprints of one group which are connected by near pairs of the group."""
    left = np.unique(prints)
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= NEAR
            if near.any():
                found, left = left[near], left[~near]
                todo.extend(found)
                yield from ((int(root), int(x)) for x in found)


def _verify(groups: DataFrame) -> DataFrame:
    """Links within groups (columns gid, fp), every group compared whole in one place; groups hold a bounded number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(keys, prints):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            for i in np.flatnonzero(stops - starts > 1):
                yield from _near_in_group(prints[starts[i]:stops[i]])

        def out(pairs):
            pairs = np.array(sorted(set(pairs)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1])    # the last group may go on in the next batch
            held_key, held = keys[cut:], prints[cut:]
            if cut:
                yield out(links(keys[:cut], prints[:cut]))
        if len(held_key):
            yield out(links(held_key, held))

    return groups.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a long, b long").distinct()


def _cells(prints: DataFrame) -> DataFrame:
    width = BITS // SEGMENTS
    return prints.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segments(F.col("fp"), s * width, width).alias("v"))
                                                   for s in range(SEGMENTS)])).alias("c")).select("fp", "c.seg", "c.v")


def near_links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all those at most ``NEAR`` bits apart.

    Method: a fingerprint is cut into ``SEGMENTS`` segments, so that one segment of a near pair differs in one bit at
    most.  Distinct segment values are indexed under their one-wildcard variants; an equality join of the variants
    gives the pairs of values one bit apart (a variant has two values at most).  The fingerprints under one value or
    under two such values are a group; whole fingerprints decide within it.

    A group over ``group`` fingerprints is cut again the same way: of the rest of its bits, halved, one half differs in
    one bit at most, so its fingerprints part by the value of a half, whole or with one wildcard.  Two further cuts
    leave 8 rest bits and at most 3 wildcards: no more than 2,048 fingerprints differ in them.  All groups are compared
    whole, so nothing is capped, and no pair is emitted but the links that hold a group together.
    """
    width = BITS // SEGMENTS
    cells = cut_lineage(_cells(prints))
    values = cells.groupBy("seg", "v").agg(F.count("*").alias("n"))
    wild = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col("v").bitwiseAND(F.lit(~(1 << w))).alias("key"))
                               for w in range(width)]))
    pairs = values.select("seg", "v", "n", wild.alias("x")).groupBy("seg", "x.w", "x.key") \
        .agg(F.min("v").alias("v1"), F.max("v").alias("v2"), F.sum("n").alias("n")).where("v1 <> v2")
    named = pairs.select("seg", F.explode(F.array("v1", "v2")).alias("v"), F.xxhash64("seg", "w", "key").alias("gid"), "n") \
        .union(values.where("n > 1").select("seg", "v", F.xxhash64("seg", F.lit(-1), "v").alias("gid"), "n"))
    members = cut_lineage(cells.join(named, ["seg", "v"]).select("gid", "fp", "seg", "n"))
    links = _verify(members.where(F.col("n") <= group).select("gid", "fp"))
    large = members.where(F.col("n") > group).withColumn("low", (F.col("seg") == 0).cast("int") * width)
    for step in (width // 2, width // 4):
        halves = F.explode(F.array(*[F.struct((F.col("low") + h * step).alias("at"), (F.col("low") + (1 - h) * step).alias("low"))
                                     for h in range(2)]))
        cut = large.select("gid", "fp", halves.alias("h")).select("gid", "fp", "h.at", "h.low") \
            .withColumn("v", F.expr(f"shiftrightunsigned(fp, `at`) & {(1 << step) - 1}"))
        keyed = cut.select("gid", "fp", "at", "low", F.explode(F.array(*[
            F.struct(F.lit(w).alias("w"), F.col("v").bitwiseAND(F.lit(~(1 << w) if w >= 0 else -1)).alias("key"))
            for w in range(-1, step)])).alias("x")) \
            .select(F.xxhash64("gid", "at", "x.w", "x.key").alias("gid"), "fp", "low")
        sized = keyed.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")
        keyed = cut_lineage(keyed.join(sized, "gid"))
        final = step == width // 4
        links = links.union(_verify((keyed if final else keyed.where(F.col("n") <= group)).select("gid", "fp")))
        large = keyed.where(F.col("n") > group)
        if final or large.isEmpty():
            break
    return links


def _rooted(prints: DataFrame, group: int) -> DataFrame:
    """``prints`` (distinct fingerprints fp, with first) and the root of each one's component, which is never null."""
    prints = cut_lineage(prints)
    found = components(near_links(prints.select("fp"), group))
    return prints.join(found, prints["fp"] == found["node"], "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("root"))


def simhash_groups(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Near-duplicate groups: doc_id, fp (long), fingerprint (16 hex digits), component_id; one row per row of ``docs``.

    The fingerprint's bit is 1 where over half of the text's shingle hashes have it set; hashes are XXH64 with seed 42
    over the shingle's UTF-8 bytes.  Fingerprints at most 3 bits apart are linked; component_id is the smallest doc_id
    reachable.  Texts with equal fingerprints are merged first, so copies cost nothing beyond their fingerprint.

    Null and empty texts have fingerprint 0 and are linked like any other.  A null doc_id stays null and is no smallest
    id while its component has another.  Only doc_id and text are read.  Empty input gives no rows.
    """
    keyed = cut_lineage(fingerprints(docs))
    rooted = _rooted(keyed.groupBy("fp").agg(F.min("doc_id").alias("first")), group)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return keyed.join(named, F.col("fp") == F.col("_fp"), "left") \
        .select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, with all its columns.

    Groups are told apart by their fingerprints, never by ids.  Null doc_ids come last, so such a row stays only where no
    row of its group has an id; of rows with one id, or none, in a group the text with the least hash stays.  A doc_id
    whose texts are in several groups can stay once in each.  Of rows equal in doc_id and text one stays.
    """
    hashes = {"__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(1), "text")}
    keyed = fingerprints(docs.withColumns(hashes), tuple(hashes))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *hashes)
    rooted = _rooted(keyed.groupBy("fp").agg(F.min(order).alias("first")), GROUP)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")) \
        .select(F.col("first.doc_id").alias("__kept_id"), F.col("first.__h1").alias("__kept_1"), F.col("first.__h2").alias("__kept_2"))
    own = (F.col("__h1") == F.col("__kept_1")) & (F.col("__h2") == F.col("__kept_2")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    return docs.withColumns(hashes).join(kept, own, "left_semi").dropDuplicates(["doc_id", *hashes]).drop(*hashes)


def op1_simhash(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")
