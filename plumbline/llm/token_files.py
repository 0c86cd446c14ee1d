"""Token ids in files: canonical length-limited Huffman codes, blocks that decode on their own, bit-offset checkpoints."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.settings import scratch_folder
from plumbline.llm.common import Store, written

VOCABULARY = "word_bpe_49k.json"
END = 2              # id behind every document
LIMIT = 18           # bits of the longest code
EVERY = 64           # ids between two checkpoints
BLOCK = 1 << 19      # ids after which a block ends, with the document that reaches them
WORDS = 1 << 20      # words that a worker remembers; when full it starts again
JOINED = 4096        # new words that are tokenised in one string
SLICE = 1 << 23      # bytes of text that are tokenised at a time, with the document that reaches them
BORDER = r"([a-z0-9À-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~])"    # Latin letter or digit, mark: the tokenizer parts these
COUNTED = 1 << 20    # ids that are counted at once
BLOCKS = "part int, block long, first long, n long, doc_ids array<long>, counts array<long>, bits binary, marks binary"


# ---- codes

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate((weights, packages))
        place = np.argsort(merged, kind="stable")
        merged = merged[place]
        levels.append(place < len(weights))
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codes:
    """Canonical codes from their lengths: shorter first, then by id; decoding looks up ``LIMIT`` bits at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.int64(1) << (LIMIT - self.lengths[order])
        firsts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (firsts >> (LIMIT - self.lengths[order])).astype(np.uint64)
        rest = (1 << LIMIT) - int(spans.sum())
        self.id_at = np.concatenate((np.repeat(order, spans), np.zeros(rest, order.dtype))).astype(np.uint32)
        self.bits_at = np.concatenate((np.repeat(self.lengths[order], spans), np.ones(rest, np.int64)))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of ``ids``, first bit highest, in 64-bit words, and the bit offsets of every ``EVERY``-th id."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, room = starts >> 6, 64 - (starts & 63) - bits
        code = self.codes[ids]
        over = room < 0
        high = np.where(over, code >> np.where(over, -room, 0).astype(np.uint64), code << np.where(over, 0, room).astype(np.uint64))
        words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        heads = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        words[word[heads]] = np.bitwise_or.reduceat(high, heads)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), starts[::EVERY].astype("<u8").tobytes()

    def decode(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block: all stretches between checkpoints advance together, one id per step."""
        words = np.concatenate((np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(EVERY * LIMIT // 64 + 2, np.uint64)))
        at = np.frombuffer(marks, "<u8").astype(np.int64)
        out = np.empty((len(at), EVERY), np.uint32)
        for step in range(EVERY):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            window = words[word] << off | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - off)
            top = (window >> np.uint64(64 - LIMIT)).astype(np.int64)
            out[:, step] = self.id_at[top]
            at = at + self.bits_at[top]
        return out.ravel()[:n]


# ---- tokenising

def _plain(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()


class Words:
    """Ids of texts by the tokenizer's vocabulary, word by word.

    The tokenizer drops white space and never looks across it, so a text's ids are those of the words between ASCII
    white space.  Texts are split and their distinct words found in Arrow; words seen before are not encoded again.  It
    lower-cases, and it parts letters from the marks behind them; A-Z are lower-cased and the marks cut off beforehand,
    so that fewer words are new: behind Latin letters and digits in Arrow, behind other letters word by word.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark already runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        model = json.loads(definition)["model"]
        self.ending = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ending[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True
        self.known: dict[str, int] = {}
        self.store = Store()

    def _hold(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.store.add(ids, lengths)

    def _learn(self, new: list[str]) -> None:
        parts, wanted = [], set()
        for word in new:
            if word.isalpha():
                wanted.add(word)
                continue
            core = word.rstrip(".,;:!?")
            if core and core != word and "<|" not in word and _plain(core)[-1].isalnum():
                parts.append((word, core, word[len(core):]))
                wanted.update(parts[-1][1:])
            else:
                wanted.add(word)
        plain, rest = [], []
        for word in wanted.difference(self.known):
            (plain if (word.isascii() or _plain(word).isalpha()) and word.isalpha() else rest).append(word)
        for at in range(0, len(plain), JOINED):
            some = plain[at:at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ending[ids]) + 1    # every word of letters alone ends once
            if len(ends) == len(some):
                self._hold(some, ids, np.diff(ends, prepend=0))
            else:
                rest += some
        found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        self._hold(rest, np.array(list(chain.from_iterable(found)), np.int32), np.array([len(x) for x in found], np.int64))
        places = np.array([self.known[p] for part in parts for p in part[1:]], np.int64)
        ids, bounds = self.store.take(places)
        self._hold([part[0] for part in parts], ids, np.diff(bounds[::2]))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of every text with ``END`` behind them, as bytes."""
        texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(pc.ascii_lower(texts), BORDER, r"\1 \2")))
        found = pc.list_flatten(lists).dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            self.store.cut(0)
            new = words
        self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, bounds = self.store.take(places[found.indices.to_numpy()])
        offsets = lists.offsets.to_numpy()
        ends = bounds[offsets[1:] - offsets[0]]
        data = np.insert(ids, ends, END).astype(self.kind)
        ends = np.concatenate(([0], ends + np.arange(1, len(ends) + 1))) * self.kind.itemsize
        if len(self.known) > WORDS:    # words of one slice of texts beyond the bound
            self.known.clear()
            self.store.cut(0)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data)])


@lru_cache(2)
def words(definition: str) -> Words:
    return Words(definition)


def _definition(vocabulary: str | None) -> str:
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        return file.read()


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) per row; ids are 16-bit (large vocabularies: 32-bit) little-endian integers, end id included."""
    sent = docs.sparkSession.sparkContext.broadcast(_definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(sent.value)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), coder.encode(batch.column(1).slice(i, j - i))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


# ---- files

def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Tokenise ``docs`` and write their ids in ascending doc_id order (nulls last) below ``path``.

    ``codes``: one row per id that occurs, with its code length.  ``blocks``: one row per block, in the order of (part,
    block): the ids before it in its part and in it, the documents' ids and numbers of ids, the bits, the checkpoints.  Each block decodes with the codes
    alone.  Both are written by Spark, so any store that Spark can reach will do.

    Texts are tokenised once, into a written table.  Counting and coding read it again: counts are summed per task and
    then per id, so no more than one number per id and task is shuffled, and one per id reaches the driver.  Ids are
    then dealt by ranges of doc_id, which tasks encode in order.  A task holds one block, that is ``BLOCK`` ids and the
    document that ends it.
    """
    spark = docs.sparkSession
    ids = written(token_ids(docs, vocabulary), "token-ids")
    kind = "<u2" if words(_definition(vocabulary)).kind.itemsize == 2 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = _joined(batch.column(0), kind)
            for at in range(0, len(found), COUNTED):
                total = _added(total, np.bincount(found[at:at + COUNTED]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, block = Codes(sent.value), TaskContext.get().partitionId(), 0
        names, held, n, first = [], [], 0, 0

        def row():
            payload, marks = codes.encode(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([[len(h) for h in held]], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([marks], pa.binary())],
                ["part", "block", "first", "n", "doc_ids", "counts", "bits", "marks"])

        for batch in batches:
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                names.append(name)
                held.append(np.frombuffer(data.as_py(), kind))
                n += len(held[-1])
                if n >= BLOCK:
                    yield row()
                    names, held, n, first, block = [], [], 0, first + n, block + 1
        if names:
            yield row()

    order = (F.col("doc_id").asc_nulls_last(), F.crc32("ids").asc())
    ids.withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        encode, BLOCKS) \
        .write.option("compression", "none").parquet(f"{path}/blocks")


def _joined(rows: pa.Array, kind: str) -> np.ndarray:
    """The ids of adjoining rows, one behind the other, without a copy."""
    if not len(rows) or not rows.buffers()[2]:
        return np.empty(0, kind)
    wide = "<i8" if pa.types.is_large_binary(rows.type) else "<i4"
    first, last = np.frombuffer(rows.buffers()[1], wide)[[rows.offset, rows.offset + len(rows)]].tolist()
    return np.frombuffer(rows.buffers()[2], np.uint8)[first:last].view(kind)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[:len(b)] += b
    return a


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start counts the ids of all documents before it.

    Blocks are decoded where they are read, and nothing is shuffled.  A block's start is the number of ids before it in
    its part, which it holds, and in the parts before, one number per task that wrote: these are broadcast.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    lengths = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toPandas()
    table = np.zeros(int(lengths["id"].max()) + 1 if len(lengths) else 0, np.uint8)
    table[lengths["id"].to_numpy(np.int64)] = lengths["bits"].to_numpy(np.uint8)
    sent = spark.sparkContext.broadcast(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(sent.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                n, names, counts = row["n"][0].as_py(), row["doc_ids"].flatten(), row["counts"].flatten().to_numpy()
                ids = codes.decode(row["bits"][0].as_py(), row["marks"][0].as_py(), n).astype("<u4")
                ends = np.cumsum(counts)
                pieces = [ids[e - c:e].tobytes() for c, e in zip(counts.tolist(), ends.tolist())]
                part = np.full(len(pieces), row["part"][0].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), names, pa.array(ends - counts + row["first"][0].as_py()), pa.array(pieces, pa.binary())],
                                                 ["part", "doc_id", "inside", "ids"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rows = blocks.mapInArrow(decode, "part int, doc_id long, inside long, ids binary")
    return rows.join(F.broadcast(parts), F.col("part") == F.col("p")).select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "ids")


def op8_token_files(docs: DataFrame) -> DataFrame:
    """Per document, from the files read back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty and have the end id alone.  Null doc_ids come last; rows that repeat a doc_id stand side by
    side in the order of their ids' checksums.  No documents: no blocks, no rows.  Further columns are not read.
    """
    path = scratch_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path) \
        .select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
