"""Alignment of two tokenizers by Arrow: ends of tokens that coincide cut a text into groups, and tokens of a group are linked."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Store, bounds_of, written

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
PIECE = 1 << 20          # characters that are aligned at a time; longer texts are cut where both tokenizers part
WORDS = 1 << 19          # words that a worker remembers; when full it starts again
LONGEST = 64             # characters of the longest word that is remembered
WIDE = 1024              # links of a group from which its tokens are counted by id first
HELD = 1 << 22           # id pairs that a task counts before it hands them on
BROADCAST = 1 << 22      # id pairs whose counts are broadcast, at most (13 bytes each, 55 MB); more are joined
ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


# ---- tokenising

def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


_SPACED = re.compile(r"[\s▁] ")
_PART = re.compile(r"(?<=[^\s▁]) ")    # the second tokenizer takes U+2581 for a space


def parts(text: str) -> list[str]:
    """What stands between the spaces of space + text at which both tokenizers part: those behind no white space."""
    if text[:1] == " " or _SPACED.search(text):
        first, *rest = _PART.split(" " + text)
        return [first[1:], *rest]
    return text.split(" ")


class Tokens:
    """Ids of space + text by both tokenizers.

    Neither tokenizer lets a token reach from a character that is no white space into a space behind it, so a text's
    ids are those of its parts, and parts seen before are not encoded again.  A vocabulary that has such tokens is
    noticed, and then whole texts are the parts.
    """

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark already runs a task per core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=second)
        table = _byte_level()
        names = [self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size())]
        self.bytes_a = [bytes(table[c] for c in name) if all(c in table for c in name) else name.encode() for name in names]
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = any(" " in t.lstrip() for t in (x.decode(errors="replace") for x in [*self.bytes_a, *self.bytes_b]))
        self.known: dict[str, int] = {}
        self.stores = (Store(), Store())

    def parts(self, text: str) -> list[str]:
        return [text] if self.whole else parts(text)

    def _store(self, side: int, lists: list[list[int]], skip: int = 0) -> None:
        ids = np.fromiter(chain.from_iterable(x[skip:] if skip else x for x in lists), np.int32)
        self.stores[side].add(ids, np.array([len(x) - skip for x in lists], np.int64))

    def _learn(self, new: list[str]) -> None:
        a = self.first.encode_batch_fast([" " + p for p in new], add_special_tokens=False)
        self._store(0, [x.ids for x in a])
        ahead = "" if self.whole else "x "    # an empty part alone would lose its space
        skip = 0 if self.whole else len(self.second.encode("x"))
        self._store(1, self.second.encode([ahead + p for p in new], num_threads=1), skip)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def encode(self, pieces: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By each tokenizer the ids of all pieces, which are lists of parts, and the bounds of the pieces among them."""
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            for store in self.stores:
                store.cut(0)
            new = set().union(*pieces)
        long = [p for p in new if len(p) > LONGEST]
        self._learn(list(new.difference(long)))
        kept = len(self.known)
        self._learn(long)
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64)
        ends = bounds_of([len(p) for p in pieces])
        out = []
        for store in self.stores:
            ids, bounds = store.take(words)
            out.append((ids, bounds[ends]))
            store.cut(kept)
        for p in long:
            del self.known[p]
        return out


@lru_cache(2)
def aligner(first: str, second: bytes) -> Aligner:
    return Aligner(Tokens(first, second))


# ---- alignment

@dataclass
class Aligned:
    """What is known of a text once some or all of its pieces are aligned."""

    fits: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    def row(self, kind: str) -> tuple:
        if not self.fits or not self.n_groups:
            return 0, 0, 0, 0, "", b"", b""
        pairs, times = self.pairs[0], self.times[0]
        if len(self.pairs) > 1:
            merged = counted(np.concatenate(self.pairs), np.concatenate(self.times))
            pairs, times = merged
        return self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), pairs.astype(kind).tobytes(), times.astype("<i8").tobytes()


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and how often they occur (each as often as ``times`` says)."""
    if times is None:
        table = pa.table({"key": keys}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    else:
        table = pa.table({"key": keys, "n": times}).group_by("key", use_threads=False).aggregate([("n", "sum")])
    keys, times = table["key"].to_numpy(), table["count_all" if times is None else "n_sum"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


class Aligner:
    """Groups, links and id pairs of many pieces of text at once, in Arrow."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.size_a, self.size_b = len(tokens.bytes_a), len(tokens.bytes_b)
        self.kind = "<u4" if self.size_a * self.size_b <= 1 << 32 else "<u8"
        self.spelling = tuple(pa.array(t, pa.binary()) for t in (tokens.bytes_a, tokens.bytes_b))
        self.length = tuple(pa.array([len(x) for x in t], pa.int64()) for t in (tokens.bytes_a, tokens.bytes_b))
        self.names = pa.array([f"{i}{mark}" for marks, n in ((",|", self.size_a), (",;", self.size_b)) for mark in marks for i in range(n)], pa.binary())

    def _measured(self, ids: np.ndarray, bounds: np.ndarray, side: int):
        """The ids of all pieces, the bounds of pieces, each id's piece, the byte of the piece at which it ends, and the pieces' bytes."""
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
        ids, piece = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(self.length[side].take(ids))
        before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(pa.array(bounds, pa.int64()))
        return ids, bounds, piece, pc.subtract(total, before.take(piece)), np.diff(before.to_numpy())

    @staticmethod
    def _bytes(table: pa.Array, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
        taken = table.take(ids)
        offsets = np.frombuffer(taken.buffers()[1], "<i4")[taken.offset:taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, "<i4")
        return memoryview(taken.buffers()[2] or b"").cast("B"), offsets    # Arrow's own view has signed bytes

    def _fitting(self, sides, plain: list[bytes]) -> np.ndarray:
        """Which pieces both tokenizers spell byte by byte."""
        wanted, whole = np.array([len(p) for p in plain], np.int64), b"".join(plain)
        fits = np.ones(len(plain), bool)
        for side, (ids, bounds, _, _, lengths) in enumerate(sides):
            same = lengths == wanted
            data, offsets = self._bytes(self.spelling[side], ids)
            if not same.all() or data[offsets[0]:offsets[-1]] != whole:
                cut = offsets[bounds]
                same &= np.array([data[i:j] == p for i, j, p in zip(cut[:-1].tolist(), cut[1:].tolist(), plain)], bool)
            fits &= same
        return fits

    def align(self, pieces: list[list[str]]) -> list[tuple | None]:
        """Per piece its numbers, the spelt groups, the linked id pairs and how often each is linked; None where it does not fit."""
        found = self.tokens.encode(pieces)
        sides = [self._measured(*f, side) for side, f in enumerate(found)]
        fits = self._fitting(sides, [b" " + " ".join(p).encode() for p in pieces])
        if not fits.all():
            many = [np.diff(bounds) for _, bounds in found]
            sides = [self._measured(ids[np.repeat(fits, n)], bounds_of(n * fits), side) for side, ((ids, _), n) in enumerate(zip(found, many))]
        (ids_a, cut_a, piece_a, end_a, _), (ids_b, cut_b, piece_b, end_b, _) = sides
        ends = [pa.table({"key": pc.add(pc.shift_left(piece, pa.scalar(40, pa.int64())), end), name: pa.array(np.arange(len(end)))})
                for name, piece, end in (("a", piece_a.cast(pa.int64()), end_a), ("b", piece_b.cast(pa.int64()), end_b))]
        common = ends[0].join(ends[1], "key", join_type="inner", use_threads=False)
        last_a, last_b = np.sort(common["a"].to_numpy()), np.sort(common["b"].to_numpy())
        ids_a, ids_b = ids_a.to_numpy().astype(np.int64), ids_b.to_numpy().astype(np.int64)
        from_a, from_b = np.concatenate(([0], last_a + 1)), np.concatenate(([0], last_b + 1))
        many_a, many_b = np.diff(from_a), np.diff(from_b)
        group_a, group_b = np.repeat(np.arange(len(last_a)), many_a), np.repeat(np.arange(len(last_b)), many_b)
        home = piece_a.to_numpy()[last_a]    # the piece of a group
        first = np.searchsorted(home, np.arange(len(pieces) + 1))
        links = bounds_of(many_a * many_b)[first]

        code = np.empty(len(ids_a) + len(ids_b), np.int64)    # A tokens of a group, then its B tokens, each with the mark behind it
        closing_a, closing_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        closing_a[last_a], closing_b[last_b] = self.size_a, self.size_b
        code[np.arange(len(ids_a)) + from_b[group_a]] = ids_a + closing_a
        code[np.arange(len(ids_b)) + from_a[group_b + 1]] = ids_b + closing_b + 2 * self.size_a
        data, offsets = self._bytes(self.names, pa.array(code))
        spelt = offsets[np.add(cut_a, cut_b)]

        keys, times = self._linked(ids_a, ids_b, from_a, from_b, many_a, many_b, group_a, home)
        space = self.size_a * self.size_b
        bounds = np.searchsorted(keys, np.arange(len(pieces) + 1) * space)
        out: list[tuple | None] = []
        for p, ok in enumerate(fits.tolist()):
            i, j = bounds[p], bounds[p + 1]
            out.append((int(cut_a[p + 1] - cut_a[p]), int(cut_b[p + 1] - cut_b[p]), int(first[p + 1] - first[p]), int(links[p + 1] - links[p]),
                        data[spelt[p]:spelt[p + 1] - 1], keys[i:j] - p * space, times[i:j]) if ok else None)
        return out

    def _linked(self, ids_a, ids_b, from_a, from_b, many_a, many_b, group_a, home):
        """Ascending keys (piece, A id, B id) of all links, and how many links each has.

        Groups of few links are written out; of the others, ids are counted first, so that no group is squared.
        """
        space = self.size_a * self.size_b
        wide = many_a * many_b > WIDE
        times = np.where(wide, 0, many_b)[group_a]    # each A token meets the B tokens of its group
        start = np.repeat(from_b[group_a] - bounds_of(times)[:-1], times)
        b = ids_b[start + np.arange(len(start))]
        keys, counts = counted(np.repeat(home[group_a] * space + ids_a * self.size_b, times) + b)
        for g in np.flatnonzero(wide).tolist():
            (a, n), (b, m) = (np.unique(ids[start[g]:start[g + 1]], return_counts=True) for ids, start in ((ids_a, from_a), (ids_b, from_b)))
            keys = np.concatenate((keys, (home[g] * space + a[:, None] * self.size_b + b).ravel()))
            counts = np.concatenate((counts, (n[:, None] * m).ravel()))
        return counted(keys, counts) if wide.any() else (keys, counts)

    def rows(self, texts: Iterator[str | None]) -> Iterator[tuple]:
        """A row of ``Aligned`` per text, in order."""
        waiting: list[tuple[Aligned, list[str]]] = []
        done: list[Aligned] = []
        size = 0

        def work() -> None:
            for (state, _), got in zip(waiting, self.align([p for _, p in waiting])):
                if got is None:
                    state.fits = False
                else:
                    if state.n_groups:
                        state.digest.update(b";")
                    state.n_a, state.n_b, state.n_groups, state.n_links = (x + y for x, y in zip((state.n_a, state.n_b, state.n_groups, state.n_links), got))
                    state.digest.update(got[4])
                    state.pairs, state.times = [*state.pairs, got[5]], [*state.times, got[6]]
                    if len(state.pairs) > 16:
                        merged = counted(np.concatenate(state.pairs), np.concatenate(state.times))
                        state.pairs, state.times = [merged[0]], [merged[1]]
            waiting.clear()

        for text in texts:
            state = Aligned()
            done.append(state)
            if text:
                all_parts = self.tokens.parts(text)
                if len(text) <= PIECE:
                    waiting.append((state, all_parts))
                    size += len(text)
                else:
                    at = 0
                    for i, part in enumerate(all_parts):
                        size += len(part) + 1
                        if size >= PIECE or i + 1 == len(all_parts):
                            waiting.append((state, all_parts[at:i + 1]))
                            at = i + 1
                            if size >= PIECE:
                                work()
                                size = 0
            if size >= PIECE:
                work()
                size = 0
            if not waiting:
                yield from (s.row(self.kind) for s in done)
                done = []
        if waiting:
            work()
        yield from (s.row(self.kind) for s in done)


# ---- tables

def _binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and the bounds of its rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), bounds_of([len(v) // np.dtype(kind).itemsize for v in values])


def align(docs: DataFrame, first: str | None = None, second: str | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Space + text is encoded by both tokenizers (paths ``first`` and ``second``).  Bytes at which a token of each ends
    cut the tokens into groups; tokens of a group are linked.  A pair of ids counts the rows of the corpus that hold it
    linked.  n_best are the links whose count is the highest of their first id, ties included; count_sum adds the counts
    of all links.  Texts that are null or empty, or that a tokenizer does not spell byte by byte, have zeros and ''.

    Method: texts are aligned where they lie, about a million characters at a time, in Arrow: token lists are
    flattened with their parent indices, byte ends are segmented running sums, a hash join on (piece, end) finds the
    ends that coincide, and links are grouped by (piece, pair).  The distinct pairs of a text are written, not sent.
    Tasks count them over their rows by grouping, and Spark merges these counts per pair.  The counts, one row per pair
    that occurs, are broadcast if at most ``broadcast``; beyond, the pairs of texts are joined with them, which
    adaptive execution splits where a pair is hot.

    A text longer than that is cut where both tokenizers part, at spaces; one part is never cut, so a task holds a
    piece or the longest stretch without such a space.  A group of many tokens is counted by id, so copies of an id
    are never paired one by one.  Rows that repeat a doc_id, or have none, are rows of their own, and rows that repeat
    a text count each.  Further columns are not read.  No documents: no rows.
    """
    spark = docs.sparkSession
    with open(first or public_tokenizers.path(FIRST), encoding="utf-8") as file, open(second or public_tokenizers.path(SECOND), "rb") as model:
        sent = spark.sparkContext.broadcast((file.read(), model.read()))
    size_b, kind = aligner(*sent.value).size_b, aligner(*sent.value).kind

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, n = aligner(*sent.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, size = [], 0
            names = batch.column(0)

            def out():
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays(
                    [names.slice(at - len(rows), len(rows)), pa.array(range(n + at - len(rows), n + at), pa.int64()), *[pa.array(c, pa.int64()) for c in columns[:4]],
                     pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.binary())],
                    ["doc_id", *[c.split()[0] for c in ALIGNED.split(", ")]])

            at = 0
            for at, row in enumerate(worker.rows(t.as_py() for t in batch.column(1)), 1):
                rows.append(row)
                size += len(row[5]) + len(row[6])
                if size > 1 << 24:
                    yield out()
                    rows, size = [], 0
            if rows:
                yield out()
            n += batch.num_rows

    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(texts, f"doc_id long, {ALIGNED}"), "aligned")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int64()), pa.array(held[0][1], pa.int64())], ["pair", "docs"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                pairs = _binary(batch.column(0).slice(at, 1024), kind)[0].astype(np.int64)
                held.append(counted(pairs))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield out()
                        held = []
        if held:
            held = [merged()]
            yield out()

    counts = found.select("pairs").mapInArrow(count, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    counts = counts.join(counts.groupBy("a").agg(F.max("docs").alias("most")), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    counts = written(counts, "pair-best")
    if counts.count() <= broadcast:
        out = _looked_up(found, counts, kind)
    else:
        out = _joined(found, counts, kind)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looked_up(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    table = counts.toPandas().sort_values("pair")
    sent = found.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(kind), table["docs"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                (pairs, bounds), (times, _) = _binary(part.column("pairs"), kind), _binary(part.column("times"), "<i8")
                place = np.searchsorted(known, pairs)
                sums = [bounds_of(x)[bounds] for x in (times * best[place], times * docs[place])]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(np.diff(s), pa.int64()) for s in sums]], [*kept, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return found.select(*kept, "pairs", "times").mapInArrow(score, schema)


def _joined(found: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                (pairs, bounds), (times, _) = _binary(part.column("pairs"), kind), _binary(part.column("times"), "<i8")
                rows = np.repeat(part.column("row").to_numpy(), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs.astype(np.int64)), pa.array(times)], ["row", "pair", "times"])

    links = found.select("row", "pairs", "times").mapInArrow(spread, "row long, pair long, times long").join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return found.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op11_token_alignment(docs: DataFrame) -> DataFrame:
    return align(docs)
