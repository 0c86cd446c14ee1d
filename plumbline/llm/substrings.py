"""Substring deduplication by suffix automata over the passages that documents may share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage
from plumbline.llm.common import sieve, sifted, written

WINDOW = 50     # words that a repeated passage has at least
ANCHOR = 32     # words of an anchor; every window holds one
SHARD = 256     # contexts of one automaton; more go by their windows' hashes
ROWS = 1 << 14  # rows that are returned at a time
FREE = WINDOW - ANCHOR
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


# ---- one document

def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, (text or "").encode().split()), np.uint64)


def _rolling(x: np.ndarray, width: int, of: np.ufunc, blank: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, from running ones to both sides of each block."""
    n, m = len(x), -(-len(x) // width) * width
    block = np.full(m, blank, np.uint64)
    block[:n] = x
    block = block.reshape(-1, width)
    up = of.accumulate(block, axis=1).ravel()
    down = of.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(down[:n - width + 1], up[width - 1:n])


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words [start, end), whatever stands before them."""
    n = len(hashes)
    back = np.full(n, BACK, np.uint64)
    back[:1] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(back))))
    ahead = np.full(n, BASE, np.uint64)
    ahead[:1] = 1
    mixed = (total[ends] - total[starts]) * np.cumprod(ahead)[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE)
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document: of every window, the run of ``ANCHOR`` words with the least hash.

    Which run that is depends on the window's words alone, so equal windows have an equal anchor at the same place.
    """
    n = len(hashes)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = span_hashes(hashes, np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1))
    runs ^= runs >> np.uint64(32)
    least = _rolling(runs, FREE + 1, np.minimum, (1 << 64) - 1)
    edge = np.zeros(FREE, np.uint64)
    chosen = np.flatnonzero(_rolling(np.concatenate((edge, least, edge)), FREE + 1, np.maximum, 0) == runs)
    return chosen, runs[chosen]


class Automaton:
    """Suffix automaton of several word sequences: knows every run of words that one of them holds."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]

    def _state(self, long: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.long.append(long)
        return len(self.long) - 1

    def _split(self, parent: int, word: int, state: int) -> int:
        """A state for the shorter runs of ``state``, those that continue ``parent`` by one word."""
        part = self._state(self.long[parent] + 1)
        self.step[part] = self.step[state].copy()
        self.link[part], self.link[state] = self.link[state], part
        while parent >= 0 and self.step[parent].get(word) == state:
            self.step[parent][word] = part
            parent = self.link[parent]
        return part

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            known = self.step[last].get(word)
            if known is not None:
                last = known if self.long[known] == self.long[last] + 1 else self._split(last, word, known)
                continue
            state, parent = self._state(self.long[last] + 1), last
            while parent >= 0 and word not in self.step[parent]:
                self.step[parent][word] = state
                parent = self.link[parent]
            if parent >= 0:
                follow = self.step[parent][word]
                self.link[state] = follow if self.long[follow] == self.long[parent] + 1 else self._split(parent, word, follow)
            last = state

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of the sequence covered by runs of at least ``least`` words that the automaton knows.

        Matching statistics: the longest known run that ends at each word, carried from word to word.
        """
        out: list[tuple[int, int]] = []
        state = run = 0
        for at, word in enumerate(sequence):
            while state and word not in self.step[state]:
                state = self.link[state]
                run = self.long[state]
            follow = self.step[state].get(word)
            state, run = (follow, run + 1) if follow is not None else (0, 0)
            if run >= least:
                start = at + 1 - run
                if out and out[-1][1] >= start:
                    out[-1] = (min(out[-1][0], start), at + 1)
                else:
                    out.append((start, at + 1))
        return out


# ---- the corpus

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, anchor, context, start, size) of every anchor; its context holds all windows with the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["doc_id", "row", "anchor", "context", "start", "size"], [], 0
        for batch in batches:
            texts, ids, rows = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for at in range(batch.num_rows):
                hashes = word_hashes(texts[at].as_py())
                place, found = anchors(hashes)
                if len(place):
                    start, end = np.maximum(0, place - FREE), np.minimum(len(hashes), place + WINDOW)
                    held.append((np.full(len(place), ids[at]), np.full(len(place), rows[at]), found.view(np.int64),
                                 span_hashes(hashes, start, end).view(np.int64), start.astype(np.int32), (end - start).astype(np.int32)))
                    n += len(place)
                if n >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    rows = _keyed(docs).where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, row long, anchor long, context long, start int, size int")


def _passages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, context, first, words): the hashed words of each wanted context, fetched from one of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                hashes = word_hashes(batch.column("text")[at].as_py())
                spots = batch.column("spots")[at].values
                words = [hashes[a:a + n].tobytes() for a, n in zip(spots.field("start").to_pylist(), spots.field("size").to_pylist())]
                yield pa.RecordBatch.from_arrays([spots.field("anchor"), spots.field("context"), spots.field("first"), pa.array(words, pa.binary())],
                                                 ["anchor", "context", "first", "words"])

    per = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "context", "first", "start", "size")).alias("spots")).withColumnRenamed("row", "key")
    per = cut_lineage(per)
    some = sifted(_keyed(docs).select("row", "text"), "row", sieve(per), "hit").where("hit").dropDuplicates(["row"])
    return some.join(per, F.col("row") == F.col("key")).select("text", "spots").mapInArrow(run, "anchor long, context long, first long, words binary")


def _by_automata(passages: DataFrame) -> DataFrame:
    """(anchor, context, s, e): stretches of a context that are in contexts of smaller documents under its anchor."""
    def shard(rows: pa.Table) -> list[tuple[int, int, int, int]]:
        known, out = Automaton(), []
        waiting, doc = [], None
        for anchor, context, first, words in zip(*(rows[c].to_pylist() for c in ("anchor", "context", "first", "words"))):
            words = np.frombuffer(words, np.uint64).tolist()
            if first != doc:
                for sequence in waiting:
                    known.add(sequence)
                waiting, doc = [], first
            waiting.append(words)
            out += [(anchor, context, s, e) for s, e in known.spans(words, WINDOW)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            rows = pa.Table.from_batches(held)
            cuts = np.flatnonzero(np.diff(rows["anchor"].to_numpy())) + 1
            found = [x for a, b in zip([0, *cuts], [*cuts, len(rows)]) if b - a > 1 for x in shard(rows.slice(a, b - a))]
            columns = list(zip(*found)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                              ["anchor", "context", "s", "e"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut or (held and held[-1].column("anchor")[-1].as_py() != anchor[0]):
                whole = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
                if whole:
                    yield flush(whole)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(held)

    return passages.repartition("anchor").sortWithinPartitions("anchor", "first", "context").mapInArrow(run, "anchor long, context long, s int, e int")


def _by_windows(passages: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts, by the smallest document of each window of each context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("words")[at].as_py(), np.uint64)
                s = np.arange(len(hashes) - WINDOW + 1)
                same = lambda name: pa.array(np.full(len(s), batch.column(name)[at].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same("anchor"), same("context"), same("first"), pa.array(s.astype(np.int32)),
                                                  pa.array(span_hashes(hashes, s, s + WINDOW).view(np.int64))], ["anchor", "context", "first", "s", "window"])

    windows = cut_lineage(passages.mapInArrow(run, "anchor long, context long, first long, s int, window long"))
    least = windows.groupBy("anchor", "window").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").drop("most")
    found = windows.join(least, ["anchor", "window"]).where("least < first").select("anchor", "context", "s", (F.col("s") + WINDOW).alias("e"))
    return cut_lineage(found)    # a plan of its own: adaptive execution can split its join where a window is hot


def repeated_spans(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(row, spans): per document that repeats something, the word spans that windows of smaller documents cover."""
    places = written(_occurrences(docs), "anchors")
    shared = cut_lineage(places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(F.col("anchor").alias("key")))
    near = sifted(places, "anchor", sieve(shared), "hit").where("hit").drop("hit")
    near = written(near.join(shared, F.col("anchor") == F.col("key")).drop("key"), "shared-anchors")
    contexts = near.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    contexts = cut_lineage(contexts)
    sizes = contexts.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1").withColumnRenamed("anchor", "key")
    named = contexts.join(sizes, F.col("anchor") == F.col("key"), "left").where("many > 1 OR first < last").drop("key", "last")
    hits = cut_lineage(near.join(named, ["anchor", "context"]))
    own = hits.where("many > 1 AND doc_id = first")
    wanted = cut_lineage(own.groupBy("anchor", "context", "first", "many").agg(F.min_by(F.struct("row", "start", "size"), F.struct("row", "start")).alias("x"))
                         .select("anchor", "context", "first", "many", "x.*"))
    found = _by_automata(_passages(docs, wanted.where(F.col("many") <= shard)))
    large = wanted.where(F.col("many") > shard)
    if not large.isEmpty():
        found = found.union(_by_windows(_passages(docs, large)))
    spans = own.join(found, ["anchor", "context"]).select("row", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e")) \
        .union(hits.where("first < doc_id").select("row", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e")))
    return spans.distinct().groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def dedup_substrings(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``docs`` with repeated passages removed from each text, and n_words and n_removed appended.

    Words are parted by ASCII white space and compared as they are.  A word goes when some ``WINDOW`` consecutive words
    of its document that cover it also stand in a document with a smaller doc_id; windows are those of the input.  The
    kept words are joined by one space.

    Method: the reference of a document are the documents with smaller ids, held in suffix automata by shards.  A shard
    is the passages around one anchor; every window holds an anchor that depends on its words alone, so equal windows
    meet in one shard, and the shards go to the tasks that stream the passages instead of each to every task, which
    would grow with the square of the corpus.  A shard takes its passages in the order of doc_id: matching statistics
    against the automaton so far give the maximal spans of at least ``WINDOW`` words, then the passage is added.

    Anchors of one document only are dropped first, equal contexts of an anchor are merged with their smallest
    document, and a context that a smaller document has is removed whole.  An anchor with more than ``shard`` different
    contexts, a passage that very many documents quote, is too much for one task: its contexts are judged by the
    smallest document of each of their windows, an aggregate that splits by window.  Both ways are exact.

    Null texts have no words and become empty, as do empty ones.  Rows with a null doc_id have no smaller document, are
    none, and keep their words.  Rows that repeat a doc_id do not remove each other's words.  Spans of a document
    come back as one list, no longer than the document.  Columns named n_words or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "text")]
    gone = written(repeated_spans(docs, shard).withColumnRenamed("row", "key"), "spans")
    rows = sifted(docs.select(*rest, "text", F.xxhash64("doc_id", "text").alias("__row")), "__row", sieve(gone), "__hit")
    hit = rows.where("__hit").join(gone.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), F.col("__row") == F.col("__key"), "left")
    missed = rows.where("NOT __hit").withColumn("__spans", F.lit(None).cast("array<struct<s:int,e:int>>"))
    both = hit.select(*rest, "text", "__spans").unionByName(missed.select(*rest, "text", "__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                texts, n, removed = [], [], []
                for at in range(batch.num_rows):
                    words = (batch.column("text")[at].as_py() or "").encode().split()
                    spans = batch.column("__spans")[at]
                    n.append(len(words))
                    if spans.is_valid:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, spans.values.field("s").to_numpy(), 1)
                        np.add.at(edge, spans.values.field("e").to_numpy(), -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        words = [w for w, c in zip(words, covered.tolist()) if not c]
                    removed.append(n[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                                                 [*rest, "text", "n_words", "n_removed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    done = both.mapInArrow(run, f"{schema}, text string, n_words long, n_removed long")
    return done.select(*[c for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
