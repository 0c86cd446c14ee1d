"""Byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = 1 << 18      # pre-tokens that a worker remembers
STRETCHES = 1 << 16   # stretches between spaces that it remembers
LONGEST = 64          # characters of the longest string that is remembered
ROWS = 64             # rows that are returned at a time
OTHER = "\uffff"      # never assigned: neither letter nor number nor white space


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: slot(key) is a bijection of the set to 0 .. n - 1.

    Keys fall into buckets by one half of a 128-bit hash; every bucket, largest first, gets the first displacement that
    sends its keys to free slots.  Other keys land anywhere, so a hit is confirmed by comparing with the slot's key.
    """

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            both = xxhash.xxh3_128_intdigest(key)
            groups.setdefault((both >> 64) % self.buckets, []).append((both & 0xFFFFFFFFFFFFFFFF, key))
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            shift = 0
            while True:
                slots = [self._slot(low, shift) for low, _ in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for slot, (_, key) in zip(slots, members):
                self.keys[slot] = key

    def _slot(self, low: int, shift: int) -> int:
        low = (low ^ (shift * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((low ^ (low >> 31)) * 0xD6E8FEB86659FD93 >> 16 & 0xFFFFFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for a key outside the set."""
        if not self.n:
            return -1
        both = xxhash.xxh3_128_intdigest(key)
        slot = self._slot(both & 0xFFFFFFFFFFFFFFFF, self.shift[(both >> 64) % self.buckets])
        return slot if self.keys[slot] == key else -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def newer_letters(kinds: str = r"[\p{L}\p{N}]") -> str:
    """A class of the code points that ``regex`` takes for letters or numbers and tiktoken, by its own tables, does not.

    The libraries follow different versions of Unicode.  tiktoken is asked which code points its pattern finds.
    """
    import tiktoken
    every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000)))
    finder = tiktoken.Encoding("kinds", pat_str=kinds, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    theirs = set(bytes(finder.encode_ordinary(every)).decode())
    points = np.array([ord(c) for c in regex.findall(kinds, every) if c not in theirs], np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]" if runs else "(?!)"


class Remembered(dict):
    """Encoded strings of one worker, the first ``most`` of up to ``LONGEST`` characters that it meets.

    Others are encoded each time, so that its memory is bounded whatever the texts are.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, text: str) -> bytes:
        found = self.encode(text)
        if len(self) < self.most and len(text) <= LONGEST:
            self[text] = found
        return found


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranks, with the pattern that splits texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern, self.table, self.newer = ranks, pattern, PerfectHash(ranks), newer_letters()
        self._prepare()

    def _prepare(self):
        self.ids = [self.ranks[k].to_bytes(4, "little") for k in self.table.keys]
        self.bytes_of = np.empty(max(self.ranks.values(), default=-1) + 1, object)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.pairs = [-1] * (1 << 16)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.split, self.unknown = regex.compile(self.pattern), regex.compile(self.newer)
        self.run_on = regex.compile(r"\s | \s")
        self.pieces, self.stretches = Remembered(lambda p: self.pre_token(p.encode()), PIECES), Remembered(self._pieces, STRETCHES)

    def __getstate__(self):
        return self.ranks, self.pattern, self.table, self.newer

    def __setstate__(self, state):
        self.ranks, self.pattern, self.table, self.newer = state
        self._prepare()

    def pre_token(self, piece: bytes) -> bytes:
        """Ids of one pre-token: the vocabulary's own entry, or the merges of its bytes."""
        slot = self.table.slot(piece)
        return self.ids[slot] if slot >= 0 else np.array(self._merge(piece), "<u4").tobytes()

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is in the vocabulary.

        Parts are a linked list over the bytes.  The heap holds a rank and the start of its pair in one number; an
        entry is stale when the pair that starts there has another rank by now.
        """
        n, rank_of = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [self.pairs[a << 8 | b] for a, b in zip(piece, piece[1:])] + [-1]
        heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            if pair[i] != top >> 40:
                continue
            middle = after[i]
            stop = after[i] = after[middle]
            pair[middle], pair[i] = -1, -1
            if stop < n:
                before[stop] = i
                pair[i] = r = rank_of(piece[i:after[stop]], -1)
                if r >= 0:
                    heappush(heap, r << 40 | i)
            left = before[i]
            if left >= 0:
                pair[left] = r = rank_of(piece[left:stop], -1)
                if r >= 0:
                    heappush(heap, r << 40 | left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def _split(self, text: str) -> list[str]:
        """The pattern's matches, with letters and numbers as tiktoken knows them."""
        if text.isascii() or not self.unknown.search(text):
            return self.split.findall(text)
        return [text[m.start():m.end()] for m in self.split.finditer(self.unknown.sub(OTHER, text))]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self._split(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit little-endian integers.

        The pattern takes at most one space in front of a word and nothing behind it, so a text may be cut before every
        space that has no other white space beside it; the stretches between are remembered whole.
        """
        if self.run_on.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self.stretches[first] + b"".join(map(self.stretches.__getitem__, [" " + r for r in rest]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.bytes_of[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(2)
def tokenizer(path: str) -> ByteBPE:
    with open(path, "rb") as file:
        return ByteBPE(read_ranks(file.read()))


def tokenise(docs: DataFrame, vocabulary: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with n_tokens, ids (32-bit little-endian, binary) and decoded (binary).

    The text (null: empty) is split by the pattern; each pre-token is encoded on its own, without special tokens: by the
    minimal perfect hash where the vocabulary holds it whole, else by merging its bytes.  The ids are decoded again.

    The driver reads the vocabulary file and builds the tables, about 3 MB, which are broadcast.  Rows are worked on one
    by one where they are read; nothing is shuffled.  A worker holds a few texts and the remembered strings,
    ``PIECES`` and ``STRETCHES`` at most.  Repeated rows stay; further columns than ``keep`` are not read; no rows give none.
    """
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer(vocabulary or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [coder.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())],
                    [*keep, "n_tokens", "ids", "decoded"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(run, f"{schema}, n_tokens long, ids binary, decoded binary")


def op7_byte_bpe(docs: DataFrame) -> DataFrame:
    return tokenise(docs).selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
