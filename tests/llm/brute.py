"""Brute-force versions of the operators, for small tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def join_up(nodes, pairs):
    """Smallest node reachable, by node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def simhash_groups(rows):
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 3)]
    found = join_up(ids, pairs)
    return {(i, f"{prints[i]:016x}", found[i]) for i in ids}


def embedding_links(rows, least=0.93):
    """vec_id: (links, component) from (vec_id, vector, label)."""
    fit = [(i, np.array(v, float), lab) for i, v, lab in rows
           if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float) != 0)]
    links, pairs = defaultdict(int), []
    for a, (i, x, m) in enumerate(fit):
        for j, y, n in fit[a + 1:]:
            if m == n and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    found = join_up([r[0] for r in rows], pairs)
    return {i: (links[i], found[i]) for i in found}


def windows_removed(rows, width=50):
    """doc_id: (words, removed, kept words) by every window of every document."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for at in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][at:at + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for at in range(len(w) - width + 1):
            if first[tuple(w[at:at + width])] < i:
                gone[at:at + width] = [True] * width
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
