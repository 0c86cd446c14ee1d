"""Document operators against brute force on texts with every oddity: null, empty, blank, long, repeated, tied."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from plumbline.llm import byte_bpe, lines, mixing, quality, simhash, substrings, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, h1 string, row long, key int, fp string, size int, copies int, first int"


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x", 2, 3, "y", 4, 5, 6) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    base, passage = words(1, 300), words(2, 60)
    near = [*base[:150], "changed", *base[151:]]
    out = [(0, None, "a"), (1, "", "a"), (2, " \n\t\x0b", None), (3, "one", "b"), (4, "One TWO", "b"), (5, "one two three", ""), (6, "ONE two\nthree", "b"),
           (7, " ".join(base), "a"), (8, " ".join(base), "a"), (9, " ".join(near), "a"), (10, " ".join(words(3, 80) + passage + words(4, 70)), "b"),
           (11, " ".join(words(5, 30) + passage + words(6, 90)), None), (12, " ".join(passage[:50]), "c"), (13, " ".join(passage[:49]), "c"),
           (14, " ".join(["again"] * 400), "c"), (15, " ".join(["again"] * 120 + words(7, 30)), "c"), (16, " ".join(words(8, 20000)), "big"),
           (17, "x\x85y\xa0z　q \x1c É́", "é"), (18, "\n".join(" ".join(words(9, 12)) + str(k) for k in range(40)), "d"),
           (19, "tie tie tie\ntie tie tie\n\ntie tie tie", "d"), (20, "a" * 5000, "d"), (21, "a" * 5001 + "\n" + "a" * 4999 + "b", "d")]
    return [*out, *[(30 + k, " ".join(words(100 + k, 20 + k)), f"s{k % 7}") for k in range(40)]]


def test_simhash(spark, rows):
    want = brute.simhash_groups([r[:2] for r in rows])
    for group in (simhash.GROUP, 2):
        got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows), group).collect()}
        assert got == want
    zero = {r[2] for r in want if r[1] == "0" * 16}
    assert zero == {0}


def test_simhash_of_dense_groups(spark):
    draw, start = random.Random(5), 0x0123456789ABCDEF
    prints = {start}
    while len(prints) < 300:    # many fingerprints around one, so that groups are cut twice
        prints.add(start ^ sum(1 << b for b in draw.sample(range(64), 3)) if len(prints) % 3 else draw.getrandbits(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4).collect()
    got = brute.join_up(signed, [(r.a, r.b) for r in links])
    want = brute.join_up(signed, [(a, b) for a in signed for b in signed if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3])
    assert got == want and len(set(want.values())) < len(signed)


def test_near_copies_with_odd_ids(spark, rows):
    odd = [*rows, (None, "one", "b"), (3, "one", "b"), (None, " ".join(words(77, 50)), "z")]
    kept = simhash.drop_near_copies(frame(spark, odd))
    assert kept.columns == frame(spark, odd).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 7} <= set(ids) and not {1, 2, 8} & set(ids)
    named = {r[2] for r in brute.simhash_groups([r[:2] for r in rows])}
    assert set(ids) - {None} == named


def test_substrings(spark, rows):
    want = brute.windows_removed([r[:2] for r in rows])
    for shard in (substrings.SHARD, 1):
        out = substrings.dedup_substrings(frame(spark, rows), shard)
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()}
        assert got == {i: (n, gone, " ".join(kept)) for i, (n, gone, kept) in want.items()}
    assert got[11][1] == 60 and got[12][1] == 50 and got[13][1] == 0 and got[8][1] == 300
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "n_words", "n_removed"]


def test_substrings_with_odd_ids(spark):
    text = " ".join(words(1, 60))
    out = substrings.dedup_substrings(frame(spark, [(None, text, "a"), (5, text, "a"), (5, text, "a"), (5, text + " end", "a"), (6, text, "a")]))
    assert sorted((r.doc_id or 0, r.n_removed) for r in out.collect()) == [(0, 0), (5, 0), (5, 0), (5, 0), (6, 60)]


def test_near_copies_without_ids_and_with_repeated_ids(spark):
    """Every group keeps one row, whatever the ids: rows without an id in groups of their own all stay."""
    alone = [" ".join(words(200 + k, 60)) for k in range(6)]
    shared, other = " ".join(words(301, 80)), " ".join(words(302, 80))
    rows = [*[(None, t, "a") for t in alone], (None, alone[0], "a"), (None, shared, "b"), (4, shared, "b"), (9, shared, "b"), (9, other, "b"), (9, other, "b"), (None, None, "c")]
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.drop_near_copies(frame(spark, rows).repartition(5)).collect())
    assert kept == sorted([*[(0, t) for t in alone], (4, shared), (9, other), (0, "")])


def brute_lines(rows):
    seen = [(i, p, x) for i, t in rows if t is not None for p, x in enumerate(t.split("\n"))]
    visible = sorted(x for x in seen if x[2].strip(" \t\n\x0b\f\r"))
    gone = set()
    for n, (i, p, x) in enumerate(visible):
        for _, _, y in visible[:n]:
            if x == y or abs(len(x) - len(y)) <= 1 and min(len(x), len(y)) >= lines.LEAST and (x[:4] == y[:4] or x[-4:] == y[-4:]) and brute.edits(x, y) <= 1:
                gone.add((i, p))
                break
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_lines(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdé ") for _ in range(n)) for n in (9, 10, 11, 30, 57, 200, 900)]

    def edit(x):
        at = draw.randrange(len(x))
        return [x[:at] + x[at + 1:], x[:at] + "#" + x[at:], x[:at] + "#" + x[at + 1:]][draw.randrange(3)]

    texts = [None, "", "\n\n", " \t", "short\nshoru", *["\n".join(draw.choice([x, edit(x), edit(edit(x))]) for x in draw.sample(base, 3)) for _ in range(60)]]
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    out = lines.dedup_lines(frame(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines([r[:2] for r in rows])
    counts = {r.doc_id: (r.n_lines, r.n_removed) for r in out.collect()}
    assert counts[0] == (0, 0) and counts[1] == (1, 0) and counts[2] == (3, 0) and counts[4] == (2, 0)
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "n_lines", "n_removed"]


def test_lines_long_and_repeated(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long, "a"), (2, "new line here\n" + long[:30_000] + "#" + long[30_001:], "a"), (2, "new line here\nother words now", "a"),
            (None, "new line here", "a"), (3, long[1:] + "\nnew line herd", "a"), (3, long[1:] + "\nnew line herd", "a")]
    got = sorted((r.doc_id or 0, r.n_removed, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect())
    of_two = [[(2, 0, "new line here\nother words now"), (2, 2, "")], [(2, 1, "new line here"), (2, 1, "other words now")]]    # either may be first
    assert got in [[(0, 1, ""), (1, 0, long), *two, (3, 2, ""), (3, 2, "")] for two in of_two]


def test_lines_of_rows_without_ids(spark, monkeypatch):
    """Copies without ids, or with one id, go but for one; what comes back to a row is no longer than the row."""
    rows = [*[(None, "one line of words\nand another one", "a") for _ in range(50)], *[(7, "a line of seven", "a") for _ in range(20)],
            *[(None, f"text number {'abcdefghij'[k % 10] * 9}{'klmnopqrst'[k // 10] * 9}", "a") for k in range(100)], (3, "one line of words", "a"), (9, None, "a")]
    out = lines.dedup_lines(frame(spark, rows).repartition(4)).collect()
    assert len(out) == len(rows) and sum(r.n_removed for r in out if r.doc_id is None) == 50 + 49 and sum(r.n_removed for r in out if r.doc_id == 7) == 19
    assert sorted(r.text for r in out if r.doc_id is None and r.text.startswith("text")) == sorted(t for _, t, _ in rows if t and t.startswith("text"))
    docs = lines._numbered(frame(spark, rows))
    assert docs.select("__number").distinct().count() == len(rows)


def one_word_apart(x, y, word):
    """One word of up to ``word`` characters is changed, added or left out, in lines of enough words."""
    x, y = sorted((x.split(" "), y.split(" ")), key=len)
    if len(x) < lines.WORDS or len(y) - len(x) > 1:
        return False
    if len(x) == len(y):
        other = [(a, b) for a, b in zip(x, y) if a != b]
        return len(other) == 1 and max(map(len, other[0])) <= word
    return any(len(y[i]) <= word and y[:i] + y[i + 1:] == x for i in range(len(y)))


def test_lines_a_word_apart(spark):
    draw = random.Random(11)
    base = [" ".join("".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 12))) for _ in range(n)) for n in (5, 6, 7, 12, 60)]

    def edit(x):
        w = x.split(" ")
        at = draw.randrange(len(w))
        new = [draw.choice(["other", "longer word", "far", "toolongaword", "", "exactlyx"])]
        return " ".join([w[:at] + w[at + 1:], w[:at] + new + w[at:], w[:at] + new + w[at + 1:]][draw.randrange(3)])

    texts = ["\n".join(draw.choice([x, edit(x), edit(edit(x))]) for x in draw.sample(base, 3)) for _ in range(40)]
    seen = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n"))]

    def one_edit_apart(x, y):
        x, y = sorted((x, y), key=len)
        same = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
        return len(x) >= lines.LEAST and (x[same + 1:] == y[same + 1:] if len(x) == len(y) else len(y) - len(x) == 1 and x[same:] == y[same + 1:])

    near = lambda x, y, word: x == y or one_edit_apart(x, y) or word and one_word_apart(x, y, word)
    counts = []
    for word in (0, 3, 8):
        gone = {(i, p) for n, (i, p, x) in enumerate(seen) if any(near(x, y, word) for _, _, y in seen[:n])}
        want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)}
        assert {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), word).collect()} == want
        counts.append(len(gone))
    assert counts[0] < counts[1] < counts[2]


def fill(sizes, weights=(3, 1, 2)):
    """Targets by sharing the excess again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    rest = 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s] * (1 + 1e-12)}
        if not full:
            return {**target, **share}
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(spark, rows):
    out = mixing.copies(frame(spark, rows)).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").encode().split()])
    want = fill(sizes)
    assert len(out) == len(rows) and all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) for r in out)
    assert all(0 <= r.copies <= 2 for r in out)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 2 * max(r.size for r in own)
    assert sorted(map(str, out)) == sorted(map(str, mixing.copies(frame(spark, rows).repartition(3)).collect()))
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    got = [r.doc_id for r in mixed.collect()]
    assert all(got.count(r.doc_id) == r.copies for r in out)


def test_mix_of_rows_without_ids(spark):
    """Rows equal in doc_id, source and size are taken as often, together, as their copies say."""
    rows = [*[(None, " ".join(words(400 + k, 20)), "a") for k in range(50)], *[(7, "same text here", "b") for _ in range(30)], *[(100 + k, "one two", "c") for k in range(40)]]
    docs = frame(spark, rows)
    for weights in ((1, 6, 6), (6, 1, 3)):
        want = {r.source: r.n for r in mixing.copies(docs, weights=weights).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
        got = {r.source: r["count"] for r in mixing.mix(docs, weights=weights).groupBy("source").count().collect()}
        assert got == {s: n for s, n in want.items() if n} and any(n % 50 for n in want.values())
        most = mixing.mix(docs, weights=weights).where("source = 'a'").groupBy("text").count().agg({"count": "max"}).first()[0]
        assert most <= -(-want["a"] // 50)


def test_mixing_is_near_its_targets(spark):
    draw = random.Random(2)
    many = [(k, " ".join(["w"] * int(draw.paretovariate(1.2) * 5)), draw.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)]
    out = mixing.copies(frame(spark, many), weights=(1, 5)).groupBy("source").agg({"target": "max", "size": "max"}).collect()
    taken = mixing.copies(frame(spark, many), weights=(1, 5)).selectExpr("source", "copies * size AS t").groupBy("source").sum("t").collect()
    taken = {r[0]: r[1] for r in taken}
    for r in out:
        assert abs(taken[r.source] - r["max(target)"]) <= 0.02 * r["max(target)"] + r["max(size)"]


def test_byte_bpe(spark, rows):
    import base64

    import tiktoken
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(i, (t or "").replace("again", "again'll <|endoftext|>  ")) for i, t, _ in rows]
    draw, marks = random.Random(3), ["a", "é", "　", " ", "\n", "\x1c", "\x85", "'s", "'LL", "中", "😀", "1", "٣", "́", "!", "\t", "aaaa", "​", "ﬁ", "\xa0"]
    odd += [(1000 + k, "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))) for k in range(2000)]
    out = byte_bpe.tokenise(frame(spark, [(i, t, "a") for i, t in [*odd, (None, None)]]), keep=("doc_id", "h1")).collect()
    got = {r.doc_id: r for r in out}
    for i, t in odd:
        ids = want.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids) and bytes(got[i].decoded).decode() == t
    assert got[None].n_tokens == 0 and len(out) == len(odd) + 1


def test_byte_bpe_at_every_code_point():
    import tiktoken
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    coder = byte_bpe.tokenizer(path)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    newer = [c for c in points if coder.unknown.match(c)]
    for at in range(0, len(newer), 64):
        text = "".join(f" 1a{c}a1{c}.{c}" for c in newer[at:at + 64])
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want.encode_ordinary(text), hex(ord(newer[at]))
    split = tiktoken.Encoding("split", pat_str=r"a[\p{L}\p{N}]", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    joined = set(bytes(split.encode_ordinary("".join(f"a{c}." for c in points))).decode())
    assert {c for c in points if coder._split(f"a{c}b") == [f"a{c}b"]} | {c for c in points if coder._split(f"1{c}1") == [f"1{c}1"]} == joined


def test_long_strings_are_not_remembered():
    coder = byte_bpe.tokenizer(public_tokenizers.path(byte_bpe.VOCABULARY))
    long = "中文" * 200
    assert coder.decode(coder.encode(f"{long} and {long}")).decode() == f"{long} and {long}"
    assert max(map(len, [*coder.pieces, *coder.stretches])) <= byte_bpe.LONGEST


def test_words_are_remembered_without_marks():
    """Marks behind Latin letters make no new words; ids stay those of the tokenizer."""
    from tokenizers import Tokenizer
    texts = ["alpha*** alpha&&& alpha-beta alpha", "Étude,. étude### 12,5 don't'S 555-5294", "слово,. слово ÷a, ×.b İ.c ŉ.d a\u0301.b a<|b.c", "<|endoftext|>a,b", "", None]
    coder = token_files.words(token_files._definition(None))
    coder.known.clear()
    coder.store.cut(0)
    got = coder.encode(pa.array(texts)).to_pylist()
    want = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    assert [np.frombuffer(g, coder.kind).tolist() for g in got] == [[*want.encode(t or "", add_special_tokens=False).ids, token_files.END] for t in texts]
    assert {"alpha", "***", "-beta", "étude"} <= set(coder.known)
    assert not {"alpha***", "alpha&&&", "alpha-beta", "étude###"} & set(coder.known)


def test_perfect_hash():
    keys = [str(k).encode() for k in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(5000))
    assert all(table.slot(f"-{k}".encode()) == -1 for k in range(1, 500))
    assert byte_bpe.PerfectHash([]).slot(b"x") == -1


def test_token_files(spark, rows, tmp_path):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    draw, marks = random.Random(3), ["a", "é", " ", "\n", "\x1c", "\x85", "'s", "中", "😀", "1", "́", "!", "Σ", "İ", "<|endoftext|>", "<|", "S", ".", "K", "ﬁ"]
    more = [(1000 + k, "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))) for k in range(500)]
    both = sorted([r[:2] for r in rows] + more)
    token_files.write_token_files(frame(spark, [(i, t, "a") for i, t in [*both, (None, "last")]]).repartition(5), str(tmp_path))
    got = {r.doc_id: r for r in token_files.read_token_files(spark, str(tmp_path)).collect()}
    at = 0
    for i, t in [*both, (None, "last")]:
        ids = [*want.encode(t or "", add_special_tokens=False).ids, token_files.END]
        assert got[i].start == at and bytes(got[i].ids) == b"".join(x.to_bytes(4, "little") for x in ids), (i, t)
        at += len(ids)
    assert len(got) == len(both) + 1


def test_code_lengths():
    import numpy as np
    for counts in ([], [5], [3, 0, 4], [1] * 1000, [1 << k for k in range(30)], [7, 7, 7, 1]):
        lengths = token_files.code_lengths(np.array(counts, np.int64), 12).astype(int)
        used = [n for n, c in zip(lengths, counts) if c]
        assert all(0 < n <= 12 for n in used) and sum(2.0 ** -n for n in used) <= 1
        assert [n for n, c in zip(lengths, counts) if not c] == [0] * counts.count(0)
    best = token_files.code_lengths(np.array([40, 30, 20, 10]))
    assert best.tolist() == [1, 2, 3, 3]
    draw = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 5000):
        ids = np.minimum(draw.geometric(0.01, n), 60_000)
        codes = token_files.Codes(token_files.code_lengths(np.bincount(ids)))
        assert (codes.decode(*codes.encode(ids), n) == ids).all()


def test_quality_of_held_out(spark):
    from plumbline.llm.common import table
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    out = quality.op4_quality(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    own = [r for r in out if r.held_out and r.doc_id in labels]
    good, bad = [r for r in own if labels[r.doc_id] == 1], [r for r in own if labels[r.doc_id] == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.99 and sum(r.predicted for r in bad) / len(bad) < 0.25
    better = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert better > 0.98


def test_quality_of_odd_rows(spark, rows):
    docs = frame(spark, [*rows, (None, "one two", "a"), (3, "one", "b")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7, 19)] + [(None, 1, 0), (3, None, 0), (500, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.op4_quality(docs, labels).collect()
    assert len(out) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    model = quality.train(docs, labels)
    want = {r[0]: float(model.score(np.array([quality.saved(r[1], model.compressors())]))[0]) for r in rows}
    assert all(r.score == pytest.approx(want[r.doc_id]) for r in out if r.doc_id is not None and r.doc_id != 3)
    assert {r.score for r in out if r.doc_id in {i for i, t, _ in rows if not t}} == {model.base}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    for none in (labels.where("false"), labels.where("quality = 1")):
        assert {r.score for r in quality.op4_quality(docs, none).collect()} == {0.5}


def test_quality_is_alike_around_its_bounds(spark):
    """As few bad documents pass with fewer bad labels than the dictionaries take as with a few more, or many more."""
    from plumbline.llm.common import table
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(4).cache()
    out = quality.held_out(docs.doc_id)
    kept = {r.doc_id: r for r in labels.collect()}
    own = [(r.text, kept[r.doc_id].quality) for r in docs.where(out).orderBy("doc_id").collect()]
    own = [x for x in own if x[1] == 0] + [x for x in own if x[1] == 1][:150]
    bad = sorted(i for i, r in kept.items() if r.quality == 0)
    good = sorted(i for i, r in kept.items() if r.quality == 1)
    for some in (380, 400, 410, len(bad)):    # a fifth of them is held out; the dictionaries take 160 of each half
        share = len(good) * some // len(bad)
        model = quality.train(docs, labels.where(labels.doc_id.isin(bad[:some] + good[:share])), 160, 320)
        scores = [(float(model.score(np.array([quality.saved(t, model.compressors())]))[0]), q) for t, q in own]
        assert np.mean([s >= 0.3 for s, q in scores if q == 0]) <= 0.15 and np.mean([s >= 0.3 for s, q in scores if q == 1]) >= 0.97, some
    docs.unpersist()


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (simhash.op1_simhash(docs), quality.op4_quality(docs, labels), substrings.op5_substring_dedup(docs), byte_bpe.op7_byte_bpe(docs),
                token_files.op8_token_files(docs), lines.op9_line_dedup(docs), mixing.op10_mix_sources(docs), mixing.mix(docs), simhash.drop_near_copies(docs)):
        assert out.count() == 0 and len(out.columns)


def test_digests(spark, rows):
    out = {r.doc_id: r for r in substrings.op5_substring_dedup(frame(spark, rows)).collect()}
    assert out[0].kept_sha256 == hashlib.sha256(b"").hexdigest() and out[5].kept_sha256 == hashlib.sha256(b"one two three").hexdigest()
