"""Personal data: the rules against their patterns, reliabilities against known truth, and spans that are added."""

import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm import personal as p

DOCS = "doc_id long, text string, base string, more string, patterns string, n_email int"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) if n % 2 == 0 else sum(divmod(2 * int(d), 10)) for n, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text):
    keep = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
            "card": lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s)), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    spans = [(m.start(), n, m.end(), kind) for n, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text or "") if keep[kind](m.group())]
    return [f"{kind}:{i}:{j}" for i, _, j, kind in sorted(spans)], [sum(s[3] == k for s in spans) for k in RULES]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "m", "p", 7) for i, t in rows], DOCS)


ODD = [None, "", "a@b.c_d@e.f", "a@b.c.@d.e", "@@x@y.z", "x@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0001.002.3.255", "4111 1111 1111 1111 4111111111111111", "4111-1111-1111-1111", "+1 (555) 010-9999 4111111111111111",
       "+123456789", "+12345678", "+1((((", "é@a.b a@é.b", "👩 me@host.example 👩", "1" * 5000, "a" * 5000 + "@" + "b." * 2000, "+1 +1 +1", "000000000000", "1-2-3-4 5-6 7 8 9 0 1 2"]


def test_rules_as_their_patterns():
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice("ab@.@-+ 0123456789 .-()_é%") for _ in range(draw.randrange(200))) for _ in range(3000)]
    texts += ["".join(draw.choice(("4111111111111111", "a@b.co", "+1 555 010 9999", "10.0.0.1", " ", "-", ".", "@", "5")) for _ in range(12)) for _ in range(2000)]
    seen = 0
    for text in texts:
        want, counts = brute(text)
        got = p.base_spans(text or "")
        assert p.spelt(got) == ",".join(want), text
        seen += len(got)
    assert seen > 5000


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "@" * 200_000, "a@" * 200_000, "+1" + "(" * 400_000, "A" * 400_000, "12345 " * 60_000, "Abc " * 100_000, "a.b" * 100_000 + "@"):
        base = p.base_spans(text)
        p.further_spans(text, base)


def test_patterns_hold_kind_votes_and_shape():
    text = "Please call 0171 555 0199 or write to jane (at) example (dot) org"
    spans = p.further_spans(text, [])
    assert [(text[i:j], p.KINDS[k]) for i, j, k in spans] == [("0171 555 0199", "phone"), ("jane (at) example (dot) org", "email")]
    for i, j, k in spans:
        kinds, votes, shapes = p.parsed(np.array([p.pattern(text, i, j, k)]))
        assert (kinds[0], tuple(votes[0]), tuple(shapes[0])) == (k, p.votes(text, i, j, k), p.shape(text[i:j]))


def test_reliabilities_recover_the_truth():
    draw = np.random.default_rng(8)
    truth = draw.random(20_000) < 0.3
    right, silent = np.array([0.95, 0.9, 0.8, 0.6, 0.85, 0.7, 0.9]), np.array([0.1, 0.2, 0.5, 0.3, 0.4, 0.0, 0.6])
    agree = draw.random((len(truth), 7)) < right
    said = np.where(draw.random((len(truth), 7)) < silent, 0, np.where(agree == truth[:, None], 1, -1))
    rows, counts = np.unique(said, axis=0, return_counts=True)
    q, shares = p.reliabilities(np.zeros(len(rows), int), rows, counts.astype(float))
    known = {tuple(r): x for r, x in zip(rows.tolist(), q)}
    assert np.mean([(known[tuple(r)] > 0.5) == t for r, t in zip(said.tolist(), truth)]) > 0.96
    for labeler in range(7):
        for of, vote in ((1, 1), (0, -1)):
            assert shares[of, labeler, vote + 1] == pytest.approx(right[labeler] * (1 - silent[labeler]), abs=0.04)


def test_weights_are_where_the_gradient_ends():
    draw = np.random.default_rng(1)
    x, y, n = draw.normal(size=(50, 4)), draw.random(50), draw.integers(1, 9, 50).astype(float)
    w = p.fitted(x, y, n)
    assert x.T @ (n * (y - 1 / (1 + np.exp(-x @ w)))) == pytest.approx(w, abs=1e-6)


@pytest.fixture(scope="module")
def corpus():
    """Texts with spans of the rules, spans that labelers have to find, and numbers that are nothing of the kind."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abdehilmnorst") for _ in range(draw.randrange(2, 9)))
    prose = lambda: " ".join(word() for _ in range(draw.randrange(4, 30)))
    out, hidden = [], {}
    for n in range(900):
        digits = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        card = next(digits + d for d in "0123456789" if luhn(digits + d))
        wrong = str((int(card[0]) + 3) % 10) + card[1:]
        plain = draw.choice((f"{word()}@{word()}.com", ".".join(str(draw.randrange(1, 255)) for _ in range(4)), card, f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"))
        text = f"{prose()} {plain} {prose()}"
        if n % 3 == 0:
            text += f" {wrong if not luhn(wrong) else 'x'} {prose()} version {draw.randrange(9)}.{draw.randrange(9)} of 2024-0{draw.randrange(1, 9)}-11"
        if n % 5 == 0:
            added = draw.choice((f"{word()}x (at) mail (dot) com", f"({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"))
            lead = "write to " if "at" in added else "call "
            text += f". {lead}"
            hidden[n] = (len(text), len(text) + len(added))
            text += f"{added}, {prose()}"
        out.append((n, text))
    return out, hidden


def test_personal_data(spark, corpus):
    rows, hidden = corpus
    odd = [(2000 + n, t) for n, t in enumerate(ODD)]
    got = p.personal_data(frame(spark, rows + odd + [(5, rows[5][1]), (None, rows[6][1])])).collect()
    assert len(got) == len(rows) + len(odd) + 2
    texts = dict(rows + odd)
    caught = false = 0
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else rows[6][1]
        want, counts = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        added = {tuple(map(int, s.split(":")[1:])) for s in set(spans) - set(want)}
        if r.doc_id is not None and r.doc_id < 2000:
            caught += hidden.get(r.doc_id) in added
            false += len(added - {hidden.get(r.doc_id)})
    assert caught >= 0.9 * len(hidden) and false <= 0.03 * len(rows)


def test_nothing_to_judge(spark):
    assert p.personal_data(frame(spark, [])).count() == 0
    assert [tuple(r) for r in p.personal_data(frame(spark, [(1, "plain words"), (2, None)])).orderBy("doc_id").collect()] == \
        [(n, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "") for n in (1, 2)]
