"""Vector operators and URL filters against brute force."""

import random

import brute
import numpy as np
import pytest

from plumbline.llm import nearest, urls, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int, rank int, copies string, gid int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "c", 2) for i, v, lab in rows], VECTORS)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 16))
    out = []
    for k in range(260):
        x = centres[k % 6] + draw.normal(size=16) * (0.12 if k % 2 else 0.9)
        out.append((k * 5, [float(v) for v in x.astype(np.float32)], k % 6 % 3 if k % 11 else None))
    same = out[7][1]
    out += [(2001, same, out[7][2]), (2002, same, out[7][2]), (2002, same, out[7][2]), (2003, [2 * v for v in same], out[7][2]), (2004, same, 77),
            (2100, None, 1), (2200, [0.0] * 16, 1), (2300, [float("nan")] + [1.0] * 15, 1), (2400, [float("inf")] + [1.0] * 15, 1),
            (2500, [None] + [1.0] * 15, 1), (2600, [], 1), (2700, [1.0, 2.0], 1), (2701, [1.0, 2.0], 1), (None, same, 1)]
    return out


def fit(v):
    return bool(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def test_nearest(spark, rows):
    seen = {(i, tuple(v)) for i, v, _ in rows if i is not None and fit(v)}
    for options in ({}, {"block": 40, "queries": 1}):
        got = {}
        for r in nearest.nearest(vectors(spark, rows), **options).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        want = {}
        for q, x in seen:
            if q % 100 == 0:
                near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in seen if i != q and len(x) == len(y))[:10]
                if near:
                    want[q] = near
        assert set(got) == set(want)
        for q, near in want.items():
            assert [(n, i) for n, i, _ in sorted(got[q])] == [(n, i) for n, (_, i) in enumerate(near, 1)]
            assert [s for _, _, s in sorted(got[q])] == pytest.approx([s for s, _ in near])


def test_nearest_ties_and_few(spark):
    rows = [(100, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (5, [0.0, -1.0], 1)]
    got = [(r["rank"], r.vec_id) for r in nearest.nearest(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 5), (3, 7)]
    assert nearest.nearest(vectors(spark, rows[1:])).count() == 0
    assert nearest.nearest(vectors(spark, rows[:1])).count() == 0
    assert nearest.nearest(vectors(spark, [])).count() == 0


def test_nearest_of_an_id_with_many_vectors(spark):
    """An id with more vectors near the query than there are places takes one place."""
    rows = [(100, [1.0, 0.0], 1), *[(1, [1.0, 0.001 * k], 1) for k in range(1, 13)], *[(k, [1.0, 0.1 * k], 1) for k in range(2, 14)]]
    for order in (rows, rows[::-1]):
        got = [(r["rank"], r.vec_id, round(r.score, 5)) for r in nearest.nearest(vectors(spark, order)).orderBy("rank").collect()]
        assert got == [(1, 1, 0.001), *[(k, k, round(0.1 * k, 5)) for k in range(2, 11)]]


def test_embedding_links(spark, rows):
    named = [r for r in rows if r[0] is not None]
    once = {(i, None if v is None else tuple(map(str, v)), lab): (i, v, lab) for i, v, lab in named}
    want = brute.embedding_links(list(once.values()))
    assert max(n for n, _ in want.values()) > 10
    for group in (vector_dedup.GROUP, 8):
        out = vector_dedup.embedding_links(vectors(spark, rows), group).collect()
        assert len(out) == len(rows)
        got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
        assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
        assert got[2001][0] >= 3 and got[2004] == (0, 2004) and got[2700] == (1, 2700) and got[2701] == (1, 2700) and got[2200] == (0, 2200)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert vector_dedup.embedding_links(vectors(spark, [])).count() == 0


def test_embedding_links_of_near_copies(spark):
    draw = np.random.default_rng(9)
    base = draw.normal(size=64)
    rows = [(k, [float(v) for v in (base + draw.normal(size=64) * 0.05).astype(np.float32)], 1) for k in range(400)]
    out = vector_dedup.embedding_links(vectors(spark, rows), 64).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(399, 0)}


def judge(url, rules, default="allow"):
    """host, path, rule and verdict by looking at every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if None not in r and r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_urls(spark):
    draw = random.Random(6)
    parts = ["com", "net", "example.com", "www.example.com", "a.b.www.example.com", "xexample.com", "EXAMPLE.com", "com.", ".com", "example.com:80", "u@example.com", "É.com", ""]
    paths = ["", "/", "/en/", "/en", "/en/a/b", "/es/x", "/fr/?q=/en/", "?x=/", "#/en/", "/EN/", "//en/", "/é/"]
    known = [None, "", "no scheme", "://", "http://", "x://y://z", "http://" + "a." * 5000 + "com/" + "p/" * 5000, "http://e.com/a\nb"]
    known += [f"{draw.choice(['http', 'https', ''])}://{draw.choice(parts)}{draw.choice(paths)}" for _ in range(600)]
    pages = spark.createDataFrame([(k // 2, u, "h", "r", 5, "b") for k, u in enumerate([*known, *known[:20]])],
                                  "page_id long, url string, host string, rule string, label int, digest string")
    more = [*urls.RULES, ("b.www.example.com", "/e", "block"), ("example.com", "", "block"), ("com", "/en/", "block"), ("com", "/en/", "allow"),
            ("", "/", "block"), (None, "/", "block"), ("é.com", "/", "block"), ("com", None, "block")]
    for rules in (urls.RULES, more, []):
        out = urls.judge(pages, urls.rule_table(spark, rules))
        assert out.columns == ["page_id", "url", "label", "digest", "host", "path", "rule", "verdict"]
        got = sorted((r.page_id, r.url or "", *map(str, (r.host, r.path, r.rule, r.verdict))) for r in out.collect())
        assert got == sorted((r.page_id, r.url or "", *map(str, judge(r.url, rules))) for r in pages.collect())
    assert urls.op6_url_filters(pages.where("false")).count() == 0
    plan = urls.op6_url_filters(pages)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian"))
