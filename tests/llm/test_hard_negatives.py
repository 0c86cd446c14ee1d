"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest

from plumbline.llm import hard_negatives as h

VECTORS = "vec_id long, embedding array<float>, label int, mark int, rank string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "c", 2) for i, v, lab in rows], VECTORS)


def brute(rows, every=100):
    part = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(v)) for i, v, lab in rows
                   if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    part = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in part]
    out = []
    for at, (i, lab, v) in enumerate(part):
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, k, m) for k, (j, m, w) in enumerate(part) if k != at and len(w) == len(v)]
        for minus, j, _, _ in sorted(o for o in others if o[3] == lab)[:5]:
            inside = sorted(o for o in others if o[3] != lab and -30 * minus <= -100 * o[0] <= -90 * minus)[:10]
            out += [(i, j, n, o[1], -minus, -o[0]) for n, o in enumerate(inside, 1)]
    return sorted(out)


def test_products():
    draw = np.random.default_rng(1)
    for m, k, n in ((5, 3, 4), (33, 64, 70), (31, 31, 97), (0, 3, 4), (4, 0, 3), (40, 40, 40)):
        a, b = draw.integers(-2 ** 28, 2 ** 28, (m, k)), draw.integers(-2 ** 28, 2 ** 28, (k, n))
        for leaf in (1, 8, 32):
            assert (h.strassen(a, b, leaf) == a.astype(object) @ b.astype(object)).all()


def test_first_k_takes_the_first_of_equal_scores():
    scores = np.array([[5, 7, 7, 7, 1], [h.NONE, 2, h.NONE, h.NONE, h.NONE], [3, 3, 3, 3, 3]])
    rows, places = h.first_k(scores, 2)
    assert list(zip(rows.tolist(), places.tolist())) == [(0, 1), (0, 2), (1, 1), (2, 0), (2, 1)]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(4, 10))
    out = [(k * 4, [float(x) for x in (centres[k % 4] * 0.1 + draw.normal(size=10) * 0.15).astype(np.float32)], k % 5) for k in range(240)]
    same = out[25][1]
    return out + [(1001, same, 1), (1002, same, 2), (1002, same, 2), (1003, same, 1), (1100, same, 1), (1100, out[26][1], 1), (1200, [0.0] * 10, 3), (1201, [0.0] * 10, 4),
                  (1300, None, 1), (1400, same, None), (1500, [None, *same[1:]], 1), (1600, [float("nan"), *same[1:]], 1), (1700, [float("inf"), *same[1:]], 1),
                  (1800, [], 1), (1801, [], 1), (1802, [], 2), (1900, [1.0, 0.5], 1), (1901, [0.9, 0.5], 1), (1902, [0.8, 0.1], 2), (None, same, 1)]


def test_hard_negatives(spark, rows):
    want = brute(rows)
    assert len(want) > 100 and any(r[0] == 1900 for r in want) and any(r[0] == 1100 for r in want)
    for options in ({}, {"block": 40, "anchors": 3}):
        assert sorted(map(tuple, h.hard_negatives(frame(spark, rows), **options).collect())) == want


def test_tiles_of_few_candidates(rows):
    some = [(i, v, lab) for i, v, lab in rows[:200]]
    side = (np.array([r[0] for r in some]), np.arange(200), np.array([r[2] for r in some]), np.floor(256 * np.array([r[1] for r in some])).astype(np.int64))
    whole, cut = (h.tile_positives(side, side, tile=tile) for tile in (2048, 7))
    assert [sorted(heap) for heap in cut] == [sorted(heap) for heap in whole]


def test_ties_few_rows_and_none(spark):
    rows = [(100, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (3, [0.5, 9.0], 2), (5, [0.5, -1.0], 2), (2, [2.0, 0.0], 3), (4, [0.25, 0.0], 3)]
    got = sorted(map(tuple, h.hard_negatives(frame(spark, rows)).collect()))
    assert got == [(100, 9, 1, 3, 65536, 32768), (100, 9, 2, 5, 65536, 32768)]
    assert h.hard_negatives(frame(spark, rows[1:])).count() == 0
    assert h.hard_negatives(frame(spark, rows[:1])).count() == 0
    assert h.hard_negatives(frame(spark, [])).count() == 0


def test_too_large_components_take_no_part(spark):
    rows = [(100, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (3, [0.5, 9.0], 2), (5, [1e30, 0.0], 1), (6, [1e9, 0.0], 2)]
    assert [r.positive_id for r in h.hard_negatives(frame(spark, rows)).collect()] == [9]
    large = [(100, [1e5] * 64, 1), (9, [1e5] * 64, 1), (3, [5e4] * 64, 2)]
    assert [tuple(r) for r in h.hard_negatives(frame(spark, large)).collect()] == [(100, 9, 1, 3, 64 * 25600000 ** 2, 64 * 25600000 * 12800000)]
