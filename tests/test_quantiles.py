"""Exact quantiles by refinement: every kind of double, ties, keys, and bins that are divided again and again."""

import math

import numpy as np
import pytest

from plumbline.functions import ordered

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, math.nextafter(1, 0), 1.7976931348623157e308, -1.7976931348623157e308,
         float("inf"), float("-inf"), 0.1, -0.1, *[math.nextafter(2.0 ** k, 0) for k in range(-1020, 1020, 97)], *[1 + k * 2.0 ** -52 for k in range(200)]]
PROBS = [0, 0.01, 0.3, 0.5, 0.62, 0.9, 1]


def wanted(values, p):
    spot = (len(values) - 1) * p
    low, high = sorted(values)[math.floor(spot)], sorted(values)[math.ceil(spot)]
    return low if low == high else low + (high - low) * (spot - math.floor(spot))


@pytest.mark.parametrize("values, parts", [(1 << 18, 1 << 16), (2, 1 << 12), (1, 2)])
def test_edges(spark, monkeypatch, values, parts):
    monkeypatch.setattr(ordered, "VALUES", values)
    monkeypatch.setattr(ordered, "PARTS", parts)
    some = EDGES if parts > 2 else EDGES[5:7] + EDGES[-40:]
    frame = spark.createDataFrame([(v,) for v in [*some, None]], "v double")
    assert ordered.quantile_values(frame, "v", PROBS) == [wanted(some, p) for p in PROBS]


def test_columns_and_keys(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(None if k % 7 == 0 else k % 3, float(draw.normal()), float(draw.integers(5)), None) for k in range(700)]
    frame = spark.createDataFrame(rows, "k int, v double, w double, z double")
    for few in (False, True):
        if few:
            monkeypatch.setattr(ordered, "VALUES", 3)
            spark.conf.set("plumbline.broadcastRows", "2")
        try:
            whole = ordered.column_quantiles(frame, ["v", "w", "z"], PROBS)
            for at, c in ((1, "v"), (2, "w")):
                assert whole[c] == pytest.approx([wanted([r[at] for r in rows], p) for p in PROBS])
            assert whole["z"] == [None] * len(PROBS)
            keyed = {r.k: r.q for r in ordered.quantiles(frame, ["k"], "v", PROBS).collect()}
            assert set(keyed) == {None, 0, 1, 2}
            for k, q in keyed.items():
                assert q == pytest.approx([wanted([r[1] for r in rows if r[0] == k], p) for p in PROBS])
            every = {(r.k, r["name"]): r for r in ordered.describe(frame, ["k"], ["v", "z"], [0.5]).collect()}
            assert every[None, "v"].q == pytest.approx([wanted([r[1] for r in rows if r[0] is None], 0.5)]) and every[1, "z"].q is None
        finally:
            spark.conf.unset("plumbline.broadcastRows")


def test_nan_is_the_greatest_and_nothing_gives_nothing(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    assert ordered.quantile_values(frame, "v", [0, 0.5]) == [1.0, 3.0] and math.isnan(ordered.quantile_values(frame, "v", [1])[0])
    assert ordered.quantile_values(frame.where("false"), "v", [0.5]) == [None]
    assert ordered.column_quantiles(frame, [], [0.5]) == {}


def test_bins_of_magnitude_keep_the_order(spark):
    values = sorted({*EDGES, *[float(x) for x in np.random.default_rng(1).normal(size=2000) ** 9]})
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r[0] for r in frame.orderBy("v").select(ordered.coarse_bin(frame.v)).collect()]
    assert bins == sorted(bins) and len(set(bins)) > 500


def test_keys_may_have_any_name(spark):
    frame = spark.createDataFrame([(1, 2, 5.0), (1, 2, 7.0)], "_bin int, _n int, _v double")
    assert [tuple(r) for r in ordered.quantiles(frame, ["_bin", "_n"], "_v", [0.5]).collect()] == [(1, 2, [6.0])]
