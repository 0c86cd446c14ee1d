"""Variance analysis of factors with any number of levels, against least squares on dummy columns."""

import numpy as np
import pytest

from plumbline.operators import level_fit, stats


def sums(y, factors):
    """(degrees of freedom, sum of squares) of each factor after those before it."""
    x, found = np.ones((len(y), 1)), []
    rank, rest = 1, ((y - y.mean()) ** 2).sum()
    for f in factors:
        x = np.hstack([x, (f[:, None] == np.unique(f)).astype(float)])
        fit, _, now, _ = np.linalg.lstsq(x, y, rcond=None)
        left = ((y - x @ fit) ** 2).sum()
        found.append((now - rank, rest - left))
        rank, rest = now, left
    return found, rest / (len(y) - rank)


def cases():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 40, 2000), draw.integers(0, 20, 2000)
    yield "nested", [a // 10, a]
    yield "apart", [a, np.where(a < 20, b % 10, 10 + b % 10)]    # two parts that share no level
    yield "three", [a // 20, a, b % 3]


@pytest.mark.parametrize("name, factors", cases(), ids=[n for n, _ in cases()])
def test_rounds_equal_least_squares(spark, monkeypatch, name, factors):
    monkeypatch.setattr(stats, "MOST_LEVELS", 0)
    draw = np.random.default_rng(6)
    y = 1e3 + sum(draw.normal(size=f.max() + 1)[f] for f in factors) + draw.normal(size=2000)
    names = [f"f{i}" for i in range(len(factors))]
    rows = [(float(v), *[f"l{x}" for x in f]) for v, *f in zip(y, *factors)] + [(None, *["l0"] * len(names)), (7.0, *[None] * len(names))]
    frame = spark.createDataFrame(rows, "y double, " + ", ".join(f"{n} string" for n in names))
    got = {r["name"]: r for r in stats.factor_anova(frame, "y", names).collect()}
    want, error = sums(y, factors)
    for n, (df, ss) in zip(names, want):
        assert got[n]["df"] == df, n
        assert got[n]["sum_sq"] == pytest.approx(ss, rel=1e-7, abs=1e-6)
        if df:
            assert got[n]["f"] == pytest.approx(ss / df / error, rel=1e-7)
    assert stats.factor_anova(frame.where("false"), "y", names).count() == 0


def test_a_factor_of_two_levels_takes_one_round(spark, monkeypatch):
    """The largest factor is put into the equations of the others: two numbers are left, and the last round finds nothing to do."""
    monkeypatch.setattr(stats, "MOST_LEVELS", 0)
    monkeypatch.setattr(level_fit, "MOST_ROUNDS", 2)
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 50, 300), draw.integers(0, 2, 300)
    y = draw.normal(size=50)[a] + b + draw.normal(size=300)
    frame = spark.createDataFrame([(float(v), int(i), f"l{j}") for v, i, j in zip(y, a, b)], "y double, a long, b string")
    want, _ = sums(y, [a, b])
    got = {r["name"]: r for r in stats.factor_anova(frame, "y", ["a", "b"]).collect()}
    for n, (df, ss) in zip("ab", want):
        assert got[n]["df"] == df
        assert got[n]["sum_sq"] == pytest.approx(ss, rel=1e-7)


def test_tail_of_many_degrees_of_freedom():
    from plumbline.functions.tails import f_upper
    assert f_upper(1.0, 2e6, 2e6) == pytest.approx(0.5, abs=1e-6)
    assert f_upper(1.002, 2e6, 2e6) == pytest.approx(0.0786, abs=5e-4)    # normal limit: log F / 2 has variance (1 / d1 + 1 / d2) / 2
