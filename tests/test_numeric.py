"""Operators without an SQL oracle, against small numpy calculations or properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import tails
from plumbline.operators import (alerts, clean, decompose, features, forecast, models, neighbors, outliers, reduce, smooth,
                                 spectral, stats)

START = pd.Timestamp("2020-01-01")


def series(spark, values, period="D"):
    ts = pd.date_range(START, periods=len(values), freq=period)
    rows = [(t.to_pydatetime(), None if v is None or v != v else float(v)) for t, v in zip(ts, values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, v double")


def points(spark, x, names="xyzuvw"):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names[:len(x[0])]))


# --- tails ---------------------------------------------------------------------------------------

def test_tails_against_known_values():
    assert tails.f_upper(4.0, 2, 10) == pytest.approx(1 / (1 + 4 * 2 / 10) ** 5, rel=1e-12)      # closed form for d1 = 2
    assert tails.t_both(1.0, 1) == pytest.approx(0.5, rel=1e-12)                                  # Cauchy quartile
    assert tails.chi_upper(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert tails.t_both(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)


# --- neighbours and density clusters ------------------------------------------------------------------

def cloud(seed=3, copies=40):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.5, (50, 2)), rng.uniform(-3, 8, (25, 2)), np.tile([1.5, 1.5], (copies, 1))])
    return np.round(x, 3)


def brute_near(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev"])
def test_neighbour_scores(spark, metric):
    x = cloud()
    gaps = np.abs(x[:, None] - x[None])
    d = {"euclidean": np.sqrt((gaps ** 2).sum(2)), "cityblock": gaps.sum(2), "chebyshev": gaps.max(2)}[metric]
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :5].mean(1)
    df = points(spark, x)
    got = neighbors.attach(df, ["x", "y"], neighbors.neighbour_scores(df, ["x", "y"], 5, metric)).orderBy("id").toPandas()
    np.testing.assert_allclose(got["score"], want, atol=1e-9)


def test_neighbours_in_many_dimensions(spark):
    x = np.round(np.random.default_rng(1).normal(size=(70, 6)), 4)
    df = points(spark, x)
    got = neighbors.attach(df, list("xyzuvw"), neighbors.neighbour_scores(df, list("xyzuvw"), 4)).orderBy("id").toPandas()
    np.testing.assert_allclose(got["score"], brute_near(x, 4).mean(1), atol=1e-9)


def test_chaining_factor(spark):
    x = np.round(np.random.default_rng(5).normal(size=(40, 2)), 4)
    k = 6
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d + np.eye(len(x)) * 1e9, 1)[:, :k]

    def chain(i):
        inside, rest, total = [i], list(near[i]), 0.0
        for step in range(1, k + 1):
            e, j = min((d[a, b], b) for a in inside for b in rest)
            total += 2 * (k + 1 - step) / (k * (k + 1)) * e
            inside.append(j)
            rest.remove(j)
        return total
    ac = np.array([chain(i) for i in range(len(x))])
    df = points(spark, x)
    got = neighbors.attach(df, ["x", "y"], neighbors.chaining_factor(df, ["x", "y"], k)).orderBy("id").toPandas()
    np.testing.assert_allclose(got["score"], ac / ac[near].mean(1), atol=1e-9)


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= least
    label = np.full(len(x), -1)
    c = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] >= 0:
                continue
            label[j] = c
            todo += [m for m in np.flatnonzero(d[j] & core) if label[m] < 0]
        c += 1
    border = [set(label[np.flatnonzero(d[i] & core)]) for i in range(len(x))]
    return core, label, border


@pytest.mark.parametrize("eps", [0.25, 0.5, 1.2])
def test_density_clusters(spark, eps):
    x = cloud(7)
    core, label, border = brute_dbscan(x, eps, 5)
    df = points(spark, x)
    got = neighbors.attach(df, ["x", "y"], neighbors.density_clusters(df, ["x", "y"], eps, 5)).orderBy("id").toPandas()["cluster"].to_numpy()
    names = {}
    for i in np.flatnonzero(core):
        assert names.setdefault(label[i], got[i]) == got[i]
    assert len(set(names.values())) == len(names)
    for i in np.flatnonzero(~core):
        near = [j for j in np.argsort(np.sqrt(((x - x[i]) ** 2).sum(1)), kind="stable") if core[j]][0]
        assert got[i] == (names[label[near]] if border[i] else -1) or got[i] in {names[b] for b in border[i]}
    noise = outliers.density_outliers(df, ["x", "y"], eps, 5).orderBy("id").toPandas()["outlier"].to_numpy()
    np.testing.assert_array_equal(noise == 1, got == -1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    got = {r["a"]: r["label"] for r in neighbors.components(edges, nodes).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["z2"] == "z1"


# --- other outliers ------------------------------------------------------------------------------------

def test_isolation_forest_finds_far_points(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(400, 2)), [[9, 9], [-9, 8]]])
    out = outliers.isolation_outliers(points(spark, x), ["id"], ["x", "y"], contamination=0.01).toPandas().sort_values("score")
    assert set(out["id"].tail(2)) == {400, 401} and out["score"].between(0, 1).all()


def test_map_error_is_large_for_far_points(spark):
    x = np.vstack([np.random.default_rng(0).normal(size=(300, 2)), [[30, 30]]])
    out = outliers.map_outliers(points(spark, x).select("x", "y"), ["x", "y"], epochs=4).toPandas()
    assert out["outlier"].mean() < 0.05 and out["score"].min() >= 0


def test_ellipse_points_lie_on_the_limit(spark):
    x = np.random.default_rng(0).multivariate_normal([1, 2], [[2, 1], [1, 3]], 500)
    e = outliers.ellipse(points(spark, x), "x", "y", 0.9).toPandas()
    inv = np.linalg.inv(np.cov(x, rowvar=False))
    d = e[["x", "y"]].to_numpy() - x.mean(0)
    np.testing.assert_allclose(np.einsum("ij,jk,ik->i", d, inv, d), -2 * math.log(0.1), rtol=1e-9)


# --- projections ------------------------------------------------------------------------------------------

def test_pca_svd_lda(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.array([[3, 1, 0], [0, 1, 0], [0, 0, 0.2]]) + [5, -2, 1]
    df = points(spark, x)
    got, share, axes = reduce.pca(df, ["x", "y", "z"], 2)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    np.testing.assert_allclose(share, (values[::-1] / values.sum())[:2], rtol=1e-9)
    np.testing.assert_allclose(np.abs(got.orderBy("id").toPandas()["d0"]), np.abs((x - x.mean(0)) @ vectors[:, -1]), atol=1e-8)
    _, singular, _ = reduce.svd(df, ["x", "y", "z"], 2)
    np.testing.assert_allclose(singular, np.linalg.svd(x, compute_uv=False)[:2], rtol=1e-6)
    y = (x[:, 1] > -2).astype(int)
    labelled = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "c int, x double, y double, z double")
    flat = reduce.lda(labelled, ["x", "y", "z"], "c")[0].toPandas()
    gap = abs(flat[flat.c == 0].d0.mean() - flat[flat.c == 1].d0.mean()) / flat.groupby("c").d0.std().mean()
    raw = max(abs(x[y == 0, j].mean() - x[y == 1, j].mean()) / ((x[y == 0, j].std() + x[y == 1, j].std()) / 2) for j in range(3))
    assert gap >= raw * 0.99


@pytest.mark.parametrize("deflation", [False, True])
def test_ica_recovers_sources(spark, deflation):
    rng = np.random.default_rng(4)
    s = np.column_stack([rng.uniform(-1, 1, 2000), rng.laplace(size=2000)])
    df = points(spark, s @ np.array([[1, 0.5], [0.3, 1]]))
    got = reduce.ica(df, ["x", "y"], 2, deflation=deflation)[0].orderBy("id").toPandas()[["d0", "d1"]].to_numpy()
    r = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert r.max(1).min() > 0.97


def test_kmeans_and_series_clusters(spark):
    x = np.vstack([np.random.default_rng(0).normal(c, 0.2, (30, 2)) for c in (0, 5)])
    out, _ = reduce.kmeans(points(spark, x), ["x", "y"], 2)
    assert sorted(r["rows"] for r in reduce.cluster_sizes(out).collect()) == [30, 30] and reduce.silhouette(out) > 0.9
    rows = [(f"s{i}", t, float((i % 2) * 10 + t % 3)) for i in range(6) for t in range(12)]
    df = spark.createDataFrame(rows, "k string, ts int, v double")
    got, centres, score = reduce.cluster_series(df, "k", "ts", "v", 2)
    assert score > 0.9 and centres.count() == 24
    assert got.groupBy("cluster").count().where("count = 3").count() == 2
    _, sizes, _ = reduce.cluster_series_by_density(df, "k", "ts", "v", 1.0, 2)
    assert sorted(r["rows"] for r in sizes.collect()) == [3, 3]


def test_reduce_series_matches_projection_of_means(spark):
    x = np.random.default_rng(0).normal(size=(50, 3)) * [3, 1, 0.1] + [1, 2, 3]
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "k string, x double, y double, z double")
    got = reduce.reduce_series(df, "k", ["x", "y", "z"], 1).first()["d0"]
    vectors = np.linalg.eigh(np.cov(x, rowvar=False))[1]
    assert abs(got) == pytest.approx(abs(x.mean(0) @ vectors[:, -1]), rel=1e-9)


# --- variance analysis ------------------------------------------------------------------------------------

def test_factor_anova_is_sequential(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    y = a * 1.5 + b * 0.5 + rng.normal(size=300)
    df = spark.createDataFrame([(str(i), str(j), float(v)) for i, j, v in zip(a, b, y)], "a string, b string, y double")
    got = {r["name"]: r for r in stats.factor_anova(df, "y", ["a", "b"]).collect()}

    def rss(cols):
        x = np.column_stack([np.ones(300), *cols])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    da, db = [(a == i).astype(float) for i in (1, 2)], [(b == 1).astype(float)]
    r0, r1, r2 = rss([]), rss(da), rss(da + db)
    assert got["a"]["sum_sq"] == pytest.approx(r0 - r1) and got["b"]["sum_sq"] == pytest.approx(r1 - r2)
    assert got["a"]["f"] == pytest.approx(((r0 - r1) / 2) / (r2 / 296))
    assert got["a"]["omega_sq"] == pytest.approx((r0 - r1 - 2 * r2 / 296) / (r0 + r2))


# --- series ------------------------------------------------------------------------------------------------

def test_polynomial_and_lowess(spark):
    t = np.arange(40.0)
    got = smooth.polynomial_trend(series(spark, 3 + 2 * t - 0.1 * t * t), "ts", "v", 0.4).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["trend"], 3 + 2 * t - 0.1 * t * t, atol=1e-8)
    y = 2 * t + 1
    y[20] += 50
    got = smooth.lowess_trend(series(spark, y), "ts", "v", 0.5).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["trend"], 2 * t + 1, atol=0.2)


def test_exponential_average_equals_pandas(tight):
    rng = np.random.default_rng(0)
    v = rng.normal(size=300)
    v[50:75] = np.nan
    v[0] = np.nan
    for options, want in (({"span": 5}, pd.Series(v).ewm(span=5).mean()), ({"halflife": 80}, pd.Series(v).ewm(halflife=80).mean())):
        for period in ("D", None):
            got = smooth.exponential_average(series(tight, v), "ts", "v", period=period, **options).orderBy("ts").toPandas()["ema"]
            np.testing.assert_allclose(got, want, atol=1e-9)


def test_partial_autocorrelation_of_ar1(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for e in rng.normal(size=1500):
        y.append(0.7 * y[-1] + e)
    got = spectral.partial_autocorrelation(series(spark, y, "h"), "ts", "v", 5, period="h").orderBy("lag").toPandas()
    e = np.array(y) - np.mean(y)
    c = [e[k:] @ e[:len(e) - k] / (len(e) - k) for k in range(6)]
    for k in (1, 2, 4):
        r = np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got["pacf"][k] == pytest.approx(np.linalg.solve(r, c[1:k + 1])[-1], rel=1e-8)


def test_stationarity(spark):
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=300), rng.normal(size=300).cumsum()
    a = spectral.stationarity(series(spark, noise, "h"), "ts", "v").first()
    b = spectral.stationarity(series(spark, walk, "h"), "ts", "v").first()
    assert a["stationary"] and a["adf_p"] < 0.01 and not b["stationary"] and b["adf_p"] > 0.05


def test_low_pass_and_cycle(spark):
    t = np.arange(120)
    slow, fast = np.sin(2 * np.pi * t / 24), 0.3 * np.sin(2 * np.pi * t / 4)
    df = series(spark, slow + fast)
    np.testing.assert_allclose(spectral.low_pass(df, "ts", "v", 0.1).orderBy("ts").toPandas()["clean"], slow, atol=1e-9)
    assert [r["cycle"] for r in spectral.top_cycles(df, "ts", "v", top=2).orderBy("rank").collect()] == [24.0, 4.0]
    with pytest.raises(ValueError):
        spectral.low_pass(df, "ts", "v", 0.9)


@pytest.mark.parametrize("robust", [False, True])
def test_stl_parts_add_up(spark, robust):
    t = np.arange(96)
    season = 5 * np.sin(2 * np.pi * t / 12)
    got = decompose.stl(series(spark, 0.5 * t + season, "D"), "ts", "v", 12, robust=robust).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["trend"] + got["seasonal"] + got["resid"], got["v"], atol=1e-9)
    np.testing.assert_allclose(got["seasonal"][12:-12], season[12:-12], atol=0.3)
    assert got["strength"].iloc[0] > 0.95


def test_forecasts(spark):
    t = np.arange(60)
    wave = 10 * np.sin(2 * np.pi * t / 12)
    ahead = np.arange(60, 74)
    line = forecast.holt(series(spark, 3.0 * t + 5), "ts", "v", "D").orderBy("step").toPandas()
    np.testing.assert_allclose(line["forecast"], 3.0 * ahead + 5, atol=0.5)
    assert line["ts"][0] == START + pd.Timedelta(days=60)
    seasonal = 50 + wave
    want = 50 + 10 * np.sin(2 * np.pi * ahead / 12)
    for made in (forecast.holt_winters(series(spark, seasonal), "ts", "v", "D", season="add"),
                 forecast.holt_winters(series(spark, seasonal), "ts", "v", "D", season="mul"),
                 forecast.auto_smoothing(series(spark, seasonal), "ts", "v", "D"),
                 forecast.auto_autoregression(series(spark, seasonal), "ts", "v", "D"),
                 forecast.trend_season_regression(series(spark, seasonal), "ts", "v", "D")):
        np.testing.assert_allclose(made.orderBy("step").toPandas()["forecast"], want, atol=1.5)
    flat = forecast.simple_smoothing(series(spark, np.full(30, 4.0)), "ts", "v", "D").toPandas()
    np.testing.assert_allclose(flat["forecast"], 4.0)
    best = forecast.compare_forecasts(series(spark, seasonal), "ts", "v", "D").orderBy("mae").toPandas()
    assert best["method"][0] != "naive" and best["folds"][0] > 0
    assert forecast.best_forecast(series(spark, seasonal), "ts", "v", "D").count() == 24


@pytest.mark.parametrize("d,season_d", [(0, 0), (2, 0), (0, 1), (2, 1), (0, 2)])
def test_persistence_recursion(spark, d, season_d):
    y = list(np.random.default_rng(0).normal(size=40))
    got = forecast.persistence(series(spark, y), "ts", "v", "D", d, season_d).orderBy("step").toPandas()["forecast"]
    coef = np.array([1.0])
    for p in [[1, -1]] * d + [[1, *[0] * 11, -1]] * season_d:
        coef = np.convolve(coef, p)
    full = list(y)
    for _ in range(14):
        full.append(-sum(c * full[-i] for i, c in enumerate(coef) if i))
    np.testing.assert_allclose(got, full[40:], atol=1e-9)


def test_change_points_find_the_step(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 0.3, 30), rng.normal(6, 0.3, 30)])
    ends = [r["end"] for r in alerts.change_points(series(spark, y), "ts", "v").orderBy("segment").collect()]
    assert ends == [30, 60]


def test_season_search_and_direction(spark):
    t = np.arange(90)
    df = series(spark, 0.5 * t + np.tile([0, 5, -3, 2, 1], 18))
    found = decompose.season_search(df, "ts", "v", "D").where("best").first()
    assert found["sp"] % 5 == 0
    assert decompose.trend_direction(df, "ts", "v").first()["trending"] == "increasing trend"
    flat = series(spark, np.tile([0, 5, -3, 2, 1], 18))
    assert decompose.trend_direction(flat, "ts", "v").first()["trending"] == "no significant trend"


# --- features and models --------------------------------------------------------------------------------------

def labelled(spark, n=240):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    rows = [(i, *map(float, r), "p" if r[0] + 0.2 * r[1] > 0 else "n", float(3 * r[0] + r[1])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, c string, t double")


def test_feature_scores_rank_the_signal_first(spark):
    df, names = labelled(spark), ["x", "y", "z"]
    assert features.select(features.f_scores(df, names, "c"), "fwe").first()["name"] == "x"
    for model in ("linear", "lasso", "randomf", "boost"):
        for classify, target in ((True, "c"), (False, "t")):
            out = features.model_scores(df, names, target, model, classify).toPandas()
            assert out.sort_values("value").iloc[-1]["name"] == "x" and out.set_index("name").prime["x"]
    assert features.permutation_scores(df, names, "c", ["id"], repeats=2).first()["name"] == "x"
    assert features.null_importance(df, names, "c", ["id"], runs=3).first()["name"] == "x"
    kept = features.elimination(df, names, "c").toPandas()
    assert kept.set_index("name").prime["x"] and kept["prime"].sum() >= 2


def test_boosted_scores_fit_counted_cells_as_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=30_000), rng.exponential(size=30_000).round(2), rng.integers(-2, 3, 30_000)])
    up = x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] == 0) + 0.3 * rng.normal(size=30_000) > 0.4
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1], "z": x[:, 2].astype(int), "c": np.where(up, "p", "n")})).coalesce(2)
    df = df.union(df.where("z = 1 AND x > 0")).union(df.limit(50).withColumn("x", F.lit(None).cast("double")))
    names, fitted, fit = ["x", "y", "z"], [], features.GBTClassifier.fit
    plain = features.GBTClassifier(seed=0, maxIter=10).fit(features._rows(df, names, "c", True)).featureImportances.toArray()
    monkeypatch.setattr(features.GBTClassifier, "fit", lambda self, data: fitted.append(data.agg(F.count("*"), F.sum("weight")).first()) or fit(self, data))
    out = features.model_scores(df, names, "c", "boost", True).toPandas().set_index("name").value
    assert out[names].tolist() == np.round(plain, 3).tolist()
    (rows, weight), = fitted
    assert rows <= 33 * 33 * 5 * 2 < weight == df.where("x IS NOT NULL").count()     # a row per cell, however many rows there are
    with pytest.raises(ValueError, match="infinite"):
        features.model_scores(df.limit(9).withColumn("y", F.lit(-math.inf)), names, "c", "boost", True)


@pytest.mark.parametrize("drawn, expected, most", [
    ([3.0] * 6 + [1.0] * 2 + [2.0], 9.0, 4), ([0.0, 0.0, -1.0, 4.0, 4.0], 5.0, 1), ([5.0] * 7, 7.0, 3), ([0.0] * 4, 4.0, 3),
    (list(range(1, 40)) * 3, 120.0, 7)])
def test_cuts_between_values(drawn, expected, most):
    cuts = features._column_cuts(np.array(drawn, float), expected, most)
    values = sorted({*drawn, *([0.0] if expected > len(drawn) else [])})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
    assert set(cuts) <= set(middles) and list(cuts) == sorted(cuts)
    assert len(cuts) == len(middles) if len(middles) <= most else most - 1 <= len(cuts) <= most + 1


def test_cells_count_the_cuts_below_a_value(spark):
    values = [-math.inf, -1.0, 0.0, 0.5, 0.6, 7.0, math.inf]
    rows = spark.createDataFrame([(v, 3.0, i) for i, v in enumerate(values)], "x double, k double, i long")
    cuts = [np.array([-1.0, 0.5, 6.0, 7.0, 9.0]), np.array([])]
    got = features._binned(rows, ["x", "k"], cuts).orderBy("i").toPandas()
    assert got.x.tolist() == np.searchsorted(cuts[0], values).tolist() and got.k.tolist() == [0.0] * 7


def test_selection_modes(spark):
    scores = spark.createDataFrame([("a", 30.0, 1.0, 100.0), ("b", 5.0, 1.0, 100.0), ("c", 0.1, 1.0, 100.0), ("d", 4.2, 1.0, 100.0), ("e", 0.2, 1.0, 100.0)],
                                   "name string, value double, d1 double, d2 double")
    keep = lambda *a: {r["name"] for r in features.select(scores, *a).collect() if r["prime"]}
    assert keep("percentile") == {"a"} and keep("k_best", 2) == {"a", "b"} and keep("k_best") == set("abcde")
    assert keep("fpr") == {"a", "b", "d"} and keep("fwe") == {"a"} and keep("fdr") == {"a"}
    with pytest.raises(ValueError):
        features.select(scores, "best")


def test_training_search_and_comparison(spark):
    df, names = labelled(spark), ["x", "y", "z"]
    for kind in ("logistic", "tree", "forest", "boost", "bayes", "linear svc", "factorization", "perceptron"):
        assert models.train(df, names, "c", kind, key=["id"])[1] > 0.7
    for kind in ("linear", "tree", "forest", "boost", "generalized", "factorization"):
        assert models.train(df, names, "t", kind, False, key=["id"], metric="r2")[1] > 0.3
    _, board = models.search(df, names, "c", "tree", {"maxDepth": "(1, 4, 1)"}, 10)
    assert board.count() == 4
    board, best = models.compare(df, names, "t", ["tree", "linear"], False, 2, ["id"])
    assert board.first()["model"] == "linear" and best.transform(df).count() == 240


def test_search_space_text():
    import random
    space = models.parse_space({"C": "(0.1, 1.0, 0.1)", "depth": "(2, 10)", "kernel": "[linear, rbf]", "x": "8.5", "n": "3"})
    assert len(space["C"]) == 10 and space["C"][-1] == pytest.approx(1.0)
    assert space["kernel"] == ["linear", "rbf"] and space["x"] == [8.5] and space["n"] == [3]
    drawn = models.trials(space, 200, random.Random(0))
    assert len(drawn) == 200 and {t["depth"] for t in drawn} == set(range(2, 11))
    assert all(isinstance(t["depth"], int) for t in drawn)
    assert len({t["C"] for t in models.trials(models.parse_space({"C": "(0.0, 1.0)"}), 10, random.Random(0))}) == 10
    assert len(models.trials(models.parse_space({"C": "[1, 2]", "d": "[1, 2]"}), 10, random.Random(0))) == 4


def test_graph_shares_steps_and_rejects_unknown(spark):
    base = spark.range(10)
    graph = models.Graph({"a": models.Step(lambda: base), "b": models.Step(lambda a: a.where("id > 3"), ("a",)),
                          "c": models.Step(lambda a, b: a.join(b, "id"), ("a", "b"))})
    assert models.run_graph(graph).count() == 6
    with pytest.raises(ValueError):
        models.Graph.of([{"id": "a", "data": {"type": "magic"}}], [], {})


def test_split_is_disjoint_and_whole(spark):
    df = labelled(spark)
    a, b = clean.split(df, 0.3, ["id"])
    assert a.count() + b.count() == 240 and a.join(b, "id").count() == 0 and 40 < b.count() < 110


def test_trend_and_season_from_sums_is_the_direct_solution(spark):
    t = np.arange(60)
    y = 5 + 0.3 * t + np.where(t > 40, t - 40, 0) + np.tile(np.arange(12.0), 5)
    got = [r.forecast for r in forecast.trend_season_regression(series(spark, y), "ts", "v", "D").orderBy("step").collect()]
    np.testing.assert_allclose(got, forecast.seasonal_regression(y, 14, 12)[1], rtol=1e-6)
    got = [r.forecast for r in forecast.trend_season_regression(series(spark, y), "ts", "v", "D", season="mul").orderBy("step").collect()]
    np.testing.assert_allclose(got, forecast.seasonal_regression(y, 14, 12, True)[1], rtol=1e-6)


def test_search_stops_at_the_epoch_limit(spark):
    df = labelled(spark)
    names = [c for c, t in df.dtypes if t == "double" and c not in ("t", "c")][:2]
    best, board = models.search(df, names, "c", "logistic", {"maxIter": "[50, 80]"}, 2, epochs=3)
    assert board.count() == 2 and best.stages[-1].getOrDefault("maxIter") == 3


def test_chaining_and_tails_are_per_series(spark):
    from plumbline.operators import outliers
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k, scale in (("a", 1), ("b", 50)) for i, v in enumerate(rng.normal(0, scale, 80))]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for detect in (lambda d, **o: outliers.chain_outliers(d, ["v"], 5, 0.05, **o), lambda d, **o: outliers.tail_outliers(d, ["v"], 0.05, **o)):
        both = {(r.k, r.i): (r.score, r.outlier) for r in detect(df, keys=["k"]).collect()}
        for k in "ab":
            for r in detect(df.where(F.col("k") == k)).collect():
                assert both[k, r.i][0] == pytest.approx(r.score) and both[k, r.i][1] == r.outlier


def test_span_average_grows_its_sums(spark):
    """Ties, gaps and times before 1970 against all rows of each span; no frame is bounded at both ends, which is read anew for every row."""
    from datetime import datetime, timedelta

    from plumbline.operators import smooth
    draw = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], datetime(1969, 12, 31) + timedelta(minutes=int(m)), None if i % 9 == 0 else float(v))
            for i, (m, v) in enumerate(zip(draw.integers(0, 4000, 300), draw.normal(size=300)))]
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp_ntz, v double")
    out = smooth.moving_average(df, "ts", "v", "2h", "k")
    got = {r.i: r.sma for r in out.collect()}
    for i, k, ts, _ in rows:
        near = [v for _, b, at, v in rows if b == k and v is not None and ts - timedelta(hours=2) < at <= ts]
        assert got[i] == (pytest.approx(np.mean(near), abs=1e-12) if near else None)
    frames = [f for f in out._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f.split(")")[0] for f in frames)


def test_dealt_and_fitted_rows_go_in_bounded_tasks(spark, monkeypatch):
    from plumbline.functions import settings
    monkeypatch.setattr(features, "DEALT_ROWS", 50)
    monkeypatch.setattr(settings, "TASK_ROWS", 100)
    df = spark.range(1000).coalesce(1)
    numbered = features._hash_numbered(df, ["id"], 3)
    got = [r.id for r in numbered.orderBy("_i").collect()]
    assert got == [r.id for r in df.orderBy(F.xxhash64(F.lit(3), "id"), "id").collect()]
    assert sorted(r._i for r in numbered.select("_i").collect()) == list(range(1, 1001))
    assert settings.spread(df).rdd.getNumPartitions() == 10 and settings.spread(df.limit(90)).rdd.getNumPartitions() == 1
    dealt = features._shuffled_column(df.withColumn("v", F.col("id") * 2), "v", ["id"], 1).collect()
    assert sorted(r.v for r in dealt) == [2 * i for i in range(1000)] and sum(r.v == 2 * r.id for r in dealt) < 20
