"""Neighbours and density by metric partitioning against all pairs."""

import numpy as np
import pytest

from plumbline.operators import metric_space as ms
from plumbline.operators import neighbors


def apart(x, metric):
    a, b = x[:, None], x[None]
    if metric == "cosine":
        length = np.sqrt((x ** 2).sum(1))
        unit = np.where(length[:, None] > 0, x / np.where(length > 0, length, 1)[:, None], 0)
        d = np.maximum(1 - unit @ unit.T, 0)
        d[np.ix_(length == 0, length == 0)] = 0
        return d
    gap = np.abs(a - b)
    if metric == "canberra":
        size = np.abs(a) + np.abs(b)
        return np.where(size > 0, gap / np.where(size > 0, size, 1), 0).sum(-1)
    return {"euclidean": lambda: np.sqrt((gap ** 2).sum(-1)), "cityblock": lambda: gap.sum(-1), "chebyshev": lambda: gap.max(-1)}[metric]()


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(7, 8)) * 3
    x = np.concatenate([centres[draw.integers(7, size=260)] + draw.normal(size=(260, 8)) * 0.3, draw.normal(size=(60, 8)) * 4, np.zeros((1, 8))])
    return np.round(x, 6)


def frame(spark, x, copies=()):
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(10_000 + i, *map(float, x[i])) for i in copies] + [(20_000, None, *[0.0] * (x.shape[1] - 1))]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


def names(x):
    return [f"c{j}" for j in range(x.shape[1])]


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev", "canberra", "cosine"])
def test_nearest(spark, points, metric, monkeypatch):
    monkeypatch.setattr(ms, "BLOCK", 20)
    df = frame(spark, points)
    got = {tuple(r.p): r.near for r in neighbors.nearest(neighbors.weighted_points(df, names(points)), 6, metric).collect()}
    d = apart(points, metric)
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(points)
    for i, v in enumerate(points):
        near = got[tuple(v)]
        assert [n.d for n in near] == pytest.approx(np.sort(d[i])[:6].tolist(), abs=1e-9)
        assert all(n.q != list(v) for n in near)


def test_cells_out_of_reach_are_not_met(spark, points, monkeypatch):
    met = []
    plain = ms.MetricSpace.copied
    monkeypatch.setattr(ms.MetricSpace, "copied", lambda self, *a: met.append(plain(self, *a)) or met[-1])
    ms.nearest(neighbors.weighted_points(frame(spark, points), names(points)), 3).collect()
    cells = int(np.ceil(np.sqrt(len(points))))
    assert met[0].count() < 0.5 * cells * len(points)


@pytest.mark.parametrize("metric, eps", [("euclidean", 0.9), ("cityblock", 2.2), ("canberra", 0.9), ("cosine", 0.01)])
def test_density(spark, points, metric, eps, monkeypatch):
    monkeypatch.setattr(ms, "BLOCK", 25)
    df, copies = frame(spark, points, range(0, 40, 2)), np.isin(np.arange(len(points)), np.arange(0, 40, 2)).astype(int) + 1
    got = {tuple(r.p): r.cluster for r in neighbors.density_clusters(df, names(points), eps, 6, metric=metric).collect()}
    noise = {tuple(r.p): r.outlier for r in neighbors.density_noise(df, names(points), eps, 6, metric=metric).collect()}
    d = apart(points, metric)
    near = d <= eps
    core = near @ copies >= 6
    label = np.where(core, np.arange(len(points)), -1)
    for _ in range(len(points)):
        low = np.where(near & core[:, None] & core, label[None], len(points)).min(1)
        if (label[core] == low[core]).all():
            break
        label = np.where(core, low, -1)
    for i in np.flatnonzero(~core):
        to = np.where(core, d[i], np.inf)
        if to.min() <= eps:
            label[i] = label[to.argmin()]
    assert 2 <= len(set(label[core])) and (label == -1).any() and (~core & (label >= 0)).any() | (metric == "cosine")
    clusters = {}
    for i, v in enumerate(points):
        assert noise[tuple(v)] == int(label[i] == -1) and (got[tuple(v)] == -1) == (label[i] == -1)
        clusters.setdefault(label[i], set()).add(got[tuple(v)])
    assert all(len(c) == 1 for c in clusters.values()) and len(set.union(*clusters.values())) == len(clusters)


def test_few_points_keys_and_unknown_metrics(spark):
    x = np.array([[1.0] * 6, [2.0] * 6, [9.0] * 6])
    df = frame(spark, x).selectExpr("*", "CASE WHEN i < 2 THEN 'a' END AS k")
    got = {(r.k, tuple(r.p)): [n.d for n in r.near] for r in neighbors.nearest(neighbors.weighted_points(df, names(x), ["k"]), 2, "chebyshev", ["k"]).collect()}
    assert got == {("a", tuple(x[0])): [1.0], ("a", tuple(x[1])): [1.0]}
    assert {tuple(r.p): r.cluster for r in neighbors.density_clusters(df, names(x), 2.5, 2).collect()} == {tuple(x[0]): 0, tuple(x[1]): 0, tuple(x[2]): -1}
    none = df.where("false")
    assert neighbors.nearest(neighbors.weighted_points(none, names(x)), 2).count() == 0 and neighbors.density_clusters(none, names(x), 1.0, 2).count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        neighbors.nearest(neighbors.weighted_points(df, names(x)), 2, "braycurtis")


def test_copies_follow_blocks_and_links_follow_balls(spark):
    x = np.random.default_rng(5).normal(size=(4000, 6))
    points = neighbors.weighted_points(frame(spark, x), names(x))
    space = ms.MetricSpace(points, "euclidean")
    anywhere = space.points.selectExpr("*", "CAST('Infinity' AS DOUBLE) AS reach")
    assert space.copied(anywhere, "reach", False).count() <= 32 * len(x)    # of 64 cells
    marked, _, edges = ms.density(points, 1.0, 3)
    balls = marked.where("core").select("ball").distinct().count()
    assert 0 < edges.distinct().count() <= 32 * balls


def test_local_factor_takes_equally_far_rows_by_name(spark):
    rows = [(9, 0.0, 0.0), (5, 1.0, 0.0), (3, -1.0, 0.0), (4, 1.0, 0.0), (7, -1.0, 0.0), (8, 5.0, 1.0), (6, -2.5, 0.0), (2, 4.0, 3.0)]
    k, ids, x = 3, np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {i: [j for j in np.lexsort((ids, d[i])) if j != i][:k] for i in range(len(x))}
    far = {i: d[i][near[i][-1]] for i in near}
    dense = {i: 1 / (np.mean([max(d[i][j], far[j]) for j in near[i]]) + 1e-10) for i in near}
    want = {ids[i]: np.mean([dense[j] for j in near[i]]) / dense[i] for i in near}
    df = spark.createDataFrame(rows, "i long, x double, y double")
    scores = neighbors.local_outlier_factor(df, ["x", "y"], k, order="i")
    got = {r.i: r.score for r in neighbors.attach(df, ["x", "y"], scores).collect()}
    assert got == pytest.approx(want, rel=1e-9)
