"""Series clusters on long rows against the definitions, on whole vectors."""

import numpy as np
import pytest

from plumbline.operators import series_clusters as sc


@pytest.fixture(scope="module")
def waves():
    draw = np.random.default_rng(5)
    base = np.sin(np.arange(300) / 9), np.cos(np.arange(300) / 5), np.linspace(-2, 2, 300)
    return np.array([base[i % 3] + draw.normal(size=300) * 0.2 for i in range(21)])


def frame(spark, x):
    rows = [(f"s{i:02d}", f"2024-{j:05d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows + [("s00", "2024-00300", None)], "k string, ts string, v double").repartition(4)


def test_cluster_series(spark, waves):
    out, centres, score = sc.cluster_series(frame(spark, waves), "k", "ts", "v", 3)
    label = np.array([r.cluster for r in out.orderBy("k").collect()])
    assert all(len(set(label[i::3])) == 1 for i in range(3)) and len(set(label)) == 3
    middle = {c: waves[label == c].mean(0) for c in set(label)}
    got = {(r.cluster, r.place): r.value for r in centres.collect()}
    assert len(got) == 900 and all(got[c, j] == pytest.approx(m[j]) for c, m in middle.items() for j in range(300))
    d = ((waves[:, None] - waves) ** 2).sum(-1)
    want = []
    for i in range(21):
        a = d[i, label == label[i]].sum() / 6
        b = min(d[i, label == c].mean() for c in middle if c != label[i])
        want.append((b - a) / max(a, b))
    assert score == pytest.approx(np.mean(want))


def test_more_clusters_than_different_series_and_one_cluster(spark):
    x = np.repeat(np.array([[1.0, 2.0, 3.0], [9.0, 9.0, 9.0]]), 2, axis=0)
    out, centres, score = sc.cluster_series(frame(spark, x), "k", "ts", "v", 4)
    assert [r.cluster for r in out.orderBy("k").collect()] in ([0, 0, 1, 1], [1, 1, 0, 0]) and score == pytest.approx(1.0)
    assert sc.cluster_series(frame(spark, x), "k", "ts", "v", 1)[2] is None
    with pytest.raises(ValueError, match="no series"):
        sc.cluster_series(frame(spark, x).where("v IS NULL"), "k", "ts", "v")


def test_components_by_products(spark, waves, monkeypatch):
    rows = sc.placed(frame(spark, waves), "k", "ts", "v")
    got = np.array([[r.d0, r.d1] for r in sc.series_components(rows, "k").orderBy("k").collect()])
    x = waves - waves.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)
    assert rows.where("place >= 300").count() == 0 and rows.count() == 21 * 300
