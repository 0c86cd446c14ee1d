"""Operators whose intermediate results stay small whatever the number of clusters or distinct values."""

import numpy as np
import pytest

from plumbline.operators import metrics, profile


def test_cluster_shape_of_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CENTRES", 300)
    draw = np.random.default_rng(2)
    c = np.arange(6000) % 2000
    centres = draw.normal(size=(2000, 2)) * 50
    centres[7] = centres[8]
    x = centres[c] + draw.normal(size=(6000, 2))
    x[c == 7], x[c == 8] = centres[7], centres[8]    # two clusters with one centre
    frame = spark.createDataFrame([(f"c{k}", *map(float, v)) for k, v in zip(c, x)] + [(None, 0.0, 0.0)], "c string, x double, y double")
    got = metrics.cluster_shape(frame, ["x", "y"], "c").first()
    mean = np.array([x[c == k].mean(0) for k in range(2000)])
    spread = np.array([np.sqrt(((x[c == k] - mean[k]) ** 2).sum(1)).mean() for k in range(2000)])
    apart = np.sqrt(((mean[:, None] - mean) ** 2).sum(-1))
    ratio = np.divide(spread[:, None] + spread, apart, out=np.zeros_like(apart), where=apart > 0)
    assert got.davies_bouldin == pytest.approx(ratio.max(1).mean())
    within, between = ((x - mean[c]) ** 2).sum(), 3 * ((mean - x.mean(0)) ** 2).sum()
    assert got.calinski_harabasz == pytest.approx((between / 1999) / (within / 4000))
    one = metrics.cluster_shape(frame.where("c = 'c5'"), ["x", "y"], "c").first()
    assert one.davies_bouldin is None and one.calinski_harabasz is None


def test_short_domains(spark):
    frame = spark.range(5000).selectExpr("id % 20 AS few", "id % 21 AS many", "id AS every", "CAST(NULL AS int) AS none", "if(id % 2 = 0, 'b', null) AS half").repartition(6)
    got = {r["name"]: r["values"] for r in profile.short_domains(frame, ["few", "many", "every", "none", "half"]).collect()}
    assert got == {"few": sorted(map(str, range(20))), "many": [], "every": [], "none": [], "half": ["b"]}
    least = {r["name"]: r["values"] for r in profile.least_values(frame, ["every", "few"], 3).collect()}
    assert least == {"every": ["0", "1", "10"], "few": ["0", "1", "10"]}
    assert profile.short_domains(frame.where("false"), ["few"]).first()["values"] == []
