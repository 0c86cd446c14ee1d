"""Outlier queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import neighbors, outliers as o
from plumbline.plans.registry import query
from plumbline.plans.series import DAILY, HOURLY, daily, hourly, rounded


@query("outlier_quartile", "O1", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value, CAST(value < a - 1.6 * (b - a) OR value > b + 1.6 * (b - a) AS INTEGER) AS value_outlier FROM events, q""")
def _(t):
    return o.quartile_outliers(t("events").select("event_id", "value"), ["value"])


@query("outlier_zscore", "O2", """
WITH q AS (SELECT round(avg(value) - 3 * stddev_samp(value), 3) AS a, round(avg(value) + 3 * stddev_samp(value), 3) AS b FROM events)
SELECT event_id, CASE WHEN value < a THEN 'lower' WHEN value > b THEN 'upper' END AS value_outlier FROM events, q""")
def _(t):
    return o.sigma_outliers(t("events").select("event_id", "value"), ["value"]).select("event_id", "value_outlier")


@query("outlier_density_noise", "O3", """
WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_nationkey / 4.0 AS y FROM supplier),
n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.8),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5)
SELECT s_suppkey, CAST(s_suppkey NOT IN (SELECT n.a FROM n JOIN c ON n.b = c.a) AS INTEGER) AS outlier FROM supplier""")
def _(t):
    df = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 4.0).alias("y"))
    return o.density_outliers(df, ["x", "y"], 0.8, 5).select("s_suppkey", "outlier")


NEAR = """
WITH p AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey / 4.0 AS y FROM supplier),
e AS (SELECT a.i AS a, b.i AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.i <> b.i),
n AS (SELECT a, b, d FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM e) WHERE r <= {k})"""


def suppliers(t):
    return t("supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 4.0).alias("y"))


@query("outlier_neighbours", "O4", NEAR.format(k=5) + """,
s AS (SELECT a, avg(d) AS score FROM n GROUP BY a), q AS (SELECT quantile_cont(score, 0.97) AS lim FROM s)
SELECT a AS s_suppkey, round(score, 8) AS score, CAST(score > lim AS INTEGER) AS outlier FROM s, q""")
def _(t):
    return rounded(o.neighbour_outliers(suppliers(t), ["x", "y"]).select("s_suppkey", "score", "outlier"), 8, "score")


@query("outlier_local_factor", "O5", NEAR.format(k=10) + """,
k AS (SELECT a, max(d) AS kd FROM n GROUP BY a),
l AS (SELECT n.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.b = k.a GROUP BY n.a)
SELECT n.a AS s_suppkey, round(avg(lb.lrd) / max(la.lrd), 8) AS score FROM n JOIN l la ON n.a = la.a JOIN l lb ON n.b = lb.a GROUP BY n.a""")
def _(t):
    return rounded(o.local_outliers(suppliers(t), ["x", "y"], order="s_suppkey").select("s_suppkey", "score"), 8, "score")


@query("outlier_chaining", "O6")
def _(t):
    return o.chain_outliers(suppliers(t), ["x", "y"])


@query("outlier_isolation", "O7 L9")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return o.isolation_outliers(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


SUSPECT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("outlier_suspect", "O8", "WITH " + ", ".join(
    f"q{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem)"
    for i, c in enumerate(SUSPECT)) + """
SELECT l_orderkey, l_linenumber, list_min([""" + ", ".join(
    f"struct_pack(z := -abs(({c} - q{i}.m) / (q{i}.b - q{i}.a)), name := '{c}')" for i, c in enumerate(SUSPECT)) + """]).name AS suspect
FROM lineitem, q0, q1, q2, q3""")
def _(t):
    return o.suspect_column(t("lineitem"), SUSPECT).select("l_orderkey", "l_linenumber", "suspect")


@query("outlier_map", "O9")
def _(t):
    return o.map_outliers(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], epochs=5)


@query("outlier_tails", "O10", """
WITH e AS (SELECT p_partkey, cume_dist() OVER (ORDER BY p_size) AS l1, cume_dist() OVER (ORDER BY p_size DESC) AS r1,
 cume_dist() OVER (ORDER BY p_retailprice) AS l2, cume_dist() OVER (ORDER BY p_retailprice DESC) AS r2 FROM part),
k AS (SELECT skewness(p_size) < 0 AS s1, skewness(p_retailprice) < 0 AS s2 FROM part)
SELECT p_partkey, round(greatest(-ln(l1) - ln(l2), -ln(r1) - ln(r2), -ln(CASE WHEN s1 THEN l1 ELSE r1 END) - ln(CASE WHEN s2 THEN l2 ELSE r2 END)), 8) AS score FROM e, k""")
def _(t):
    return rounded(o.tail_scores(t("part"), ["p_size", "p_retailprice"]).select("p_partkey", "score"), 8, "score")


@query("outlier_ellipse", "O11", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS xx, var_samp(l_extendedprice) AS yy,
 covar_samp(l_quantity, l_extendedprice) AS xy FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, ((l_quantity - mx) * (l_quantity - mx) * yy - 2 * (l_quantity - mx) * (l_extendedprice - my) * xy
 + (l_extendedprice - my) * (l_extendedprice - my) * xx) / (xx * yy - xy * xy) AS s FROM lineitem, m)
SELECT l_orderkey, l_linenumber, round(sqrt(s), 6) AS distance, CAST(s > -2 * ln(1 - 0.975) AS INTEGER) AS outlier FROM d""")
def _(t):
    out = o.ellipse_outliers(t("lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out.select("l_orderkey", "l_linenumber", "distance", "outlier"), 6, "distance")


# --- the same detectors on series values ------------------------------------------------------------------

@query("anomaly_density", "X40", f"""{DAILY}, n AS (SELECT k, ts, v, count(*) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS c FROM d),
t AS (SELECT k, ts, v, max(CASE WHEN c >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 0.5 PRECEDING AND 0.5 FOLLOWING) AS near FROM n)
SELECT k, ts, CAST(1 - near AS INTEGER) AS outlier FROM t""")
def _(t):
    return o.density_outliers(daily(t), ["v"], 0.5, 5, ["k"]).select("k", "ts", "outlier")


@query("anomaly_chaining", "X41")
def _(t):
    return o.chain_outliers(daily(t), ["v"], 15, 0.05, ["k"])


@query("anomaly_tails", "X42", f"""{HOURLY}, g AS (SELECT k, ts, v FROM h WHERE v IS NOT NULL),
e AS (SELECT k, ts, cume_dist() OVER (PARTITION BY k ORDER BY v) AS l, cume_dist() OVER (PARTITION BY k ORDER BY v DESC) AS r FROM g),
s AS (SELECT k, ts, greatest(-ln(l), -ln(r)) AS score FROM e), q AS (SELECT k, quantile_cont(score, 0.95) AS lim FROM s GROUP BY k)
SELECT k, ts, round(score, 8) AS score, CAST(score > lim AS INTEGER) AS outlier FROM s JOIN q USING (k)""")
def _(t):
    df = hourly(t).where(F.col("v").isNotNull())
    return rounded(o.tail_outliers(df, ["v"], keys=["k"]).drop("v"), 8, "score")


@query("cluster_density", "K2", """
WITH RECURSIVE p AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey / 4.0 AS y FROM supplier),
n AS (SELECT a.i AS a, b.i AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b
  ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.8),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a JOIN c ON n.b = c.a),
l AS (SELECT a, min(b) AS root FROM r GROUP BY a),
m AS (SELECT p.i, coalesce(l.root, (SELECT arg_min(l2.root, n.d) FROM n JOIN l l2 ON n.b = l2.a WHERE n.a = p.i)) AS root FROM p LEFT JOIN l ON p.i = l.a)
SELECT i AS s_suppkey, CASE WHEN root IS NULL THEN -1 ELSE min(i) OVER (PARTITION BY root) END AS first_member FROM m""")
def _(t):
    df = suppliers(t)
    out = neighbors.attach(df, ["x", "y"], neighbors.density_clusters(df, ["x", "y"], 0.8, 5))
    first = out.groupBy("cluster").agg(F.min("s_suppkey").alias("first_member"))
    return out.join(first, "cluster").select("s_suppkey", F.when(F.col("cluster") >= 0, F.col("first_member")).otherwise(F.lit(-1).cast("long")).alias("first_member"))


@query("cluster_density_cityblock", "K2", """
WITH RECURSIVE p AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS x, s_nationkey / 4.0 AS y FROM supplier),
n AS (SELECT a.i AS a, b.i AS b, (abs(a.x - b.x) + abs(a.y - b.y)) AS d FROM p a JOIN p b
  ON (abs(a.x - b.x) + abs(a.y - b.y)) <= 0.8),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a JOIN c ON n.b = c.a),
l AS (SELECT a, min(b) AS root FROM r GROUP BY a),
m AS (SELECT p.i, coalesce(l.root, (SELECT arg_min(l2.root, n.d) FROM n JOIN l l2 ON n.b = l2.a WHERE n.a = p.i)) AS root FROM p LEFT JOIN l ON p.i = l.a)
SELECT i AS s_suppkey, CASE WHEN root IS NULL THEN -1 ELSE min(i) OVER (PARTITION BY root) END AS first_member FROM m""")
def _(t):
    df = suppliers(t)
    out = neighbors.attach(df, ["x", "y"], neighbors.density_clusters(df, ["x", "y"], 0.8, 5, metric="cityblock"))
    first = out.groupBy("cluster").agg(F.min("s_suppkey").alias("first_member"))
    return out.join(first, "cluster").select("s_suppkey", F.when(F.col("cluster") >= 0, F.col("first_member")).otherwise(F.lit(-1).cast("long")).alias("first_member"))


WIDE = [f"x{i}" for i in range(8)]


def wide(t):
    """Eight columns of the embeddings."""
    return t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(WIDE)])


EIGHT = f"""p AS (SELECT vec_id AS i, {", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(WIDE))} FROM embeddings)"""
APART = {
    "euclidean": "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in WIDE) + ")",
    "cityblock": " + ".join(f"abs(a.{c} - b.{c})" for c in WIDE),
    "cosine": "1 - (" + " + ".join(f"a.{c} * b.{c}" for c in WIDE) + ") / sqrt(" + " + ".join(f"a.{c} * a.{c}" for c in WIDE) + ") / sqrt("
              + " + ".join(f"b.{c} * b.{c}" for c in WIDE) + ")"}
WIDE_NEAR = """WITH {points}, e AS (SELECT a.i AS a, b.i AS b, {apart} AS d FROM p a JOIN p b ON a.i <> b.i),
n AS (SELECT a, b, d FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM e) WHERE r <= {k})"""


@query("outlier_neighbours_wide", "O4", WIDE_NEAR.format(points=EIGHT, apart=APART["euclidean"], k=5) + """,
s AS (SELECT a, avg(d) AS score FROM n GROUP BY a), q AS (SELECT quantile_cont(score, 0.97) AS lim FROM s)
SELECT a AS vec_id, round(score, 8) AS score, CAST(score > lim AS INTEGER) AS outlier FROM s, q""")
def _(t):
    return rounded(o.neighbour_outliers(wide(t), WIDE).select("vec_id", "score", "outlier"), 8, "score")


@query("outlier_local_factor_cosine", "O5", WIDE_NEAR.format(points=EIGHT, apart=APART["cosine"], k=10) + """,
k AS (SELECT a, max(d) AS kd FROM n GROUP BY a),
l AS (SELECT n.a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.b = k.a GROUP BY n.a),
s AS (SELECT n.a, avg(lb.lrd) / max(la.lrd) AS score FROM n JOIN l la ON n.a = la.a JOIN l lb ON n.b = lb.a GROUP BY n.a),
q AS (SELECT quantile_cont(score, 0.97) AS lim FROM s)
SELECT a AS vec_id, round(score, 6) AS score, CAST(score > lim AS INTEGER) AS outlier FROM s, q""")
def _(t):
    return rounded(o.local_outliers(wide(t), WIDE, metric="cosine").select("vec_id", "score", "outlier"), 6, "score")


WIDE_DENSITY = """WITH RECURSIVE {points},
n AS (SELECT a.i AS a, b.i AS b, {apart} AS d FROM p a JOIN p b ON a.i = b.i OR {apart} <= {eps}),
c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5),
r(a, b) AS (SELECT a, a FROM c UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a JOIN c ON n.b = c.a),
l AS (SELECT a, min(b) AS root FROM r GROUP BY a),
m AS (SELECT p.i, coalesce(l.root, (SELECT arg_min(l2.root, n.d) FROM n JOIN l l2 ON n.b = l2.a WHERE n.a = p.i)) AS root FROM p LEFT JOIN l ON p.i = l.a)"""


def first_members(t, metric, eps):
    df = wide(t)
    out = neighbors.attach(df, WIDE, neighbors.density_clusters(df, WIDE, eps, 5, metric=metric))
    first = out.groupBy("cluster").agg(F.min("vec_id").alias("first_member"))
    return out.join(first, "cluster").select("vec_id", F.when(F.col("cluster") >= 0, F.col("first_member")).otherwise(F.lit(-1).cast("long")).alias("first_member"))


@query("cluster_density_cosine", "K2", WIDE_DENSITY.format(points=EIGHT, apart=APART["cosine"], eps=0.2) + """
SELECT i AS vec_id, CASE WHEN root IS NULL THEN -1 ELSE min(i) OVER (PARTITION BY root) END AS first_member FROM m""")
def _(t):
    return first_members(t, "cosine", 0.2)


@query("cluster_density_wide", "K2", WIDE_DENSITY.format(points=EIGHT, apart=APART["cityblock"], eps=0.5) + """
SELECT i AS vec_id, CASE WHEN root IS NULL THEN -1 ELSE min(i) OVER (PARTITION BY root) END AS first_member FROM m""")
def _(t):
    return first_members(t, "cityblock", 0.5)


@query("outlier_density_wide", "O3", WIDE_DENSITY.format(points=EIGHT, apart=APART["euclidean"], eps=0.21) + """
SELECT i AS vec_id, CAST(root IS NULL AS INTEGER) AS outlier FROM m""")
def _(t):
    return o.density_outliers(wide(t), WIDE, 0.21, 5).select("vec_id", "outlier")
