"""Clustering, reduction, training and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics, models, reduce
from plumbline.plans.registry import query
from plumbline.plans.series import daily, monthly, rounded
from plumbline.spec import DatasetSpec

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# --- clusters and projections -------------------------------------------------------------------------

@query("cluster_kmeans", "K1")
def _(t):
    out, _ = reduce.kmeans(t("embeddings"), ["embedding"], 2)
    return reduce.cluster_sizes(out)


@query("reduce_pca", "K3")
def _(t):
    return reduce.pca(t("embeddings"), ["embedding"], 2)[0].select("vec_id", "label", "d0", "d1")


@query("reduce_svd", "K4")
def _(t):
    return reduce.svd(t("embeddings"), ["embedding"], 2)[0].select("vec_id", "d0", "d1")


PLANE = """
WITH v AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x, p_retailprice / 1000 + p_size / 30.0 AS y FROM part),
m AS (SELECT {moments} FROM v),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM m),
u AS (SELECT *, b / sqrt(b * b + (lam - a) * (lam - a)) AS ux, (lam - a) / sqrt(b * b + (lam - a) * (lam - a)) AS uy FROM l),
w AS (SELECT *, CASE WHEN (abs(ux) >= abs(uy) AND ux < 0) OR (abs(uy) > abs(ux) AND uy < 0) THEN -1 ELSE 1 END AS s FROM u)
SELECT p_partkey, round(s * ((x - mx) * ux + (y - my) * uy), 6) AS d0 FROM v, w"""


def plane(t):
    return t("part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 1000 + F.col("p_size") / 30.0).alias("y"))


@query("reduce_pca_plane", "K3", PLANE.format(moments="avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b"))
def _(t):
    return rounded(reduce.pca(plane(t), ["x", "y"], 1)[0].select("p_partkey", "d0"), 6, "d0")


@query("reduce_svd_plane", "K4", PLANE.format(moments="0 AS mx, 0 AS my, sum(x * x) AS a, sum(y * y) AS c, sum(x * y) AS b"))
def _(t):
    return rounded(reduce.svd(plane(t), ["x", "y"], 1)[0].select("p_partkey", "d0"), 6, "d0")


@query("reduce_lda_plane", "K6", """
WITH v AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'O' ELSE 'F' END AS c, p_size / 10.0::DOUBLE AS x, length(p_name) / 10.0 + p_size / 30.0 AS y FROM part),
g AS (SELECT c, avg(x) AS gx, avg(y) AS gy FROM v GROUP BY c), t AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM v),
s AS (SELECT sum((x - gx) * (x - gx)) AS a, sum((x - gx) * (y - gy)) AS b, sum((y - gy) * (y - gy)) AS d FROM v JOIN g ON v.c = g.c),
q AS (SELECT max(gx) FILTER (WHERE c = 'O') - max(gx) FILTER (WHERE c = 'F') AS dx, max(gy) FILTER (WHERE c = 'O') - max(gy) FILTER (WHERE c = 'F') AS dy FROM g),
w AS (SELECT (d * dx - b * dy) / (a * d - b * b) AS wx, (a * dy - b * dx) / (a * d - b * b) AS wy, a, b, d, n, mx, my FROM s, q, t),
z AS (SELECT mx, my, wx * k AS wx, wy * k AS wy FROM (SELECT *, sqrt(n - 2) / sqrt(wx * wx * a + 2 * wx * wy * b + wy * wy * d)
  * CASE WHEN (abs(wx) >= abs(wy) AND wx < 0) OR (abs(wy) > abs(wx) AND wy < 0) THEN -1 ELSE 1 END AS k FROM w))
SELECT p_partkey, round((x - mx) * wx + (y - my) * wy, 4) + 0.0 AS d0 FROM v, z""")
def _(t):
    df = t("part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.length("p_name") / 10.0 + F.col("p_size") / 30.0).alias("y"),
                          F.when(F.col("p_size") > 25, "O").otherwise("F").alias("c"))
    return rounded(reduce.lda(df, ["x", "y"], "c")[0].select("p_partkey", "d0"), 4, "d0")


@query("reduce_ica", "K5")
def _(t):
    return reduce.ica(t("lineitem"), NUMERIC, 2, iterations=30)[0].select("l_orderkey", "l_linenumber", "d0", "d1")


@query("reduce_lda", "K6")
def _(t):
    return reduce.lda(t("embeddings"), ["embedding"], "label", 2)[0].select("vec_id", "label", "d0", "d1")


@query("reduce_display", "V1")
def _(t):
    return reduce.display(t("lineitem"), NUMERIC, "l_returnflag")


@query("reduce_component_bands", "V2", """
SELECT 'd0' AS name, round(avg(l_quantity), 6) AS centre, round(avg(l_quantity) - stddev_pop(l_quantity), 6) AS low_2,
 round(avg(l_quantity) + stddev_pop(l_quantity), 6) AS high_2, round(avg(l_quantity) - 4 * stddev_pop(l_quantity), 6) AS low_8,
 round(avg(l_quantity) + 4 * stddev_pop(l_quantity), 6) AS high_8 FROM lineitem
UNION ALL SELECT 'd1', round(avg(l_tax), 6), round(avg(l_tax) - stddev_pop(l_tax), 6), round(avg(l_tax) + stddev_pop(l_tax), 6),
 round(avg(l_tax) - 4 * stddev_pop(l_tax), 6), round(avg(l_tax) + 4 * stddev_pop(l_tax), 6) FROM lineitem""")
def _(t):
    parts = t("lineitem").select(F.col("l_quantity").alias("d0"), F.col("l_tax").alias("d1"))
    return rounded(reduce.component_bands(parts, ["d0", "d1"]), 6, "centre", "low_2", "high_2", "low_8", "high_8")


@query("reduce_component_values", "J7", """
SELECT p_partkey, p_size, p_retailprice, 'd0' AS name, p_size * 2.0::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, p_size, p_retailprice, 'd1', p_retailprice / 2 FROM part""")
def _(t):
    parts = t("part").withColumn("d0", F.col("p_size") * 2.0).withColumn("d1", F.col("p_retailprice") / 2)
    return reduce.component_values(parts, ["p_partkey"], ["d0", "d1"], ["p_size", "p_retailprice"])


@query("cluster_series", "X45")
def _(t):
    return reduce.cluster_series(daily(t), "k", "ts", "v")[0].select("k", "cluster")


@query("cluster_series_density", "X46")
def _(t):
    return reduce.cluster_series_by_density(daily(t), "k", "ts", "v", 40.0, 2)[0]


@query("reduce_series", "X47")
def _(t):
    return reduce.reduce_series(t("lineitem").select("l_returnflag", *NUMERIC), "l_returnflag", NUMERIC)


# --- training -----------------------------------------------------------------------------------------

def labelled(t):
    docs = t("documents").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^ ]", "")).alias("spaces"),
                                 F.length(F.regexp_replace("text", "[^\n]", "")).alias("lines"))
    return docs.join(t("labels"), "doc_id")


TEXT = ["n_chars", "spaces", "lines"]


@query("model_train_classifier", "L1")
def _(t):
    return models.train(labelled(t), TEXT, "quality", "forest", key=["doc_id"])[2].select("doc_id", "quality", "prediction")


@query("model_train_regressor", "L1")
def _(t):
    df = t("lineitem").select("l_orderkey", *NUMERIC)
    said = models.train(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "linear", False, key=["l_orderkey"])[2]
    return said.select("l_orderkey", "l_extendedprice", "prediction")


@query("model_train_boost", "L2")
def _(t):
    return models.train(labelled(t), TEXT, "quality", "boost", key=["doc_id"])[2].select("doc_id", "quality", "prediction")


@query("model_search", "L4")
def _(t):
    space = {"regParam": "(0.0, 0.2, 0.1)", "elasticNetParam": "[0.0, 1.0]"}
    return models.search(labelled(t), TEXT, "quality", "logistic", space, 4)[1]


@query("model_search_stop", "L5")
def _(t):
    space = {"maxDepth": "(2, 6)", "minInstancesPerNode": "[1, 5]"}
    return models.search(labelled(t), TEXT, "quality", "tree", space, 6, stop=0.5, parallelism=2)[1]


@query("model_compare_classifiers", "L6")
def _(t):
    return models.compare(labelled(t), TEXT, "quality", ["logistic", "tree", "bayes"], folds=2, key=["doc_id"])[0]


@query("model_compare_regressors", "L7")
def _(t):
    return models.compare(t("lineitem").select("l_orderkey", *NUMERIC), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice",
                          ["linear", "tree"], False, folds=2, key=["l_orderkey"])[0]


@query("model_assign_clusters", "L8")
def _(t):
    return reduce.cluster_sizes(models.assign_clusters(t("lineitem").select(*NUMERIC), NUMERIC, 3)[0])


@query("model_score_rows", "L12")
def _(t):
    df = t("orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    spec = DatasetSpec.of([{"name": "o_totalprice", "attr": "conti", "scale": "std"}, {"name": "o_orderpriority", "attr": "cat", "encode": "ordinal"},
                           {"name": "o_orderstatus", "attr": "cat", "target": True}])
    fitted, model, _ = models.fit_and_train(df, spec, "tree")
    return models.score_rows(df, fitted, model).select("o_totalprice", "o_orderpriority", "prediction")


@query("model_step_graph", "L14", """
WITH c AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_mktsegment, count(*) AS customers, round(sum(spent), 2) AS spent FROM customer JOIN c ON c_custkey = o_custkey GROUP BY 1""")
def _(t):
    kinds = {"source": lambda data: t(data["table"]),
             "proc": lambda df, data: df.where(data["where"]).groupBy(data["by"]).agg(F.sum(data["sum"]).alias("spent")),
             "ml": lambda a, b, data: a.join(b, a["c_custkey"] == b["o_custkey"]).groupBy("c_mktsegment").agg(
                 F.count(F.lit(1)).alias("customers"), F.round(F.sum("spent"), 2).alias("spent"))}
    node = lambda i, kind, **data: {"id": i, "data": {"type": kind, "data": data}}
    edge = lambda a, b: {"source": {"cell": a}, "target": {"cell": b}}
    graph = models.Graph.of([node("c", "source", table="customer"), node("o", "source", table="orders"),
                             node("p", "proc", where="o_orderstatus = 'F'", by="o_custkey", sum="o_totalprice"), node("r", "ml")],
                            [edge("c", "r"), edge("o", "p"), edge("p", "r")], kinds)
    return models.run_graph(graph)


# --- metrics ------------------------------------------------------------------------------------------

SAID = "SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS p FROM orders"


def said(t):
    p = F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 150000, "O").otherwise("P")
    return t("orders").select(F.col("o_orderstatus").alias("y"), p.alias("p"))


@query("metric_regression", "L11", """
WITH v AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(avg(pow(ln(1 + y) - ln(1 + p), 2)), 6) AS msle, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2,
 round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance, round(avg(abs(y - p) / y), 6) AS mape,
 round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) AS rmsle, round(max(abs(y - p)), 4) AS max_error, round(quantile_cont(abs(y - p), 0.5), 4) AS median_error,
 round(avg(2 * (y * ln(y / p) - y + p)), 4) AS poisson_deviance, round(avg(2 * (ln(p / y) + y / p - 1)), 6) AS gamma_deviance FROM v""")
def _(t):
    df = t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = metrics.regression_scores(df, "y", "p").withColumn("mse", F.round("mse", 2))
    out = rounded(out, 6, "msle", "r2", "explained_variance", "mape", "rmsle", "gamma_deviance")
    return rounded(out, 4, "mae", "rmse", "max_error", "median_error", "poisson_deviance")


@query("metric_confusion", "L11", f"SELECT y AS label, p AS prediction, count(*) AS n FROM ({SAID}) GROUP BY 1, 2")
def _(t):
    return metrics.confusion(said(t), "y", "p")


@query("metric_classes", "L11", f"""
WITH v AS ({SAID}), c AS (SELECT DISTINCT y AS class FROM v)
SELECT class, count(*) FILTER (WHERE y = class) AS support, round(count(*) FILTER (WHERE y = class AND p = class) / count(*) FILTER (WHERE p = class), 8) AS precision,
 round(count(*) FILTER (WHERE y = class AND p = class) / count(*) FILTER (WHERE y = class), 8) AS recall,
 round(2 * count(*) FILTER (WHERE y = class AND p = class) / (count(*) FILTER (WHERE p = class) + count(*) FILTER (WHERE y = class)), 8) AS f1
FROM v, c GROUP BY class""")
def _(t):
    return rounded(metrics.class_scores(said(t), "y", "p").drop("hits"), 8, "precision", "recall", "f1")


@query("metric_classification", "L11", f"""
WITH v AS ({SAID}), c AS (SELECT DISTINCT y AS class FROM v), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = p) AS hit FROM v),
s AS (SELECT class, count(*) FILTER (WHERE y = class) AS t, count(*) FILTER (WHERE p = class) AS q, count(*) FILTER (WHERE y = class AND p = class) AS h FROM v, c GROUP BY class),
k AS (SELECT sum(t::DOUBLE * q) AS e FROM s)
SELECT round(max(hit) / max(n), 8) AS accuracy, round(avg(h / t), 8) AS balanced_accuracy, round(avg(h / q), 8) AS macro_precision, round(avg(h / t), 8) AS macro_recall,
 round(avg(2 * h / (q + t)), 8) AS macro_f1, round(sum(h / q * t) / max(n), 8) AS weighted_precision, round(sum(h) / max(n), 8) AS weighted_recall,
 round(sum(2 * h / (q + t) * t) / max(n), 8) AS weighted_f1, round((max(hit) / max(n) - max(e) / (max(n)::DOUBLE * max(n))) / (1 - max(e) / (max(n)::DOUBLE * max(n))), 8) AS kappa FROM s, n, k""")
def _(t):
    out = metrics.classification_scores(said(t), "y", "p")
    return rounded(out, 8, *out.columns)


@query("metric_binary", "L11", """
WITH v AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice / 600000 AS p FROM orders),
r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM v),
n AS (SELECT sum(y)::DOUBLE AS a, (count(*) - sum(y))::DOUBLE AS b FROM v),
h AS (SELECT p, sum(y)::DOUBLE AS t, sum(sum(y)) OVER (ORDER BY p DESC) AS ct, sum(count(*)) OVER (ORDER BY p DESC) AS cn FROM v GROUP BY p)
SELECT (SELECT round(sum(t * ct / cn) / (SELECT a FROM n), 8) FROM h) AS average_precision, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, round(avg((p - y) * (p - y)), 8) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 8) AS accuracy,
 round((sum(CASE WHEN y = 1 THEN r END) - max(a) * (max(a) + 1) / 2) / (max(a) * max(b)), 8) AS auc FROM r, n""")
def _(t):
    df = t("orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 600000).alias("p"))
    return rounded(metrics.binary_scores(df, "y", "p"), 8, "average_precision", "log_loss", "brier", "accuracy", "auc")


@query("metric_ranking", "L11", """
WITH v AS (SELECT l_orderkey AS g, CAST(l_quantity >= 25 AS INTEGER) + CAST(l_quantity >= 40 AS INTEGER) AS rel, l_extendedprice AS s FROM lineitem),
a AS (SELECT g, rel, row_number() OVER (PARTITION BY g ORDER BY s DESC, rel) AS r, row_number() OVER (PARTITION BY g ORDER BY rel DESC) AS b FROM v),
q AS (SELECT g, sum(CASE WHEN r <= 5 THEN (pow(2, rel) - 1) / log2(r + 1) END) AS dcg, sum(CASE WHEN b <= 5 THEN (pow(2, rel) - 1) / log2(b + 1) END) AS ideal,
 avg(CASE WHEN r <= 5 THEN CASE WHEN rel > 0 THEN 1.0 ELSE 0 END END) AS pr, min(CASE WHEN r <= 5 AND rel > 0 THEN r END) AS f FROM a GROUP BY g)
SELECT round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 8) AS ndcg, round(avg(pr), 8) AS precision, round(avg(coalesce(1.0 / f, 0)), 8) AS mrr FROM q""")
def _(t):
    rel = (F.col("l_quantity") >= 25).cast("int") + (F.col("l_quantity") >= 40).cast("int")
    df = t("lineitem").select(F.col("l_orderkey").alias("g"), rel.alias("rel"), F.col("l_extendedprice").alias("s"))
    return rounded(metrics.ranking_scores(df, "g", "rel", "s", 5), 8, "ndcg", "precision", "mrr")


@query("metric_cluster_agreement", "L11", f"""
WITH v AS ({SAID}), c AS (SELECT y, p, count(*)::DOUBLE AS n FROM v GROUP BY 1, 2), w AS (SELECT sum(n) AS n FROM c),
a AS (SELECT y, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT p, sum(n) AS n FROM c GROUP BY 1),
x AS (SELECT w.n, (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb,
 (SELECT -sum(a.n / w.n * ln(a.n / w.n)) FROM a) AS ha, (SELECT -sum(b.n / w.n * ln(b.n / w.n)) FROM b) AS hb,
 (SELECT sum(c.n / w.n * ln(c.n * w.n / (a.n * b.n))) FROM c JOIN a USING (y) JOIN b USING (p)) AS mi, w.n * (w.n - 1) / 2 AS t FROM w)
SELECT round((t + 2 * s - sa - sb) / t, 8) AS rand, round((s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 8) AS adjusted_rand, round(mi, 8) AS mutual_info,
 round(mi / ha, 8) AS homogeneity, round(mi / hb, 8) AS completeness, round(2 * mi / ha * mi / hb / (mi / ha + mi / hb), 8) AS v_measure,
 round(s / sqrt(sa * sb), 8) AS fowlkes_mallows FROM x""")
def _(t):
    out = metrics.cluster_agreement(said(t), "y", "p")
    return rounded(out, 8, *out.columns)


@query("metric_cluster_shape", "L11", """
WITH v AS (SELECT l_returnflag AS c, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), g AS (SELECT avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM v),
m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM v GROUP BY c),
w AS (SELECT v.c, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS s, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS ss FROM v JOIN m ON v.c = m.c GROUP BY v.c),
r AS (SELECT a.c, max((wa.s + wb.s) / sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my))) AS r
 FROM m a JOIN m b ON a.c <> b.c JOIN w wa ON wa.c = a.c JOIN w wb ON wb.c = b.c GROUP BY a.c)
SELECT round((SELECT sum(m.n * ((mx - gx) * (mx - gx) + (my - gy) * (my - gy))) FROM m, g) / 2 / ((SELECT sum(ss) FROM w) / (n - 3)), 4) AS calinski_harabasz,
 round((SELECT avg(r) FROM r), 4) AS davies_bouldin FROM g""")
def _(t):
    df = t("lineitem").select(F.col("l_returnflag").alias("c"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(metrics.cluster_shape(df, ["x", "y"], "c"), 4, "calinski_harabasz", "davies_bouldin")
