"""Distribution, variance and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import stats as s
from plumbline.plans.profiles import NULLED, events_with_nulls, stacked
from plumbline.plans.registry import query
from plumbline.plans.series import rounded
from plumbline.spec import DatasetSpec

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLES = f"(SELECT event_type, user_id, {NULLED} FROM events)"


@query("quality_overview", "D1", f"""
WITH e AS (SELECT * FROM {HOLES}), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS m FROM e),
d AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM e))
SELECT 'Valid' AS name, n - m - (n - u) AS rows FROM a, d UNION ALL SELECT 'Missing', m FROM a UNION ALL SELECT 'Duplicate', n - u FROM a, d""")
def _(t):
    return s.quality_overview(events_with_nulls(t).select("event_type", "user_id", "value"))


@query("quality_roles", "D1", f"""
SELECT * FROM (VALUES ('Continuous', 1), ('Discrete', 1), ('Category', 1), ('Datetime', 1), ('Coordinate', 0), ('Invalid', 1)) AS r(name, fields)
UNION ALL SELECT 'Rows', CAST(count(*) AS INTEGER) FROM events""")
def _(t):
    spec = DatasetSpec.of([{"name": "value", "attr": "conti"}, {"name": "user_id", "attr": "disc"}, {"name": "event_type", "attr": "cat"},
                           {"name": "ts", "attr": "date"}, {"name": "absent", "attr": "conti"}])
    rows = t("events").agg(F.lit("Rows").alias("name"), F.count(F.lit(1)).cast("int").alias("fields"))
    return s.role_table(t("events"), spec).union(rows)


@query("quality_missing_histogram", "D3", f"""
SELECT CAST((value IS NULL)::INT + (event_type IS NULL)::INT AS INTEGER) AS missing, count(*) AS rows FROM (
SELECT nullif(event_type, 'click') AS event_type, value FROM {HOLES}) WHERE value IS NULL OR event_type IS NULL GROUP BY 1""")
def _(t):
    df = events_with_nulls(t).select(F.nullif(F.col("event_type"), F.lit("click")).alias("event_type"), "value")
    return s.missing_histogram(df)


@query("quality_missing_outliers", "D4 J6", f"""
WITH e AS (SELECT event_type, value FROM {HOLES}),
q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e)
SELECT 'event_type' AS name, count(*) - count(event_type) AS miss, -1 AS "outer" FROM e
UNION ALL SELECT 'value', count(*) - count(value), count(*) FILTER (WHERE value < a - 1.6 * (b - a) OR value > b + 1.6 * (b - a)) FROM e, q""")
def _(t):
    out = s.missing_and_outliers(events_with_nulls(t).select("event_type", "value"), ["value"])
    return out.withColumn("outer", F.coalesce("outer", F.lit(-1).cast("long")))


BOX = """
WITH b AS ({}),
f AS (SELECT *, pct25 - 1.5 * (pct75 - pct25) AS lower, pct75 + 1.5 * (pct75 - pct25) AS upper FROM b),
v AS ({}),
o AS (SELECT v.k, v.name, count(*) AS outliers FROM v JOIN f USING (k, name) WHERE value < lower OR value > upper GROUP BY 1, 2)
SELECT f.k AS {}, f.name, count, round(mean, 6) AS mean, round(std, 6) AS std, min, round(pct25, 6) AS pct25, round(median, 6) AS median,
 round(pct75, 6) AS pct75, max, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(outliers, 0) AS outliers
FROM f LEFT JOIN o ON f.k = o.k AND f.name = o.name""".format(
    stacked("""SELECT l_returnflag AS k, '{c}' AS name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
quantile_cont({c}, 0.25) AS pct25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS pct75, max({c}) AS max
FROM lineitem GROUP BY l_returnflag""", NUMERIC),
    stacked("SELECT l_returnflag AS k, '{c}' AS name, {c} AS value FROM lineitem", NUMERIC), "l_returnflag")


@query("distribution_box", "D5", BOX)
def _(t):
    out = s.box_statistics(t("lineitem"), NUMERIC, "l_returnflag")
    return rounded(out, 6, "mean", "std", "pct25", "median", "pct75", "lower", "upper")


DENSITY = """
WITH e AS ({rows}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
h AS (SELECT k, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM e GROUP BY k),
c AS (SELECT k, v, count(*) AS w FROM e GROUP BY 1, 2),
g AS (SELECT i, lo + i * ((hi - lo) / {last}) AS x FROM m, generate_series(0, {last}) r(i))
SELECT c.k AS {key}, round(x, 6) AS x, round(sum(w * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density
FROM c JOIN h USING (k), g GROUP BY c.k, x"""


@query("distribution_density", "D10", DENSITY.format(rows="SELECT event_type AS k, value AS v FROM events", key="event_type", last=99))
def _(t):
    out = s.density(t("events"), "value", ["event_type"])
    return out.select("event_type", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("distribution_ridge", "D13", DENSITY.format(rows=stacked("SELECT '{c}' AS k, {c} AS v FROM lineitem", ["l_discount", "l_tax"]), key="name", last=19))
def _(t):
    out = s.ridge(t("lineitem"), ["l_discount", "l_tax"], 20)
    return out.select("name", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("distribution_violin", "D6", DENSITY.format(rows="SELECT p_type AS k, p_retailprice AS v FROM part", key="p_type", last=49))
def _(t):
    out = s.violin(t("part"), ["p_retailprice"], "p_type", 50)[1]
    return out.select("p_type", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("distribution_references", "D11", """
WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 99 AS w, avg(value) AS a, stddev_samp(value) AS s FROM events),
g AS (SELECT lo + i * w AS x, a, s FROM m, generate_series(0, 99) r(i))
SELECT round(x, 6) AS x, round(exp(-((x - a) / s) * ((x - a) / s) / 2) / (s * sqrt(2 * pi())), 8) AS normal,
round(CASE WHEN x > a THEN exp(-(ln(x - a) / s) * (ln(x - a) / s) / 2) / ((x - a) * s * sqrt(2 * pi())) ELSE 0 END, 8) AS lognormal,
round(CASE WHEN x >= a THEN exp(-(x - a) / s) / s ELSE 0 END, 8) AS exponential, round(exp(-abs(x - a) / s) / (2 * s), 8) AS laplace FROM g""")
def _(t):
    return rounded(rounded(s.reference_densities(t("events"), "value"), 8, "normal", "lognormal", "exponential", "laplace"), 6, "x")


@query("distribution_histogram", "D12", """
WITH m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
b AS (SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS rows FROM orders, m GROUP BY 1, 2)
SELECT o_orderstatus, bin, round(lo + bin * w, 4) AS "left", rows FROM b, m""")
def _(t):
    return rounded(s.histogram(t("orders"), "o_totalprice", 30, "o_orderstatus"), 4, "left")


@query("distribution_density_2d", "D14", """
WITH m AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 20 AS u, min(l_extendedprice) AS b,
 (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / u), 19) AS INTEGER) AS x_bin, CAST(least(floor((l_extendedprice - b) / w), 19) AS INTEGER) AS y_bin,
 count(*) AS rows FROM lineitem, m GROUP BY 1, 2""")
def _(t):
    return s.density_2d(t("lineitem"), "l_quantity", "l_extendedprice")


@query("variance_rank", "D15", stacked("SELECT '{c}' AS name, round(var_samp({c}), 6) AS variance FROM lineitem", ["l_quantity", "l_discount", "l_tax"]))
def _(t):
    return rounded(s.variance_rank(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]), 6, "variance")


@query("anova_groups", "D7", stacked("""SELECT l_returnflag, '{c}' AS name, count({c}) AS count, round(avg({c}), 6) AS mean,
round(stddev_samp({c}), 6) AS std FROM lineitem GROUP BY l_returnflag""", NUMERIC))
def _(t):
    return rounded(s.anova_groups(t("lineitem"), NUMERIC, "l_returnflag", "mean"), 6, "mean", "std")


ONE_WAY = """
WITH v AS ({}), g AS (SELECT name, c, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM v GROUP BY 1, 2),
t AS (SELECT name, avg(v) AS a FROM v GROUP BY 1),
x AS (SELECT name, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(w) AS ssw, sum(n * (m - a) * (m - a)) AS ssb FROM g JOIN t USING (name) GROUP BY 1)
"""
FLAGGED = stacked("SELECT '{c}' AS name, l_returnflag || l_linestatus AS c, {c} AS v FROM lineitem", NUMERIC)


@query("anova_one_way", "D7 G1", ONE_WAY.format(FLAGGED) + "SELECT name, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f FROM x")
def _(t):
    df = t("lineitem").withColumn("c", F.concat("l_returnflag", "l_linestatus"))
    return s.anova_f(df, NUMERIC, "c").select("name", "k", "n", F.round("f", 4).alias("f"))


@query("anova_levels", "D7")
def _(t):
    return s.anova(t("lineitem").withColumn("c", F.concat("l_returnflag", "l_linestatus")), NUMERIC, "c")


@query("anova_effect_size", "D9", ONE_WAY.format(FLAGGED) + """SELECT name, round((ssb - (k - 1) * (ssw / (n - k))) / (ssb + 2 * ssw), 7) AS omega_sq,
round(ssb / (ssb + ssw), 7) AS eta_sq FROM x""")
def _(t):
    df = t("lineitem").withColumn("c", F.concat("l_returnflag", "l_linestatus"))
    return s.effect_sizes(s.anova_f(df, NUMERIC, "c")).select("name", F.round("omega_sq", 7).alias("omega_sq"), F.round("eta_sq", 7).alias("eta_sq"))


@query("anova_factors", "D8 D9", """
WITH v AS (SELECT l_returnflag AS a, CAST(l_linestatus = 'O' AS INTEGER) AS b, ln(l_extendedprice) AS y FROM lineitem),
g AS (SELECT a, b, y, y - avg(y) OVER (PARTITION BY a) AS ry, b - avg(b) OVER (PARTITION BY a) AS rb, avg(y) OVER (PARTITION BY a) AS m FROM v),
s AS (SELECT count(*) AS n, var_pop(y) * count(*) AS total, sum((m - t.mean) * (m - t.mean)) AS s1, pow(sum(rb * ry), 2) / sum(rb * rb) AS s2
 FROM g, (SELECT avg(y) AS mean FROM v) t),
e AS (SELECT *, total - s1 - s2 AS rest, n - 4 AS free FROM s)
SELECT 'l_returnflag' AS name, 2.0::DOUBLE AS df, round(s1, 6) AS sum_sq, round(s1 / 2 / (rest / free), 5) AS f, round((s1 - 2 * rest / free) / (total + rest), 9) AS omega_sq,
 pow(1 + 2 * (s1 / 2 / (rest / free)) / free, -free / 2) < 0.01 AS high FROM e
UNION ALL SELECT 'l_linestatus', 1.0, round(s2, 6), round(s2 / (rest / free), 5), round((s2 - rest / free) / (total + rest), 9), s2 / (rest / free) > 6.6349 FROM e""")
def _(t):
    out = s.factor_anova(t("lineitem").withColumn("y", F.ln("l_extendedprice")), "y", ["l_returnflag", "l_linestatus"])
    return out.select("name", "df", F.round("sum_sq", 6).alias("sum_sq"), F.round("f", 5).alias("f"), F.round("omega_sq", 9).alias("omega_sq"),
                      (F.col("level") == "high").alias("high"))


@query("anova_three_factors", "D8 D9")
def _(t):
    return s.factor_anova(t("lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("anova_many_levels", "D8 D9", """
WITH v AS (SELECT l_orderkey AS a, CAST(l_returnflag = 'R' AS INTEGER) AS b, l_extendedprice AS y FROM lineitem),
g AS (SELECT y, y - avg(y) OVER (PARTITION BY a) AS ry, b - avg(b) OVER (PARTITION BY a) AS rb, avg(y) OVER (PARTITION BY a) AS m FROM v),
s AS (SELECT count(*) AS n, var_pop(y) * count(*) AS total, sum((m - t.mean) * (m - t.mean)) AS s1, pow(sum(rb * ry), 2) / sum(rb * rb) AS s2
 FROM g, (SELECT avg(y) AS mean FROM v) t),
e AS (SELECT s.*, l.k - 1 AS d1, n - l.k - 1 AS free, total - s1 - s2 AS rest FROM s, (SELECT count(DISTINCT a) AS k FROM v) l)
SELECT 'l_orderkey' AS name, CAST(d1 AS DOUBLE) AS df, round((s1 / d1) / (rest / free), 6) AS f, round(s1 / total, 8) AS eta_sq FROM e
UNION ALL SELECT 'returned', 1.0, round(s2 / (rest / free), 6), round(s2 / total, 8) FROM e""")
def _(t):
    rows = t("lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    out = s.factor_anova(rows, "l_extendedprice", ["l_orderkey", "returned"])
    return out.select("name", "df", F.round("f", 6).alias("f"), F.round("eta_sq", 8).alias("eta_sq"))


PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[:i + 1]]


def matrix_sql(template: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, {template.format(a=a, b=b)} AS value FROM lineitem" for a, b in PAIRS)


@query("correlation_pearson", "D17", matrix_sql("round(corr({a}, {b}), 2) + 0.0"))
def _(t):
    return s.correlation_matrix(t("lineitem"), NUMERIC)


RANKED = "WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUMERIC) + " FROM lineitem)\n"


@query("correlation_spearman", "D18", RANKED + matrix_sql("round(corr({a}, {b}), 4) + 0.0").replace("FROM lineitem", "FROM r"))
def _(t):
    return s.correlation_matrix(t("lineitem"), NUMERIC, "spearman", 4)


@query("correlation_kendall", "D19", """
WITH c AS (SELECT l_discount AS x, l_tax AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.n * b.n ELSE 0 END) / 2 AS con,
  sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.n * b.n ELSE 0 END) / 2 AS dis FROM c a, c b),
w AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY x)),
ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round((con - dis) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau FROM p, w, tx, ty""")
def _(t):
    return rounded(s.kendall(t("lineitem"), "l_discount", "l_tax"), 6, "tau")


@query("covariance_matrix", "D20", matrix_sql("round(covar_samp({a}, {b}), 2) + 0.0"))
def _(t):
    return s.covariance_matrix(t("lineitem"), NUMERIC)


@query("correlation_target", "D16", stacked("SELECT '{c}' AS name, round(abs(corr({c}, l_extendedprice)), 3) AS value FROM lineitem", ["l_quantity", "l_discount", "l_tax"]))
def _(t):
    return s.target_correlation(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("scatter_rows", "D21", "SELECT l_quantity, l_extendedprice, l_returnflag, l_tax FROM lineitem")
def _(t):
    return s.scatter(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", errors=["l_tax"])


def marginal_sql(table: str, names: tuple[str, ...], cat: str = "") -> str:
    return "\nUNION ALL ".join(f"""
SELECT {cat} '{c}' AS name, CAST(least(floor(({c} - lo) / w), 9) AS INTEGER) AS bin, round(lo + least(floor(({c} - lo) / w), 9) * w, 6) AS "left", count(*) AS rows
FROM {table}, (SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 10 AS w FROM {table}) GROUP BY ALL""" for c in names)


@query("scatter_marginals", "D21", marginal_sql("lineitem", ("l_quantity", "l_extendedprice"), "l_returnflag,"))
def _(t):
    return rounded(s.marginals(t("lineitem"), ["l_quantity", "l_extendedprice"], 10, "l_returnflag"), 6, "left")


@query("scatter_diagonal", "D22", marginal_sql("part", ("p_size", "p_retailprice", "p_partkey")))
def _(t):
    return rounded(s.marginals(t("part"), ["p_size", "p_retailprice", "p_partkey"]), 6, "left")


@query("scatter_pairs", "D22", "\nUNION ALL ".join(
    f"SELECT p_type, '{a}' AS x_name, '{b}' AS y_name, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM part"
    for a, b in (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey"))))
def _(t):
    return s.scatter_pairs(t("part"), ["p_size", "p_retailprice", "p_partkey"], "p_type")


@query("parallel_coordinates", "D23", "\nUNION ALL ".join(
    f"""SELECT p_partkey, p_type, '{c}' AS axis, round(({c} - (SELECT min({c}) FROM part)) / ((SELECT max({c}) - min({c}) FROM part)), 6) AS value
FROM part""" for c in ("p_size", "p_retailprice")))
def _(t):
    return rounded(s.parallel_coordinates(t("part"), "p_partkey", ["p_size", "p_retailprice"], "p_type"), 6, "value")


@query("andrews_curves", "D24", """
SELECT s_suppkey, CAST(i AS INTEGER) AS point, round(s_acctbal / 1000 / sqrt(2) + s_nationkey * sin(-pi() + i * (2 * pi() / 99))
 + s_suppkey * cos(-pi() + i * (2 * pi() / 99)) + s_nationkey * 2 * sin(2 * (-pi() + i * (2 * pi() / 99))), 6) AS value
FROM supplier, generate_series(0, 99) g(i)""")
def _(t):
    df = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") * 2).alias("b"), "s_nationkey")
    return rounded(s.andrews_curves(df, "s_suppkey", ["a", "s_nationkey", "s_suppkey", "b"]), 6, "value")
