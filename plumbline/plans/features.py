"""Feature scoring, selection and generation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features as f
from plumbline.plans.profiles import stacked
from plumbline.plans.registry import query
from plumbline.plans.series import DAILY, daily, rounded

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_regression_f", "G1", stacked("""SELECT '{c}' AS name, round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) /
 (1 - pow(corr({c}, l_extendedprice), 2)), 4) AS value FROM lineitem""", ["l_quantity", "l_discount", "l_tax"]))
def _(t):
    out = f.f_scores(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", classify=False)
    return out.select("name", F.round("value", 4).alias("value"))


@query("feature_chi_square", "G2", "WITH " + stacked("""SELECT '{c}' AS name, l_returnflag AS y,
 ({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem) AS x FROM lineitem""", NUMERIC).join(["v AS (", """),
s AS (SELECT name, y, count(*) AS n, sum(x) AS o FROM v GROUP BY 1, 2), a AS (SELECT name, sum(o) AS t, sum(n) AS n FROM s GROUP BY 1)
SELECT s.name, round(sum((o - t * s.n / a.n) * (o - t * s.n / a.n) / (t * s.n / a.n)), 6) AS value FROM s JOIN a ON s.name = a.name GROUP BY s.name"""]))
def _(t):
    return f.chi_scores(t("lineitem"), NUMERIC, "l_returnflag").select("name", F.round("value", 6).alias("value"))


@query("feature_information", "G3", "WITH " + stacked("""SELECT '{c}' AS name, l_returnflag AS y, least(floor(({c} - (SELECT min({c}) FROM lineitem)) /
 ((SELECT max({c}) - min({c}) FROM lineitem) / 10)), 9) AS x FROM lineitem""", NUMERIC).join(["v AS (", """),
c AS (SELECT name, x, y, count(*)::DOUBLE AS n FROM v GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY name) AS t, sum(n) OVER (PARTITION BY name, x) AS nx, sum(n) OVER (PARTITION BY name, y) AS ny FROM c)
SELECT name, round(sum(n / t * ln(n * t / (nx * ny))), 8) AS value FROM m GROUP BY name"""]))
def _(t):
    return f.information_scores(t("lineitem"), NUMERIC, "l_returnflag").select("name", F.round("value", 8).alias("value"))


@query("feature_selection", "G4")
def _(t):
    return f.select(f.f_scores(t("lineitem"), NUMERIC, "l_returnflag"), "fpr")


@query("feature_selection_best", "G4", """
WITH v AS (""" + stacked("SELECT '{c}' AS name, l_returnflag AS c, {c} AS v FROM lineitem", NUMERIC) + """),
g AS (SELECT name, c, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM v GROUP BY 1, 2), a AS (SELECT name, avg(v) AS a FROM v GROUP BY 1),
f AS (SELECT name, (sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f FROM g JOIN a USING (name) GROUP BY name)
SELECT name, row_number() OVER (ORDER BY f DESC, name) <= 2 AS prime, round(f, 3) AS value FROM f""")
def _(t):
    return f.select(f.f_scores(t("lineitem"), NUMERIC, "l_returnflag"), "k_best", 2)


@query("feature_linear", "G5", """
WITH s AS (SELECT var_samp(l_quantity) AS aa, var_samp(l_discount) AS bb, covar_samp(l_quantity, l_discount) AS ab,
 covar_samp(l_quantity, ln(l_extendedprice)) AS ay, covar_samp(l_discount, ln(l_extendedprice)) AS byy FROM lineitem),
b AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS q, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS d FROM s)
SELECT 'l_quantity' AS name, abs(q) >= (abs(q) + abs(d)) / 2 AS prime, round(q, 3) AS value FROM b
UNION ALL SELECT 'l_discount', abs(d) >= (abs(q) + abs(d)) / 2, round(d, 3) FROM b""")
def _(t):
    df = t("lineitem").withColumn("y", F.ln("l_extendedprice"))
    return f.model_scores(df, ["l_quantity", "l_discount"], "y", "linear")


@query("feature_lasso", "G6")
def _(t):
    return f.model_scores(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lasso")


@query("feature_forest", "G7")
def _(t):
    return f.model_scores(t("lineitem"), NUMERIC, "l_returnflag", "randomf", classify=True)


@query("feature_boost", "G8")
def _(t):
    return f.model_scores(t("lineitem"), NUMERIC, "l_linestatus", "boost", classify=True)


@query("feature_elimination", "G9")
def _(t):
    return f.elimination(t("part").select("p_size", "p_retailprice", "p_partkey", "p_type"), ["p_size", "p_retailprice", "p_partkey"], "p_type")


@query("feature_permutation", "G10")
def _(t):
    return f.permutation_scores(t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), ["o_custkey", "o_totalprice"],
                                "o_orderstatus", ["o_orderkey"], repeats=2)


@query("feature_null_importance", "G11")
def _(t):
    return f.null_importance(t("part"), ["p_size", "p_retailprice"], "p_type", ["p_partkey"], runs=3)


@query("feature_table", "G12", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_chars, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS text_words,
 CAST(length(lang) AS INTEGER) AS lang_chars, CAST(len(list_filter(regexp_split_to_array(lang, '\\s+'), lambda w: w <> '')) AS INTEGER) AS lang_words, n_chars FROM documents""")
def _(t):
    return f.table_features(t("documents").select("doc_id", "text", "lang", "n_chars"), ["doc_id"])


@query("feature_dates", "G12", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
 CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday FROM orders""")
def _(t):
    return f.table_features(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"])


@query("feature_series", "G13", """
WITH p AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
w AS (SELECT *, v - lag(v) OVER s AS ch, lag(v) OVER s AS pv, lead(v) OVER s AS nx, lag(v, 1) OVER s AS l1, lag(v, 2) OVER s AS l2, lag(v, 3) OVER s AS l3,
  avg(v) OVER g AS m, stddev_samp(v) OVER g AS sd, max(v) OVER g AS mx, min(v) OVER g AS mn, count(*) OVER g AS n
  FROM p WINDOW s AS (PARTITION BY k ORDER BY i), g AS (PARTITION BY k)),
r AS (SELECT k, max(c) AS longest FROM (SELECT k, g, count(*) AS c FROM (SELECT k, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM w WHERE v > m) GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT k, count(DISTINCT v) < count(*) AS dup FROM p GROUP BY k)
SELECT w.k AS event_type, count(*) AS length, round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 4) AS median, min(v) AS min, max(v) AS max,
 round(stddev_samp(v), 6) AS std, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis, round(sum(v * v), 2) AS abs_energy,
 round(sum(abs(ch)), 4) AS abs_change_sum, round(avg(ch), 6) AS mean_change, count(*) FILTER (WHERE v > m) AS count_above_mean,
 count(*) FILTER (WHERE v < m) AS count_below_mean, round((min(i) FILTER (WHERE v = mx) - 1) / max(n), 8) AS first_max,
 round(max(i) FILTER (WHERE v = mn) / max(n), 8) AS last_min, count(*) FILTER (WHERE v > pv AND v > nx) AS peaks,
 round(regr_slope(v, i - 1), 8) AS slope, round(avg(CASE WHEN abs(v - m) > 2 * sd THEN 1.0 ELSE 0 END), 8) AS beyond_sigma,
 round(sum((v - m) * (l1 - m)) / (count(*) - 1) / var_pop(v), 6) AS autocorrelation_1, round(sum((v - m) * (l3 - m)) / (count(*) - 3) / var_pop(v), 6) AS autocorrelation_3,
 max(longest) AS longest_above, bool_or(dup) AS duplicates
FROM w JOIN r USING (k) JOIN u USING (k) GROUP BY w.k""")
def _(t):
    out = f.series_features(t("events"), "event_type", "ts", "value")
    out = rounded(out, 6, "mean", "std", "skewness", "kurtosis", "mean_change", "autocorrelation_1", "autocorrelation_3")
    out = rounded(rounded(out, 4, "sum", "median", "abs_change_sum"), 8, "first_max", "last_min", "slope", "beyond_sigma")
    return rounded(out, 2, "abs_energy").select(
        "event_type", "length", "sum", "mean", "median", "min", "max", "std", "skewness", "kurtosis", "abs_energy", "abs_change_sum", "mean_change",
        "count_above_mean", "count_below_mean", "first_max", "last_min", "peaks", "slope", "beyond_sigma", "autocorrelation_1", "autocorrelation_3",
        "longest_above", "duplicates")


@query("feature_informative", "G14", """
SELECT p_partkey, p_size, p_brand FROM part ORDER BY p_partkey LIMIT 10""")
def _(t):
    df = t("part").select("p_partkey", "p_size", F.col("p_size").cast("string").alias("again"), "p_brand", F.lit(1).alias("one"),
                          F.lit(None).cast("double").alias("void"))
    return f.informative(df, ["p_partkey"])
