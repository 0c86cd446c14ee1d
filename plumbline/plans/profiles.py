"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as p
from plumbline.plans.registry import query

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stacked(template: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("profile_numeric", "P1 J5", stacked("""
SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std,
       round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(var_samp({c}), 3) AS variance,
       round(quantile_cont({c}, 0.25), 3) AS pct25, round(quantile_cont({c}, 0.5), 3) AS median,
       round(quantile_cont({c}, 0.75), 3) AS pct75 FROM lineitem""", NUMERIC))
def _(t):
    return p.numeric_profile(t("lineitem"), NUMERIC)


CATEGORIES = ["p_name", "p_brand", "p_type"]


@query("profile_categorical", "P2", stacked("""
SELECT '{c}' AS name, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)""", CATEGORIES))
def _(t):
    return p.categorical_profile(t("part"), CATEGORIES)


NULLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value"


def events_with_nulls(t):
    """The whole events table with every seventh value missing (the given tables have no nulls)."""
    value = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value"))
    return t("events").withColumn("value", value)


@query("profile_missing_distinct", "P3", stacked("""
SELECT '{c}' AS name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS nunique
FROM (SELECT event_type, user_id, """ + NULLED + " FROM events)", ["event_type", "user_id", "value"]))
def _(t):
    return p.missing_and_distinct(events_with_nulls(t), ["event_type", "user_id", "value"])


@query("profile_short_domains", "P4", stacked("""
SELECT '{c}' AS name, CASE WHEN count(DISTINCT {c}) <= 20
  THEN array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), ',') ELSE '' END AS domain
FROM lineitem""", ["l_returnflag", "l_linenumber", "l_discount", "l_partkey"]))
def _(t):
    out = p.short_domains(t("lineitem"), ["l_returnflag", "l_linenumber", "l_discount", "l_partkey"])
    return out.select("name", F.array_join("values", ",").alias("domain"))


@query("profile_time", "P5", """
SELECT 'o_orderdate' AS name, count(*) AS count, min(o_orderdate) AS min, max(o_orderdate) AS max,
  (SELECT greatest(min(g), 1) FROM (SELECT (epoch_us(d) - lag(epoch_us(d)) OVER (ORDER BY d)) // 60000000 AS g
   FROM (SELECT DISTINCT o_orderdate AS d FROM orders))) AS gap
FROM orders""")
def _(t):
    return p.time_profile(t("orders"), "o_orderdate")


@query("profile_text_types", "P6", """
WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock,
                  strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, event_type AS word FROM events)
SELECT 'day' AS name, CASE WHEN bool_and(try_strptime(day, '%Y-%m-%d') IS NOT NULL) THEN 'date' ELSE 'text' END AS kind FROM s
UNION ALL SELECT 'clock', CASE WHEN bool_and(try_strptime(clock, '%H:%M:%S') IS NOT NULL) THEN 'time' ELSE 'text' END FROM s
UNION ALL SELECT 'moment', CASE WHEN bool_and(try_strptime(moment, '%Y-%m-%d %H:%M:%S') IS NOT NULL) THEN 'datetime' ELSE 'text' END FROM s
UNION ALL SELECT 'word', CASE WHEN bool_and(try_strptime(word, '%Y-%m-%d') IS NOT NULL) THEN 'date' ELSE 'text' END FROM s""")
def _(t):
    text = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("clock"),
                              F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("event_type").alias("word"))
    return p.text_types(text, text.columns)


@query("profile_preview", "P7", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 10")
def _(t):
    return p.preview(t("customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
