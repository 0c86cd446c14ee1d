"""Conversion, missing values, encoding, scaling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean as c
from plumbline.plans.profiles import NULLED, events_with_nulls
from plumbline.plans.registry import positions, query
from plumbline.spec import DatasetSpec

HOLES = f"WITH e AS (SELECT event_id, ts, event_type, {NULLED} FROM events)"


# --- conversion ----------------------------------------------------------------------------------

@query("convert_time", "C1", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = t("events").select("event_id", text.alias("ts"))
    return c.convert(df, DatasetSpec.of([{"name": "ts", "attr": "date"}]))


@query("convert_category", "C2", """
SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS event_type, count(*) AS n
FROM events GROUP BY 1""")
def _(t):
    spec = DatasetSpec.of([{"name": "event_type", "attr": "cat", "values": ["click", "view", "purchase"]}])
    return c.convert(t("events"), spec).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("convert_category_domain", "C2", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(t):
    return c.frequency_domain(t("part"), "p_brand")


@query("convert_double", "C3", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "error", "NA").otherwise(F.col("value").cast("string"))
    df = t("events").select("event_id", text.alias("value"))
    return c.convert(df, DatasetSpec.of([{"name": "value", "attr": "conti"}]))


@query("convert_integer", "C4", """
SELECT event_id, CASE WHEN value = floor(value) THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS value FROM events""")
def _(t):
    df = t("events").select("event_id", F.col("value").cast("string").alias("value"))
    whole = c.convert(df, DatasetSpec.of([{"name": "value", "attr": "disc"}]))
    return whole.withColumn("value", F.coalesce("value", F.lit(-1).cast("long")))


# --- missing values ------------------------------------------------------------------------------

def fill_query(name: str, row: str, method, sql_value: str):
    @query(name, row, f"{HOLES} SELECT event_id, round(coalesce(value, {sql_value}), 4) AS value FROM e")
    def _(t):
        df = events_with_nulls(t).select("event_id", "value")
        return c.fill(df, "value", method).withColumn("value", F.round("value", 4))


fill_query("fill_mean", "M2", "mean", "(SELECT avg(value) FROM e)")
fill_query("fill_median", "M3", "median", "(SELECT quantile_cont(value, 0.5) FROM e)")
fill_query("fill_mode", "M4", "mode",
           "(SELECT value FROM e WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)")
fill_query("fill_min", "M5", "min", "(SELECT min(value) FROM e)")
fill_query("fill_max", "M6", "max", "(SELECT max(value) FROM e)")
fill_query("fill_zero", "M9", "zero", "0")
fill_query("fill_constant", "M10", 12.5, "12.5")


@query("fill_drop", "M1", f"{HOLES} SELECT event_id, value FROM e WHERE value IS NOT NULL")
def _(t):
    return c.fill(events_with_nulls(t).select("event_id", "value"), "value", "drop")


FORWARD = "last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BACKWARD = "first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("fill_previous", "M7", f"{HOLES} SELECT event_id, coalesce({FORWARD}, {BACKWARD}) AS value FROM e")
def _(t):
    df = events_with_nulls(t).select("event_id", "ts", "event_type", "value")
    return c.fill(df, "value", "prev", key="event_type", order="ts").select("event_id", "value")


@query("fill_next", "M8", f"{HOLES} SELECT event_id, coalesce({BACKWARD}, {FORWARD}) AS value FROM e")
def _(t):
    df = events_with_nulls(t).select("event_id", "ts", "event_type", "value")
    return c.fill(df, "value", "next", key="event_type", order="ts").select("event_id", "value")


@query("fill_precedence", "M11", f"""{HOLES}
SELECT event_id, coalesce(value, 0) AS value, round(coalesce(other, (SELECT avg(other) FROM
  (SELECT CASE WHEN value < 10 THEN NULL ELSE value END AS other FROM e))), 4) AS other
FROM (SELECT event_id, value, CASE WHEN value < 10 THEN NULL ELSE value END AS other FROM e)""")
def _(t):
    df = events_with_nulls(t).select("event_id", "value")
    df = df.withColumn("other", F.when(F.col("value") < 10, None).otherwise(F.col("value")))
    spec = DatasetSpec.of([{"name": "value", "attr": "conti", "miss": "zero"}, {"name": "other", "attr": "conti"},
                           {"name": "event_id"}], {"miss": "mean"})
    return c.clean(df, spec).withColumn("other", F.round("other", 4))


@query("resample_mean", "R1", """
WITH b AS (SELECT time_bucket(INTERVAL '180 minutes', ts, TIMESTAMP '2024-01-01') AS bin, avg(value) AS v
           FROM events GROUP BY 1),
     s AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL '180 minutes')) AS bin)
SELECT bin AS ts, round(last_value(v IGNORE NULLS) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value
FROM s LEFT JOIN b USING (bin)""")
def _(t):
    return c.resample_mean(t("events").select("ts", "value"), "ts", 180).withColumn("value", F.round("value", 4))


# --- encoding ------------------------------------------------------------------------------------

@query("encode_target_order", "E1", """
SELECT o_orderkey, CAST(coalesce(list_position(['P', 'O'], o_orderstatus), 0) - 1 AS BIGINT) AS code FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", c.domain_code("o_orderstatus", ["P", "O"]).alias("code"))


@query("encode_ordinal", "E2", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment FROM customer""")
def _(t):
    return c.ordinal(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("encode_one_hot", "E3", """
SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A",
  CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R" FROM lineitem""")
def _(t):
    return c.one_hot(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@query("encode_hash", "E4")
def _(t):
    hashed = c.hashed(t("part").select("p_partkey", "p_brand"), "p_brand", 1 << 10)
    return hashed.select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"))


@query("encode_binary", "E5", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS code FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", c.binarize(F.col("l_linenumber")).alias("code"))


@query("encode_bins", "E6", """
WITH m AS (SELECT min(p_size) AS lo, (max(p_size) - min(p_size)) / 10 AS w FROM part)
SELECT p_partkey, CAST(least(floor((p_size - lo) / w), 9) AS DOUBLE) AS p_size FROM part, m""")
def _(t):
    spec = DatasetSpec.of([{"name": "p_size", "encode": "bins"}, {"name": "p_partkey"}])
    return c.clean(t("part").select("p_partkey", "p_size"), spec)


@query("encode_label", "E7", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand FROM part""")
def _(t):
    return c.ordinal(t("part").select("p_partkey", "p_brand"), "p_brand", integer=True)


@query("encode_count", "E8", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS p_brand FROM part")
def _(t):
    df = t("part").select("p_partkey", "p_brand")
    return c.attach_code(df, c.count_encode(df, "p_brand"), "p_brand")


@query("encode_mean", "E9", """
SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS p_brand FROM part""")
def _(t):
    df = t("part")
    coded = c.attach_code(df, c.mean_encode(df, "p_brand", "p_retailprice"), "p_brand")
    return coded.select("p_partkey", F.round("p_brand", 4).alias("p_brand"))


@query("encode_woe", "E10", """
WITH y AS (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice > 250000 AS INTEGER) AS y FROM orders),
     g AS (SELECT o_orderpriority, sum(y) AS p, count(*) AS n FROM y GROUP BY 1),
     a AS (SELECT sum(y) AS p, count(*) AS n FROM y)
SELECT o_orderkey, round(ln(((g.p + 0.5) / (a.p + 0.5)) / ((g.n - g.p + 0.5) / (a.n - a.p + 0.5))), 6) AS o_orderpriority
FROM y JOIN g USING (o_orderpriority), a""")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 250000).cast("int").alias("y"))
    coded = c.attach_code(df, c.woe_encode(df, "o_orderpriority", "y"), "o_orderpriority")
    return coded.select("o_orderkey", F.round("o_orderpriority", 6).alias("o_orderpriority"))


# --- scaling -------------------------------------------------------------------------------------

def scale_query(name: str, row: str, method: str, sql_value: str):
    @query(name, row, f"""
WITH m AS (SELECT avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi,
  max(abs(c_acctbal)) AS top, quantile_cont(c_acctbal, 0.5) AS med,
  quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer)
SELECT c_custkey, round({sql_value}, 6) AS c_acctbal FROM customer, m""")
    def _(t):
        spec = DatasetSpec.of([{"name": "c_custkey"}, {"name": "c_acctbal", "attr": "conti", "scale": method}])
        out = c.clean(t("customer").select("c_custkey", "c_acctbal"), spec)
        return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


scale_query("scale_standard", "N1", "std", "(c_acctbal - mean) / sd")
scale_query("scale_minmax", "N2", "minmax", "(c_acctbal - lo) / (hi - lo)")
scale_query("scale_maxabs", "N3", "maxabs", "c_acctbal / top")
scale_query("scale_robust", "N4", "robust", "(c_acctbal - med) / iqr")


def norm_query(name: str, row: str, norm: str, size: str):
    @query(name, row, f"""
SELECT l_orderkey, l_linenumber, round(l_quantity / {size}, 6) AS l_quantity, round(l_tax / {size}, 6) AS l_tax,
       round(l_discount / {size}, 6) AS l_discount FROM lineitem""")
    def _(t):
        columns = ["l_quantity", "l_tax", "l_discount"]
        out = t("lineitem").select("l_orderkey", "l_linenumber", *c.row_norm(columns, norm))
        return out.withColumns({n: F.round(n, 6) for n in columns})


norm_query("scale_l1", "N5", "l1", "(abs(l_quantity) + abs(l_tax) + abs(l_discount))")
norm_query("scale_l2", "N6", "l2", "sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount)")


# --- whole cleaning, splits, windows -----------------------------------------------------------------

@query("clean_table", "T1", """
WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount,
             CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem),
     f AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount,
             coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM d)) AS l_tax FROM d),
     m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, min(l_tax) AS lo, max(l_tax) AS hi FROM f)
SELECT CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag,
       CAST(l_linestatus = 'F' AS INTEGER) AS "l_linestatus_F", CAST(l_linestatus = 'O' AS INTEGER) AS "l_linestatus_O",
       round((l_quantity - a) / s, 6) AS l_quantity, l_discount, round((l_tax - lo) / (hi - lo), 6) AS l_tax FROM f, m""")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount",
                              F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    spec = DatasetSpec.of([
        {"name": "l_orderkey", "omit": True}, {"name": "l_returnflag", "attr": "cat", "encode": "ordinal"},
        {"name": "l_linestatus", "attr": "cat", "encode": "hot"}, {"name": "l_quantity", "attr": "conti", "scale": "std"},
        {"name": "l_discount", "attr": "conti"}, {"name": "l_tax", "attr": "conti", "miss": "median", "scale": "minmax"}])
    return c.clean(df, spec).withColumns({"l_quantity": F.round("l_quantity", 6), "l_tax": F.round("l_tax", 6)})


@query("split_ordered", "T2", """
SELECT o_orderkey, o_totalprice, CAST(rank > n - floor(n * 0.25) AS INTEGER) AS validation
FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rank, count(*) OVER () AS n FROM orders)""")
def _(t):
    train, held = c.split(t("orders").select("o_orderkey", "o_totalprice"), 0.25, ["o_orderkey"], False, "o_orderkey")
    return train.withColumn("validation", F.lit(0)).unionByName(held.withColumn("validation", F.lit(1)))


@query("split_shuffled", "T2", """
SELECT o_orderkey, o_totalprice, CAST(('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25 AS INTEGER) AS validation FROM orders""")
def _(t):
    train, held = c.split(t("orders").select("o_orderkey", "o_totalprice"), 0.25, ["o_orderkey"], seed=7)
    return train.withColumn("validation", F.lit(0)).unionByName(held.withColumn("validation", F.lit(1)))


@query("shuffle_rows", "T3", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS position FROM orders""")
def _(t):
    return positions(c.shuffled(t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], seed=7))


@query("sliding_windows", "T4", """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 1),
     w AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n,
             list(round(v, 1)) OVER (ORDER BY ts ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS a FROM m)
SELECT ts, array_to_string(list_transform(a[1:12], lambda x: printf('%.1f', x)), ',') AS x,
       array_to_string(list_transform(a[13:15], lambda x: printf('%.1f', x)), ',') AS y
FROM w WHERE rn >= 15 AND (n - rn) % 2 = 0""")
def _(t):
    from plumbline.operators.series import resample
    monthly = resample(t("orders").select("o_orderdate", "o_totalprice"), "o_orderdate", ["o_totalprice"],
                       period="MS", agg="sum").withColumn("v", F.round("o_totalprice", 1))
    out = c.sliding_windows(monthly, "o_orderdate", "v", inputs=12, outputs=3, stride=2, period="MS")
    text = lambda name: F.array_join(F.transform(name, lambda x: F.format_string("%.1f", x)), ",").alias(name)
    return out.select(F.col("o_orderdate").alias("ts"), text("x"), text("y"))
