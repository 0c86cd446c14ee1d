"""Sources, filters, joins, grouping, paging and snapshot updates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.settings import scratch_folder
from plumbline.operators import query as q
from plumbline.plans.registry import Tables, positions, query
from plumbline.sources import database, export, files
from plumbline.spec import DatasetSpec, ViewSpec


def written(t: Tables, df, kind: str) -> str:
    path = scratch_folder(t.spark, kind) + f".{kind}"
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "txt": lambda: writer.text(path),
     "parquet": lambda: writer.parquet(path)}[kind]()
    return path


# --- sources -------------------------------------------------------------------------------------

@query("source_sql_over_files", "S2", """
SELECT n.n_name AS nation, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")
def _(t):
    return files.sql_over_files(t.spark, """
        SELECT n.n_name AS nation, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance
        FROM 'customer.parquet' c JOIN 'nation.parquet' n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""", t.folder)


@query("source_csv", "S3", """
SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def _(t):
    dirty = t("events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "N/A").otherwise(
        F.col("value").cast("string")).alias("value"))
    return files.read_csv(t.spark, written(t, dirty, "csv"))


@query("source_json", "S4", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = written(t, t("customer").select("c_custkey", "c_name", "c_acctbal"), "json")
    return files.read_json(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double", lines=True)


@query("source_json_array", "S4", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    record = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    arrays = t("customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("j"))
    path = scratch_folder(t.spark, "arrays") + ".json"
    arrays.select("j").write.option("maxRecordsPerFile", 1).text(path)    # a file per array
    return files.read_json(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("source_parquet", "S5", """
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return files.read_parquet(t.spark, t.path("lineitem")).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("source_text", "S6", """
SELECT text, count(*) AS n FROM (SELECT event_type || ':' || user_id AS text FROM events) GROUP BY text""")
def _(t):
    path = written(t, t("events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))), "txt")
    return files.read_text(t.spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("source_preview", "S8", """
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') AS o_orderdate,
       (SELECT count(*) FROM orders) AS total
FROM orders ORDER BY o_orderkey LIMIT 50""")
def _(t):
    total, _, rows = database.preview(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey")
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("source_sql_variables", "S9", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000""")
def _(t):
    return files.sql_over_files(t.spark, """SELECT o_orderkey, o_totalprice FROM 'orders.parquet'
        WHERE o_orderpriority = :priority AND o_totalprice > :floor""", t.folder,
                                {"priority": "1-URGENT", "floor": 250000.0})


@query("sink_cells", "S11", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CAST(o_totalprice > 200000 AS INTEGER) AS large FROM orders""")
def _(t):
    return export.cells(t("orders").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") > 200000).alias("large")))


@query("source_sheet_rows", "S12", """
SELECT DISTINCT p_name AS name, p_brand AS brand FROM part WHERE p_type <> 'ECONOMY'""")
def _(t):
    economy = F.col("p_type") == "ECONOMY"
    sheet = t("part").select(F.when(~economy, F.col("p_name")).alias("*name"),
                             F.when(~economy, F.col("p_brand")).alias("brand*"),
                             F.when(~economy, F.col("p_type")).alias("type"))
    return files.sheet_rows(t.spark, written(t, sheet, "csv"), columns=2).distinct()


@query("source_sheet_rows_below", "S12", "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    rows = t("customer").select(F.concat_ws(",", "c_name", "c_mktsegment", "c_custkey"))
    top = t.spark.createDataFrame([("Customers",), ("*name,segment*,key",), ("text,text,number",), (",,",)], "line string")
    path = scratch_folder(t.spark, "sheet")
    top.coalesce(1).write.text(f"{path}/top")
    rows.write.text(f"{path}/rows")
    return files.sheet_rows(t.spark, [f"{path}/top", f"{path}/rows"], columns=2, header_row=2, data_row=4)


# --- filters -------------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def filtered(name: str, rows: str, filters: dict, sql_where: str):
    @query(name, rows, f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {sql_where}")
    def _(t):
        return q.where(t("orders"), filters).select(*ORDER_COLUMNS)


filtered("filter_equal", "F1", {"o_orderstatus": "F", "o_custkey": None, "o_orderpriority": ""}, "o_orderstatus = 'F'")
filtered("filter_day", "F3", {"o_orderdate": ("date", "1998-10-03")}, "CAST(o_orderdate AS DATE) = DATE '1998-10-03'")
filtered("filter_month", "F4", {"o_orderdate": ("month", "1998-12")}, "strftime(o_orderdate, '%Y-%m') = '1998-12'")
filtered("filter_like", "F5", {"o_orderpriority": ("like", "MED")}, "o_orderpriority LIKE '%MED%'")
filtered("filter_in", "F6", {"o_orderstatus": ("in", ["F", "P"])}, "o_orderstatus IN ('F', 'P')")
filtered("filter_between", "F7", {"o_totalprice": ("between", [1000.0, 50000.0])}, "o_totalprice BETWEEN 1000 AND 50000")
filtered("filter_not_equal", "F8", {"o_orderstatus": ("!=", "F")}, "o_orderstatus <> 'F'")
filtered("filter_greater", "F8", {"o_totalprice": (">", 400000.0)}, "o_totalprice > 400000")
filtered("filter_at_least", "F8", {"o_totalprice": (">=", 112946.26)}, "o_totalprice >= 112946.26")
filtered("filter_at_most", "F8", {"o_totalprice": ("<=", 112946.26)}, "o_totalprice <= 112946.26")
filtered("filter_less", "F8", {"o_totalprice": ("<", 20000.0)}, "o_totalprice < 20000")


@query("filter_null", "F2", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def _(t):
    df = t("orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return q.where(df, {"s": ("None",)}).select("o_orderkey")


@query("filter_not_null", "F2", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL")
def _(t):
    df = t("orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return q.where(df, {"s": ("not None",)}).select("o_orderkey")


@query("filter_document", "F9", """
SELECT event_id, props FROM events WHERE regexp_matches(props, 'k": 4[0-9]')
AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 23:59:59'""")
def _(t):
    filters = {"props": ("like", 'k": 4[0-9]'), "ts": ("between", ["2024-01-05", "2024-01-09"])}
    return q.where(t("events"), filters, document=True).select("event_id", "props")


@query("filter_visible", "F10", """
SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0) AND c_nationkey = 7""")
def _(t):
    df = t("customer").withColumn("is_delete", F.col("c_acctbal") < 0)
    return q.visible(df, "is_delete", "c_nationkey", 7).select("c_custkey", "c_name")


@query("filter_extra", "F11", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity * l_discount > 4 AND l_tax < l_discount""")
def _(t):
    extra = [F.col("l_quantity") * F.col("l_discount") > 4, F.col("l_tax") < F.col("l_discount")]
    return q.where(t("lineitem"), {"l_returnflag": "R"}, extra).select("l_orderkey", "l_linenumber")


@query("project_omit", "F12", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    spec = DatasetSpec.of([{"name": "c_name", "omit": True}, {"name": "c_mktsegment", "omit": True}])
    return t("customer").drop(*spec.omitted())


@query("filter_all_null_rows", "F13", """
SELECT s, p FROM (SELECT nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '1-URGENT') AS p FROM orders)
WHERE s IS NOT NULL OR p IS NOT NULL""")
def _(t):
    return t("orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"),
                              F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p")).dropna("all")


@query("project_drop_empty_columns", "F14", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    df = t("nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") < 0, 1).alias("void"))
    return q.drop_empty_columns(df)


@query("project_roles", "F15", "SELECT l_quantity, l_extendedprice, l_linenumber FROM lineitem")
def _(t):
    spec = DatasetSpec.of([{"name": "l_quantity", "attr": "conti"}, {"name": "l_extendedprice", "attr": "conti"},
                           {"name": "l_linenumber", "attr": "disc"}, {"name": "l_returnflag", "attr": "cat"},
                           {"name": "l_tax", "attr": "conti", "omit": True}, {"name": "gone", "attr": "conti"}])
    return spec.select_roles(t("lineitem"), "conti", "disc")


@query("project_merged_key", "F16", """
SELECT coalesce(nullif(l_returnflag, 'N'), 'nan') || '_' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    df = t("lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return df.groupBy(q.merged_key(["flag", "l_linestatus"])).agg(F.count(F.lit(1)).alias("n"))


@query("project_series_columns", "F17", """
SELECT o_orderdate, o_orderstatus || '_' || o_orderpriority AS key, o_totalprice FROM orders""")
def _(t):
    return q.series_columns(t("orders"), "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])


@query("filter_series_any", "F18", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return q.series_with(df, "l_orderkey", "l_quantity", ">=", 50)


@query("filter_columns_any", "F19", "SELECT l_shipdate, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return q.columns_with(t("lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_tax"], ">", 10)


# --- joins ---------------------------------------------------------------------------------------

@query("join_inner", "J1", """
SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    right = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return q.relate(t("orders").select("o_orderkey", "o_custkey"), right, "o_custkey").drop("o_custkey")


@query("join_left", "J2", """
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000""")
def _(t):
    big = t("orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = q.relate(t("customer").select("c_custkey"), big, "c_custkey", "left")
    return joined.withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


@query("join_condition", "J1", """
SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0""")
def _(t):
    s, n = t("supplier"), t("nation")
    on = (s["s_nationkey"] == n["n_nationkey"]) & (s["s_acctbal"] > 0)
    return q.relate(s, n, on).select("s_suppkey", "n_name")


# --- grouping ------------------------------------------------------------------------------------

@query("agg_count", "A1", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    return q.where(t("orders"), {"o_orderstatus": "O"}).agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct", "A2", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return q.query_table(t("part"), distinct=["p_brand", "p_type"])


@query("agg_group_tree", "A3", """
SELECT coalesce(nullif(p_type, 'ECONOMY'), 'Null') AS group_name, p_partkey AS id, p_name AS name,
       row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS position FROM part""")
def _(t):
    df = t("part").withColumn("g", F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_type")))
    return q.group_tree(df, "g", "p_partkey", "p_name")


@query("agg_hierarchy", "A4", """
SELECT r_regionkey AS root_id, r_name AS root_name, n_nationkey + 100 AS child_id, n_name AS child_name,
       row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS position
FROM region JOIN nation ON r_regionkey = n_regionkey""")
def _(t):
    roots = t("region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("pid"),
                               F.col("r_name").alias("name"))
    children = t("nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("pid"),
                                  F.col("n_name").alias("name"))
    return q.hierarchy(roots.unionByName(children).withColumn("rank", F.col("name")), "id", "pid", "name", "rank")


@query("agg_drop_duplicates", "A5", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def _(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount").dropDuplicates()


SQL_AGG = {"sum": "sum({})", "mean": "avg({})", "median": "quantile_cont({}, 0.5)", "min": "min({})", "max": "max({})",
           "std": "stddev_samp({})", "count": "count({})"}


def grouped_query(agg: str):
    text = SQL_AGG[agg].format("l_extendedprice")
    rounded = text if agg == "count" else f"round({text}, 3)"

    @query(f"agg_grouped_{agg}", "A6", f"""
SELECT l_returnflag, l_linestatus, {rounded} AS v FROM lineitem GROUP BY l_returnflag, l_linestatus""")
    def _(t):
        out = q.grouped(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", agg, "v")
        return out if agg == "count" else out.withColumn("v", F.round("v", 3))


for _agg in SQL_AGG:
    grouped_query(_agg)


@query("agg_value_counts", "A7", """
SELECT p_brand, count(*) AS volume, round(count(*) * 100.0 / (SELECT count(*) FROM part), 1) AS share
FROM part GROUP BY p_brand""")
def _(t):
    return q.value_counts(t("part"), "p_brand")


@query("agg_frequency", "A8", "SELECT p_type, p_brand, count(*) AS volume FROM part GROUP BY p_type, p_brand")
def _(t):
    return q.frequency(t("part"), "p_type", "p_brand")


@query("agg_saved_view", "A9", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 1) AS net,
       round(sum(l_quantity), 1) AS l_quantity
FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag, l_linestatus""")
def _(t):
    return q.view(t("lineitem"), ViewSpec(
        dim=("l_returnflag", "l_linestatus"), metrics=("net", "l_quantity"), agg="sum", prec=1,
        filter={"l_quantity": (">=", 10)}, sorter=(("net", "desc"),),
        calculation={"net": "l_extendedprice * (:one - l_discount)"}, variable={"one": 1}))


# --- order, paging, snapshots ----------------------------------------------------------------------

@query("order_by_field", "Y1", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS position FROM part")
def _(t):
    return positions(q.query_table(t("part").select("p_partkey", "p_size"), order="p_size", descending=True, tie="p_partkey"))


@query("order_page", "Y2", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def _(t):
    return q.query_table(t("orders").select("o_orderkey", "o_totalprice"), order="o_totalprice", descending=True,
                         tie="o_orderkey", page=3, limit=50)


@query("order_top_k", "Y3", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def _(t):
    return q.top_k(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5, "c_custkey")


@query("order_time_text", "Y4", """
SELECT o_orderdate, o_orderpriority, rank() OVER (ORDER BY o_orderdate, o_orderpriority) AS first,
 rank() OVER (ORDER BY o_orderdate, o_orderpriority) + n - 1 AS last
FROM (SELECT o_orderdate, o_orderpriority, count(*) OVER (PARTITION BY o_orderdate, o_orderpriority) AS n FROM orders) QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_orderpriority) = 1""")
def _(t):
    rows = positions(q.by_time_then_text(t("orders").select("o_orderdate", "o_orderpriority", "o_orderkey"), "o_orderdate", "o_orderpriority"))
    return rows.groupBy("o_orderdate", "o_orderpriority").agg(F.min("position").alias("first"), F.max("position").alias("last"))


@query("update_soft_delete", "U1", """
SELECT s_suppkey, s_suppkey IN (1, 5, 9) OR s_acctbal < 0 AS is_delete FROM supplier""")
def _(t):
    df = t("supplier").select("s_suppkey", (F.col("s_acctbal") < 0).alias("is_delete"))
    return q.soft_delete(df, "s_suppkey", [1, 5, 9])


@query("update_hard_delete", "U1", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(t):
    ids = t("orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    return q.hard_delete(t("customer").select("c_custkey", "c_name"), "c_custkey", ids)


@query("update_insert", "U2", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(t):
    first = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                 F.col("c_mktsegment").alias("segment"))
    return q.bulk_insert(first, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("update_by_id", "U2", """
SELECT c_custkey, coalesce(top, c_acctbal) AS c_acctbal, c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    changes = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return q.bulk_update(t("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), changes, "c_custkey")
