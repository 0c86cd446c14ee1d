"""Streaming jobs run to the end of their input over files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.settings import scratch_folder
from plumbline.operators import clean
from plumbline.plans.profiles import NULLED, events_with_nulls
from plumbline.plans.registry import query
from plumbline.spec import DatasetSpec
from plumbline.streaming import access_log, messages, progress, scoring


def arrived(t, df) -> str:
    """The rows as JSON files in a folder of their own, as a stream would find them."""
    path = scratch_folder(t.spark, "arrived")
    df.repartition(4).write.json(path)
    return path


def message_rows(t):
    return t("events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("code"),
                              F.when(F.col("value") > 5, F.col("user_id").cast("string")).alias("userId"), F.col("props").alias("body"))


MESSAGES = "SELECT CASE WHEN event_type <> 'error' THEN event_type END AS code, CASE WHEN value > 5 THEN CAST(user_id AS VARCHAR) END AS \"userId\" FROM events"


@query("stream_consume", "Z1", f"""
WITH m AS ({MESSAGES})
SELECT coalesce(code, '') AS code, code IS NOT NULL AND "userId" IS NOT NULL AS accepted, count(*) AS n FROM m GROUP BY 1, 2""")
def _(t):
    home = scratch_folder(t.spark, "consume")
    stream = messages.file_messages(t.spark, arrived(t, message_rows(t)), files_per_trigger=2)
    messages.consume(stream, f"{home}/good", f"{home}/bad", f"{home}/checkpoint").awaitTermination()
    read = lambda kind, ok: t.spark.read.schema(messages.MESSAGE).parquet(f"{home}/{kind}").withColumn("accepted", F.lit(ok))
    both = read("good", True).unionByName(read("bad", False), allowMissingColumns=True)
    return both.groupBy(F.coalesce("code", F.lit("")).alias("code"), "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("stream_route", "Z2", f"""
WITH m AS ({MESSAGES})
SELECT code, CAST(CASE code WHEN 'signup' THEN 2 ELSE 0 END AS INTEGER) AS status, code IN ('click', 'view', 'signup') AS known, count(*) AS n
FROM m WHERE code IS NOT NULL AND "userId" IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    home = scratch_folder(t.spark, "route")

    def fail(batch, number):
        raise RuntimeError("handler is down")
    handlers = {"click": lambda b, n: messages.write_batch(b, n, f"{home}/click"), "view": lambda b, n: messages.write_batch(b, n, f"{home}/view"),
                "signup": fail}
    stream = messages.file_messages(t.spark, arrived(t, message_rows(t)), files_per_trigger=2)
    messages.route(stream, handlers, f"{home}/reports", f"{home}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{home}/reports").groupBy("code", "status", "known").agg(F.count(F.lit(1)).alias("n"))


@query("stream_progress", "Z3", """
SELECT event_type AS experiment, round(100 * count(*) FILTER (WHERE user_id % 3 <> 0) / 5000, 0) AS epoch_progress,
 round(100 * count(*) FILTER (WHERE user_id % 3 = 0) / 1000, 0) AS trial_progress,
 100 - round(100 * count(*) FILTER (WHERE user_id % 3 = 0 AND value < 10) / count(*) FILTER (WHERE user_id % 3 = 0), 0) AS rate, max(value) AS best
FROM events GROUP BY event_type""")
def _(t):
    home = scratch_folder(t.spark, "progress")
    code = F.when(F.col("user_id") % 3 == 0, progress.TRIAL).otherwise(progress.EPOCH)
    reports = t("events").select("ts", F.col("event_type").alias("experiment"), code.alias("code"), (F.col("value") < 10).alias("failed"), F.col("value").alias("score"))
    path = scratch_folder(t.spark, "reports")
    reports.repartition(3).write.parquet(path)
    stream = t.spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(path)
    progress.store_progress(stream, f"{home}/table", f"{home}/checkpoint").awaitTermination()
    return progress.progress(t.spark.read.parquet(f"{home}/table"), 5000, 1000)


@query("stream_publish", "Z4", "SELECT event_type AS code, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    home = scratch_folder(t.spark, "publish")
    rows = t("events").select(F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("userId"), F.col("props").alias("body"))
    stream = messages.file_messages(t.spark, arrived(t, rows))
    messages.publish_files(stream, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return t.spark.read.json(f"{home}/out", schema=messages.MESSAGE).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("stream_access_log", "Z5", """
SELECT event_type AS route, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
 CASE WHEN user_id % 3 = 0 THEN 'Firefox 128.0' ELSE 'Chrome 126.0.0.0' END AS browser, CASE WHEN user_id % 3 = 0 THEN 'Windows 10.0' ELSE 'Android 14' END AS system,
 count(*) AS requests, sum(round(value * 1000000)::BIGINT)::BIGINT // count(*) / 1e9 AS mean_time FROM events GROUP BY 1, 2, 3, 4""")
def _(t):
    requests = access_log.enrich(log_lines(t))
    out = requests.groupBy("route", "method", "browser", "system").agg(F.count(F.lit(1)).alias("requests"),
                                                                          access_log.mean_seconds(
        F.sum(access_log.nanoseconds(F.col("process_time"))), F.count(F.lit(1))).alias("mean_time"))
    return out


@query("stream_route_times", "Z5", """
WITH r AS (SELECT event_type AS route, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, value / 1000 AS t,
 CASE WHEN user_id % 7 = 0 THEN 500 ELSE 200 END AS status FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY route, method ORDER BY t) AS place, count(*) OVER (PARTITION BY route, method) AS n FROM r)
SELECT route, method, count(*) AS requests, sum(round(t * 1000000000)::BIGINT)::BIGINT // count(*) / 1e9 AS mean_time, CAST(round(min(t) FILTER (WHERE place >= ceil(0.95 * n)) * 1000) AS BIGINT) AS p95_millis,
 count(*) FILTER (WHERE status >= 400) AS errors FROM m GROUP BY route, method""")
def _(t):
    home, path = scratch_folder(t.spark, "routes"), scratch_folder(t.spark, "log")
    log_lines(t).repartition(3).write.text(path)
    stream = t.spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    access_log.store_route_sums(stream, f"{home}/sums", f"{home}/checkpoint").awaitTermination()
    return access_log.route_times(t.spark.read.parquet(f"{home}/sums"))


def log_lines(t):
    agent = F.when(F.col("user_id") % 3 == 0, "Mozilla/5.0 (Windows NT 10.0; rv:128.0) Gecko/20100101 Firefox/128.0").otherwise(
        "Mozilla/5.0 (Linux; Android 14) AppleWebKit/537.36 Chrome/126.0.0.0 Mobile Safari/537.36")
    line = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
                    F.concat(F.lit("/api/"), "event_type", F.lit("?user="), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("route"),
                    agent.alias("agent"), F.when(F.col("user_id") % 7 == 0, 500).otherwise(200).alias("status"), F.lit(0.0).alias("started"), (F.col("value") / 1000).alias("finished"))
    return t("events").select(F.to_json(line).alias("value"))


@query("stream_clean", "Z6", f"""
WITH e AS (SELECT event_id, event_type, {NULLED} FROM events), m AS (SELECT avg(value) AS a FROM e), f AS (SELECT event_id, event_type, coalesce(value, a) AS value FROM e, m),
s AS (SELECT avg(value) AS a, stddev_pop(value) AS d FROM f)
SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type, round((value - a) / d, 6) + 0.0 AS value FROM f, s""")
def _(t):
    rows = events_with_nulls(t).select("event_id", "event_type", "value")
    spec = DatasetSpec.of([{"name": "event_id"}, {"name": "event_type", "attr": "cat", "encode": "ordinal"},
                           {"name": "value", "attr": "conti", "miss": "mean", "scale": "std"}])
    fitted, _ = clean.fit(rows, spec)
    home, path = scratch_folder(t.spark, "clean"), scratch_folder(t.spark, "rows")
    rows.repartition(3).write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    scoring.clean_stream(stream, fitted, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{home}/out").drop("batch").withColumn("value", F.round("value", 6) + 0.0)
