"""Access-log enrichment, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.streaming.messages import write_batch

# First match names the family; the group is its version.
BROWSERS = (("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"OPR/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"),
            ("Chrome", r"Chrome/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari"), ("curl", r"curl/([\d.]+)"))
SYSTEMS = (("Windows", r"Windows NT ([\d.]+)"), ("Android", r"Android ([\d.]+)"), ("iOS", r"iPhone OS ([\d_]+)"),
           ("Mac OS X", r"Mac OS X ([\d_.]+)"), ("Linux", r"(?:Linux)()"))
LOG = ("ts string, method string, url string, route string, client_ip string, user_id string, agent string, "
       "status int, started double, finished double, body string")


def family(agent: Column, table: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit("Other")
    for name, pattern in reversed(table):
        out = F.when(agent.rlike(pattern), F.trim(F.concat_ws(" ", F.lit(name), F.replace(F.regexp_extract(agent, pattern, 1), F.lit("_"), F.lit("."))))).otherwise(out)
    return out


def enrich(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per request: process time, client, browser and system family, query parameters as a map."""
    r = lines.select(F.from_json(F.col(column), LOG).alias("r")).select("r.*")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return r.select(F.try_to_timestamp("ts").alias("ts"), "method", "route", "client_ip", "user_id", "status",
                    (F.col("finished") - F.col("started")).alias("process_time"), family(F.coalesce("agent", F.lit("")), BROWSERS).alias("browser"),
                    family(F.coalesce("agent", F.lit("")), SYSTEMS).alias("system"),
                    F.to_json(F.struct(F.col("body"), F.when(query != "", query).alias("query_params"))).alias("params"))


def nanoseconds(seconds: Column) -> Column:
    """Whole nanoseconds: their sums do not depend on the order in which rows come."""
    return F.round(seconds * 1_000_000_000).cast("long")


def mean_seconds(total: Column, many: Column) -> Column:
    """The mean of whole nanoseconds, down to a whole nanosecond, in seconds."""
    return (total - F.pmod(total, many)) / many / 1e9


def route_sums(requests: DataFrame) -> DataFrame:
    """Sums per route and method that add up over batches; times are counted by the millisecond."""
    return requests.groupBy("route", "method", F.round(F.col("process_time") * 1000).cast("long").alias("millis")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(nanoseconds(F.col("process_time"))).alias("nanoseconds"), F.count_if(F.col("status") >= 400).alias("errors"))


def store_route_sums(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Enrich a stream of log lines and keep the sums of every micro-batch; a repeated batch replaces its own."""
    return (lines.writeStream.foreachBatch(lambda rows, number: write_batch(route_sums(enrich(rows)), number, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def route_times(sums: DataFrame) -> DataFrame:
    """Requests, mean time, 95th percentile (milliseconds, nearest rank) and errors per route and method."""
    counts = sums.groupBy("route", "method", "millis").agg(*[F.sum(c).alias(c) for c in ("requests", "nanoseconds", "errors")])
    order = Window.partitionBy("route", "method")
    upto = F.sum("requests").over(order.orderBy("millis").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("high", upto >= F.ceil(0.95 * F.sum("requests").over(order)))
    return ranked.groupBy("route", "method").agg(
        F.sum("requests").alias("requests"), mean_seconds(F.sum("nanoseconds"), F.sum("requests")).alias("mean_time"),
        F.min(F.when(F.col("high"), F.col("millis"))).alias("p95_millis"), F.sum("errors").alias("errors"))
