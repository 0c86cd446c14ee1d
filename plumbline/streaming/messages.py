"""Message streams: consume, route, report and publish with checkpoints in place of acknowledgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "code string, userId string, body string"


def file_messages(spark: SparkSession, folder: str, schema: str = MESSAGE, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines that arrive as files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def kafka_messages(spark: SparkSession, servers: str, topic: str, schema: str = MESSAGE) -> DataFrame:
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "earliest").load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def complete() -> Column:
    """Messages that name their code and user."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return has("code") & has("userId")


def write_batch(df: DataFrame, batch: int, path: str) -> None:
    """One folder per micro-batch, overwritten on replay, so a repeated batch leaves the same rows."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def consume(stream: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Valid messages to one table, those without code or user to another."""
    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_batch(batch.where(complete()), number, accepted)
            write_batch(batch.where(~complete()), number, rejected)
        finally:
            batch.unpersist()
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(known: list[str], failed: Column | None = None) -> Column:
    """0 handled (or unknown code, which is only logged), 1 could not be scheduled, 2 raised while handling."""
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    return F.when(F.col("code").isin(*known) & bad, 1).otherwise(0)


def route(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], reports: str, checkpoint: str) -> StreamingQuery:
    """Hand each code's messages to its handler and report a status per message.

    A handler that raises gives its messages status 2; messages of unknown codes are reported as handled.
    """
    def run(batch: DataFrame, number: int) -> None:
        good = batch.where(complete()).persist()
        try:
            broken = []
            for code, handler in handlers.items():
                try:
                    handler(good.where(F.col("code") == code), number)
                except Exception:  # noqa: BLE001  a failed handler must not stop the other codes
                    broken.append(code)
            status = F.when(F.col("code").isin(*broken), 2).otherwise(statuses(list(handlers))) if broken else statuses(list(handlers))
            known = F.col("code").isin(*handlers)
            write_batch(good.select("code", "userId", status.cast("int").alias("status"), known.alias("known")), number, reports)
        finally:
            good.unpersist()
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reports as JSON lines."""
    body = stream.select(F.to_json(F.struct(*stream.columns)).alias("value"))
    return body.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    body = stream.select(F.to_json(F.struct(*stream.columns)).alias("value"))
    return (body.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
