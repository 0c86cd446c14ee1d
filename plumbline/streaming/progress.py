"""Progress of experiments from a stream of epoch, trial and failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.streaming.messages import write_batch

# Report codes.
EPOCH, TRIAL, EXPERIMENT = 2, 3, 4


def daily_progress(reports: DataFrame) -> DataFrame:
    """Counts per day and experiment of some reports ``(ts, experiment, code, failed, score)``."""
    return reports.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "experiment").agg(
        F.count_if(F.col("code") == EPOCH).alias("epochs"), F.count_if(F.col("code") == TRIAL).alias("trials"),
        F.count_if((F.col("code") == TRIAL) & F.col("failed")).alias("failed"), F.max("score").alias("best"))


def store_progress(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts per day and experiment of every micro-batch; a batch that is repeated replaces its own.

    Batches keep no state, so a report counts however late it comes.
    """
    return (reports.writeStream.foreachBatch(lambda rows, number: write_batch(daily_progress(rows), number, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def progress(stored: DataFrame, total_epochs: int, total_trials: int) -> DataFrame:
    """All batches added up: percent of epochs and trials done, success rate and best score."""
    sums = stored.groupBy("experiment").agg(F.sum("epochs").alias("epochs"), F.sum("trials").alias("trials"),
                                            F.sum("failed").alias("failed"), F.max("best").alias("best"))
    rate = 100 - F.round(F.try_divide(100 * F.col("failed"), F.col("trials")), 0)
    return sums.select("experiment", F.round(100 * F.col("epochs") / total_epochs, 0).alias("epoch_progress"),
                       F.round(100 * F.col("trials") / total_trials, 0).alias("trial_progress"), rate.alias("rate"), "best")
