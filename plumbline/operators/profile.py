"""Dataset profiles: numeric, categorical, missing and distinct counts, dates and text types."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from plumbline.functions.calendar import micros
from plumbline.functions.ordered import describe, over_series

# Text patterns tried for each kind, in order.
DATETIME_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd")
TIME_PATTERNS = ("HH:mm:ss", "HH:mm")


def numeric_profile(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    stats = describe(df, [], columns, [0.25, 0.5, 0.75])
    named = {"mean": "mean", "std": "std", "min": "min", "max": "max", "variance": "variance"}
    return stats.select("name", "count", *[F.round(c, digits).alias(n) for c, n in named.items()],
                        *[F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(("pct25", "median", "pct75"))])


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value) rows of several columns as text, without a shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct, most frequent value (smallest on ties) and its frequency."""
    counts = (long_text(df, columns).where(F.col("value").isNotNull())
              .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    top = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
    out = counts.groupBy("name").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), top.alias("top"))
    return out.select("name", "count", "unique", F.col("top.value").alias("top"), (-F.col("top.rank")).alias("freq"))


def missing_and_distinct(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("missing"),
                      distinct(F.col(c)).alias("nunique")) for c in columns]
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def least_values(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """(name, values): the ``most`` smallest distinct texts of each column, fewer where it has fewer.

    A task keeps that many per column and no more, whatever it reads, and so does what its results are merged into.
    """
    names = list(columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: pa.array([], pa.string()) for c in names}
        for batch in batches:
            for c in names:
                seen = pc.unique(pa.concat_arrays([held[c], batch.column(c)]).drop_null())
                held[c] = seen.take(pc.sort_indices(seen)[:most]) if len(seen) > most else seen
        for c, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.string()), values], ["name", "value"])

    kept = df.select(*[F.col(c).cast("string").alias(c) for c in names]).mapInArrow(keep, "name string, value string").distinct()
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("value"))).where(F.col("_r") <= most)
    lists = first.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    every = df.sparkSession.createDataFrame([(c,) for c in names], "name string")
    return every.join(F.broadcast(lists), "name", "left").select("name", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def short_domains(df: DataFrame, columns: Sequence[str], limit: int = 20) -> DataFrame:
    """Sorted distinct values of columns that have at most ``limit``; an empty list otherwise."""
    least = least_values(df, columns, limit + 1)
    return least.select("name", F.when(F.size("values") <= limit, F.col("values")).otherwise(F.array().cast("array<string>")).alias("values"))


def time_profile(df: DataFrame, ts: str) -> DataFrame:
    """Count, first, last and smallest gap in minutes (at least 1) between distinct times."""
    times = df.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_t")).distinct()
    steps = over_series(times, [], "_t", lambda w: {"_gap": micros(F.col("_t")) - micros(F.lag("_t").over(w))}, before=1)
    gap = F.greatest(F.floor(F.min("_gap") / 60_000_000), F.lit(1)).cast("long")
    head = df.agg(F.lit(ts).alias("name"), F.count(ts).alias("count"), F.min(ts).alias("min"), F.max(ts).alias("max"))
    return head.withColumn("gap", steps.agg(gap.alias("gap")).scalar())


def text_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """datetime, date or time when every non-null text with at least four digits parses so; otherwise text."""
    def reads(c: str, patterns: Sequence[str]):
        return reduce(lambda a, b: a | b, [F.try_to_timestamp(F.col(c), F.lit(p)).isNotNull() for p in patterns])

    def kind(c: str):
        dated = (F.length(c) > 4) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 4)
        all_read = lambda p: F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), dated & reads(c, p))), F.lit(False))
        return (F.when(all_read(DATETIME_PATTERNS), "datetime").when(all_read(DATE_PATTERNS), "date")
                .when(all_read(TIME_PATTERNS), "time").otherwise("text"))

    parts = [F.struct(F.lit(c).alias("name"), kind(c).alias("kind")) for c in columns]
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def preview(df: DataFrame, order: str, limit: int = 10) -> DataFrame:
    return df.orderBy(order).limit(limit)


def image_profile(images: DataFrame, label: str | None = None, most: int = 1000) -> DataFrame:
    """Count and the mode, channels and size ranges of an image table; with a label its ``most`` smallest distinct values."""
    parts = [F.count(F.lit(1)).alias("count"), F.min("mode").alias("mode"), F.min("nChannels").alias("min_channels"),
             F.max("nChannels").alias("max_channels"), F.min("height").alias("min_height"),
             F.max("height").alias("max_height"), F.min("width").alias("min_width"), F.max("width").alias("max_width")]
    out = images.agg(*parts)
    if label:
        kind = images.schema[label].dataType
        values = F.array_sort(F.transform("values", lambda x: x.cast(kind)))
        found = least_values(images, [label], most).select(values.alias("labels")).first()["labels"]
        out = out.withColumn("labels", F.array(*[F.lit(v) for v in found]).cast(ArrayType(kind)))
    return out


def image_preview(images: DataFrame, order: str = "origin", limit: int = 10) -> DataFrame:
    return images.orderBy(order).limit(limit).select(order, "height", "width", F.base64("data").alias("data"))
