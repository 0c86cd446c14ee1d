"""Per-series numpy work: one task per series, only after the longest series is proven to fit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settings import SERIES_POINTS, bound


def check_length(df: DataFrame, key: str, most: int | None = None) -> None:
    """Refuse series longer than one task may hold; ``most`` lowers the bound."""
    limit = min(bound(df.sparkSession, SERIES_POINTS), most or SERIES_POINTS[1])
    longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > limit:
        raise ValueError(f"a series has {longest} points, more than {limit} per task: resample to a wider period")


def per_series(df: DataFrame, key: str | None, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               most: int | None = None) -> DataFrame:
    """``fn`` gets the rows of one series (unsorted) and returns rows of ``schema``, which starts with the key if any.

    ``most`` lowers the bound for methods whose memory or time grows with the square of the series length.
    """
    keyed = df if key else df.withColumn("_all", F.lit(0))
    by = key or "_all"
    check_length(keyed, by, most)
    if not key:
        return keyed.groupBy(by).applyInPandas(lambda pdf: fn(pdf.drop(columns="_all")), schema)
    # series are few bytes but much work, so the tasks are not merged by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, by).groupBy(by).applyInPandas(fn, schema)
