"""Tabular sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame) -> DataFrame:
    """Cell formatting of an export: times as ``yyyy-MM-dd HH:mm:ss`` text, booleans as 1/0."""
    def cell(name: str, kind: str):
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
        return F.col(name).cast("int").alias(name) if kind == "boolean" else F.col(name)
    return df.select(*[cell(c, t) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str) -> None:
    cells(df).write.mode("overwrite").csv(path, header=True)


def write_rejects(rejects: DataFrame, path: str, kind: str = "parquet") -> None:
    """Failed rows with the ``reason`` column last."""
    ordered = rejects.select(*[c for c in rejects.columns if c != "reason"], "reason")
    writer = ordered.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)
