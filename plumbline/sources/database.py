"""Database scans through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_scan(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """All rows of a query text over one connection; the database does the filtering and joining."""
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()


def table_scan(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 16,
               **options: str) -> DataFrame:
    """Parallel table scan split on a numeric ``column``; its bounds are read first with one small query."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("dbtable", table).load()
    ends = reader.option("query", f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}").load().first()
    scan = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
    if ends[0] is None:
        return scan.load()
    return (scan.option("partitionColumn", column).option("lowerBound", str(ends[0]))
            .option("upperBound", str(ends[1])).option("numPartitions", str(partitions)).load())


def preview(df: DataFrame, order: str, limit: int = 50) -> tuple[int, list[dict], DataFrame]:
    """Total, column metadata and the first ``limit`` rows with times as ``MM/dd/yyyy HH:mm:ss``."""
    metadata = [{"id": i, "name": f.name, "type": f.dataType.simpleString()} for i, f in enumerate(df.schema.fields)]
    return df.count(), metadata, time_text(df.orderBy(order).limit(limit), "MM/dd/yyyy HH:mm:ss")


def time_text(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[F.date_format(c, pattern).alias(c) if t.startswith("timestamp") else F.col(c)
                       for c, t in df.dtypes])
