"""Scans of files and SQL text over files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tokens read as null in delimited text, and the optional wider list.
NULL_TOKENS = ("(null)", "NA", "N/A")
UNKNOWN_TOKENS = ("n/a", "na", "--")


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn null tokens of string columns into nulls."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.when(F.col(f"`{c}`").isin(*tokens), None).otherwise(F.col(f"`{c}`")).alias(c) if c in text
                       else F.col(f"`{c}`") for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Give string columns the narrowest type that reads every non-null value, found in one pass."""
    text = [c for c, t in df.dtypes if t == "string"]
    kinds = ("bigint", "double", "timestamp_ntz")
    tests = [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(text)]
    tests += [F.count(F.expr(f"try_cast(`{c}` as {k})")).alias(f"{i}_{k}") for i, c in enumerate(text) for k in kinds]
    if not tests:
        return df
    seen = df.agg(*tests).first()
    casts = {}
    for i, c in enumerate(text):
        fits = [k for k in kinds if seen[f"{i}_n"] and seen[f"{i}_{k}"] == seen[f"{i}_n"]]
        if fits:
            casts[c] = F.expr(f"try_cast(`{c}` as {fits[0]})").alias(c)
    return df.select(*[casts.get(c, F.col(f"`{c}`")) for c in df.columns])


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None,
             tokens: Sequence[str] = NULL_TOKENS, extra_tokens: bool = False) -> DataFrame:
    """CSV with a header.  Null tokens are removed before any cast; ``schema`` is a DDL list of wanted types."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    clean = null_tokens(raw, tuple(tokens) + (UNKNOWN_TOKENS if extra_tokens else ()))
    if schema is None:
        return infer_types(clean)
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema.fields}
    return clean.select(*[F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in types else F.col(f"`{c}`")
                          for c in clean.columns])


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None, lines: bool = False) -> DataFrame:
    """An array of records per file, or JSON lines (splittable: prefer them for large files)."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image folder: one row per image with height, width, channels, mode and pixel bytes."""
    return spark.read.format("image").load(folder).select("image.*")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if path.endswith("/"):
        return read_images(spark, path)
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "txt": read_text}
    if kind not in readers:
        raise ValueError(f"no reader for {path!r}")
    return readers[kind](spark, path)


def sql_over_files(spark: SparkSession, text: str, folder: str = "", args: dict | None = None) -> DataFrame:
    """Run SQL whose quoted file names (``'a.csv'``, ``'img/'``) are tables; any number of files."""
    views: dict[str, str] = {}

    def name(match: re.Match) -> str:
        token = match.group(1)
        if token not in views:
            path = token if token.startswith("/") or "://" in token else f"{folder.rstrip('/')}/{token}"
            views[token] = f"file_{uuid.uuid4().hex}"
            read_any(spark, path).createOrReplaceTempView(views[token])
        return views[token]

    return spark.sql(re.sub(r"'([^']*(?:\.(?:csv|json|parquet|txt)|/))'", name, text), args=args or None)


def sheet_rows(spark: SparkSession, path: str | list[str], columns: int | None = None, skip_empty: bool = True,
               header_row: int = 1, data_row: int | None = None) -> DataFrame:
    """Delimited sheet: header names without ``*`` marks, at most ``columns`` columns, all-empty rows removed.

    Lines count from 1: names are in ``header_row``, rows start at ``data_row`` (default: the next line).  With names in
    line 1 every file of the sheet has them.  Otherwise cells hold no line feeds and what stands above the rows is in the
    first block of the sheet's first file (by name; of a list of paths, in the first one); all other files hold rows only.
    Files are read in parallel.
    """
    data_row = data_row or header_row + 1
    if (header_row, data_row) == (1, 2):
        raw = spark.read.csv(path, header=True, inferSchema=False)
    else:
        paths = [path] if isinstance(path, str) else list(path)
        file = F.col("_metadata.file_path")
        first = spark.read.format("binaryFile").load(paths[0]).where("length > 0").agg(F.min(F.struct("path", file.alias("uri"))).alias("f")).first()["f"]
        if first is None:
            raise ValueError(f"{paths[0]} has no lines")
        number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
        lines = spark.read.text(first["path"]).select("value", number.alias("number"), F.col("_metadata.file_block_start").alias("start"))
        head = lines.where((F.col("start") == 0) & (F.col("number") == header_row)).first()
        if head is None:
            raise ValueError(f"{first['path']} has no line {header_row}")
        names = spark.createDataFrame([(head["value"],)], "value string").select(F.from_csv("value", ", ".join(
            f"c{i} string" for i in range(head["value"].count(",") + 1))).alias("r")).select("r.*").first()
        names = [n for n in names if n is not None]
        rows = lines.where((F.col("start") > 0) | (F.col("number") >= data_row)).select("value")
        rows = rows.union(spark.read.text(paths).where(file != first["uri"]).select("value"))
        raw = rows.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names)))).alias("r")).select("r.*").toDF(*names)
    kept = raw.columns[:columns] if columns else raw.columns
    out = raw.select(*[F.col(f"`{c}`").alias(re.sub(r"\*", "", c).strip()) for c in kept])
    return out.dropna("all") if skip_empty else out
