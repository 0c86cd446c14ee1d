"""Row validation, scalar rules and user functions over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import lookup_join

# Accepted forms of phone numbers and mail addresses.
PHONE = r"^1(3\d|4[4-9]|5[0-35-9]|6[67]|7[013-8]|8[0-9]|9[0-9])\d{8}$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def phone_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(PHONE), F.lit(False))


def email_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def password_fault(c: Column) -> Column:
    """Null for a good password: 8 to 16 characters, no blanks or Chinese, two kinds of digit, letter, symbol."""
    kinds = reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in (r"[0-9]", r"[A-Za-z]", r"[^\p{L}\p{N}_]")])
    return (F.when(c.isNull() | ~F.length(c).between(8, 16), "length must be 8 to 16")
            .when(c.rlike(r"[一-龥 ]"), "no blanks or Chinese characters").when(kinds < 2, "needs two kinds of characters"))


RULES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "phone": (lambda c: ~phone_ok(c), "invalid phone number"), "email": (lambda c: ~email_ok(c), "invalid email"),
    "password": (lambda c: password_fault(c).isNotNull(), "weak password")}


@dataclass(frozen=True)
class Header:
    """One imported column."""

    field: str
    label: str
    required: bool = False
    options: tuple[tuple[str, str], ...] = ()     # (label, value)
    rules: tuple[str, ...] = ()
    type: str = "str"                             # str or list


def check_rows(df: DataFrame, headers: Sequence[Header]) -> DataFrame:
    """Typed fields and ``reason``, the first failed check of the row (null when it passes)."""
    faults, values = [], []
    for h in headers:
        cell = F.col(h.field)
        blank = cell.isNull() | (cell.cast("string") == "")
        if h.required:
            faults.append(F.when(blank, f"{h.label} is required"))
        value = cell
        if h.options:
            known = F.create_map(*[F.lit(v) for o in h.options for v in o])
            value = F.try_element_at(known, cell.cast("string"))
            faults.append(F.when(~blank & value.isNull(), f"{h.label} is not an option"))
        elif h.rules:
            for r in h.rules:
                broken, text = RULES[r]
                faults.append(F.when(~blank & broken(cell.cast("string")), f"{h.label}: {text}"))
        text = F.when(~blank, value.cast("string"))
        values.append((F.when(~blank, F.array(text)) if h.type == "list" else text).alias(h.field))
    reason = F.get(F.array_compact(F.array(*faults)), F.lit(0)) if faults else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in {h.field for h in headers}]
    return df.select(*rest, *values, reason.alias("reason"))


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def time_text(c: Column, json: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text from such text or from ``{"$date": "...Z"}``; null otherwise."""
    plain = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$") & F.try_to_timestamp(c, F.lit("yyyy-M-d H:m:s")).isNotNull(), c)
    wrapped = F.try_to_timestamp(F.get_json_object(c, "$['$date']"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(plain, F.date_format(wrapped, "yyyy-MM-dd HH:mm:ss"))


def date_text(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_timestamp(c, F.lit("yyyy-M-d")).isNotNull(), c)


def object_id(c: Column) -> Column:
    """Text of an id given plainly or as ``{"$oid": "..."}``."""
    return F.coalesce(F.get_json_object(c, "$['$oid']"), c)


def option_value(df: DataFrame, column: str, options: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """``value`` of the option whose label equals the column."""
    return lookup_join(df, options.select(F.col(label).alias(column), F.col(value).alias("option_value")).dropDuplicates([column]), [column])


def time_slots(df: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """One row per slot start between two clock texts (``H:m`` or ``H:m:s``), the end excluded."""
    clock = lambda c: F.coalesce(F.try_to_timestamp(F.col(c), F.lit("H:m:s")), F.try_to_timestamp(F.col(c), F.lit("H:m")))
    first, last = F.unix_timestamp(clock(start)), F.unix_timestamp(clock(end))
    starts = F.when(last > first, F.sequence(first, last - 1, F.lit(minutes * 60)))
    return df.withColumn("slot", F.explode(starts)).withColumn("slot", F.date_format(F.timestamp_seconds("slot"), "HH:mm:ss"))


def listed(c: Column) -> Column:
    """``[a, b, c]`` text as an array of trimmed parts."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def parsed(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles rounded (half up) for output."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(c, digits) for c in names})


# --- user functions ----------------------------------------------------------------------------------

def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User code over Arrow batches of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """User code per row, carried in Arrow batches."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    return map_batches(df, lambda b: pd.DataFrame([fn(r) for r in b.to_dict("records")], columns=names), schema)
