"""Filters, joins, grouping, trees, paging and snapshot updates of saved tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import lookup_join, quantiles, running
from plumbline.spec import ViewSpec


def _day(value) -> datetime:
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day) if isinstance(value, date) else datetime.fromisoformat(value)


def _moment(value: datetime) -> Column:
    """A zone-free time literal, written as text so that no session zone shifts it."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def condition(name: str, value) -> Column | None:
    """One filter of the list language; null or empty text means no filter."""
    c = F.col(name)
    if value is None or value == "":
        return None
    if not isinstance(value, tuple):
        return c == value
    kind, args = value[0], value[1:]
    if kind == "None":
        return c.isNull()
    if kind == "not None":
        return c.isNotNull()
    if args[0] is None or args[0] == "":
        return None
    match kind:
        case "date":
            start = _day(args[0])
            return (c >= _moment(start)) & (c < _moment(start + timedelta(days=1)))
        case "month":
            start = _day(args[0] + "-01" if isinstance(args[0], str) and len(args[0]) == 7 else args[0]).replace(day=1)
            after = (start + timedelta(days=32)).replace(day=1)
            return (c >= _moment(start)) & (c < _moment(after))
        case "like":
            return c.contains(args[0])
        case "in":
            return c.isin(*args[0])
        case "between":
            return c.between(F.lit(args[0][0]), F.lit(args[0][1]))
        case "!=":
            return c != args[0]
        case ">":
            return c > args[0]
        case ">=":
            return c >= args[0]
        case "<":
            return c < args[0]
        case "<=":
            return c <= args[0]
        case _:
            raise ValueError(f"unknown filter {kind!r} on {name}")


def document_condition(name: str, value) -> Column | None:
    """Document-store flavour: ``like`` is a regular expression, ``between`` covers days up to 23:59:59 (exclusive)."""
    if isinstance(value, tuple) and value[0] == "like":
        return F.col(name).rlike(value[1])
    if isinstance(value, tuple) and value[0] == "between":
        low, high = (_day(v) for v in value[1])
        end = high + timedelta(hours=23, minutes=59, seconds=59)
        return (F.col(name) >= _moment(low)) & (F.col(name) < _moment(end))
    return condition(name, value)


def where(df: DataFrame, filters: dict, extra: Sequence[Column] = (), document: bool = False) -> DataFrame:
    """All filters and extra conditions joined by AND."""
    make = document_condition if document else condition
    parts = [p for p in (make(k, v) for k, v in filters.items()) if p is not None] + list(extra)
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def visible(df: DataFrame, deleted: str, tenant: str, value) -> DataFrame:
    """Rows of one tenant that are not soft-deleted."""
    return df.where(~F.col(deleted) & (F.col(tenant) == value))


def relate(df: DataFrame, other: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by columns or a condition; adaptive execution picks the form and splits hot keys of inner and outer joins."""
    return df.join(other, on if isinstance(on, Column) else [on] if isinstance(on, str) else list(on), how)


def query_table(df: DataFrame, filters: dict | None = None, extra: Sequence[Column] = (),
                order: str | None = None, descending: bool = False, tie: str | None = None,
                page: int = 1, limit: int = 0, distinct: Sequence[str] = ()) -> DataFrame:
    """Filter, order, distinct and page in one declarative plan (``limit`` 0 keeps all rows)."""
    out = where(df, filters or {}, extra)
    if distinct:
        out = out.select(*distinct).distinct()
    if order:
        out = ordered(out, order, descending, tie)
    return out.offset((page - 1) * limit).limit(limit) if limit else out


def ordered(df: DataFrame, by: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    first = F.col(by).desc() if descending else F.col(by).asc()
    return df.orderBy(first, *([F.col(tie).desc() if descending else F.col(tie)] if tie else []))


def top_k(df: DataFrame, value: str, k: int = 5, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *([tie] if tie else [])).limit(k)


def by_time_then_text(df: DataFrame, ts: str, category: str) -> DataFrame:
    return df.orderBy(F.col(ts), F.col(category).cast("string"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value, found in one aggregate pass."""
    seen = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if seen[c] == 0])


def merged_key(columns: Sequence[str], name: str = "key") -> Column:
    """Several category columns as one key ``a_b``; a null part reads ``nan``."""
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]).alias(name)


def series_columns(df: DataFrame, ts: str, categories: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """The time, series key and value columns only; several categories merge into one key."""
    if len(categories) > 1:
        return df.select(ts, merged_key(categories), *values)
    return df.select(ts, *categories, *values)


COMPARE = {">": lambda c, t: c > t, "<": lambda c, t: c < t, ">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t,
           "==": lambda c, t: c == t, "!=": lambda c, t: c != t}


def series_with(df: DataFrame, key: str, value: str, op: str, threshold: float) -> DataFrame:
    """All rows of the series in which any point satisfies the comparison."""
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    kept = df.where(COMPARE[op](F.col(value), threshold)).select(key).distinct()
    return lookup_join(df, kept.withColumn("_kept", F.lit(True)), [key], "inner").drop("_kept")


def columns_with(df: DataFrame, ts: str, values: Sequence[str], op: str, threshold: float) -> DataFrame:
    """The time column and the value columns in which any row satisfies the comparison."""
    seen = df.agg(*[F.max(COMPARE[op](F.col(v), threshold)).alias(v) for v in values]).first()
    return df.select(ts, *[v for v in values if seen[v]])


AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def grouped(df: DataFrame, keys: Sequence[str], value: str, agg: str, name: str | None = None) -> DataFrame:
    """Group by keys with sum, mean, median, min, max, std or count of one value."""
    name = name or f"{agg}_{value}"
    if agg == "median":
        return quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias(name))
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    return df.groupBy(*keys).agg(AGGREGATES[agg](value).alias(name))


def value_counts(df: DataFrame, category: str, descending: bool = False) -> DataFrame:
    """Rows and percentage share (one decimal) per category, rarest first."""
    rows = df.where(F.col(category).isNotNull())
    total = rows.select(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("volume"))
    out = counts.withColumn("share", F.round(F.col("volume") * 100.0 / total, 1))
    return out.orderBy(F.col("volume").desc() if descending else F.col("volume"), category)


def frequency(df: DataFrame, category: str, hue: str) -> DataFrame:
    return df.groupBy(category, hue).agg(F.count(F.lit(1)).alias("volume"))


def group_tree(df: DataFrame, group: str, ident: str, name: str) -> DataFrame:
    """Group → child rows with their position; a missing or empty group is named ``Null``.

    Kept flat (one row per child) so that a group of any size is never one cell.
    """
    named = df.select(F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("Null")).alias("group_name"),
                      F.col(ident).alias("id"), F.col(name).alias("name"))
    return running(named, ["group_name"], "id", {"position": F.lit(1)})


def hierarchy(df: DataFrame, ident: str, parent: str, name: str, order: str) -> DataFrame:
    """Two-level menu: each root with its children, ordered by ``order``."""
    roots = df.where(F.col(parent).isNull()).select(F.col(ident).alias("root_id"), F.col(name).alias("root_name"))
    children = df.where(F.col(parent).isNotNull()).select(
        F.col(parent).alias("root_id"), F.col(ident).alias("child_id"), F.col(name).alias("child_name"), order)
    placed = running(children, ["root_id"], order, {"position": F.lit(1)}).drop(order)
    return roots.join(placed, "root_id", "left")


def view(df: DataFrame, spec: ViewSpec) -> DataFrame:
    """Run a saved view: filter, calculated columns, grouped metrics with precision, sorter."""
    calc = df
    for name, text in spec.calculation.items():
        calc = calc.withColumn(name, F.expr(_bound(text, spec.variable)))
    rows = where(calc, spec.filter)
    if spec.agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {spec.agg!r}")
    aggregates = [AGGREGATES[spec.agg](m) for m in spec.metrics]
    if spec.prec is not None:
        aggregates = [F.round(a, spec.prec) for a in aggregates]
    out = rows.groupBy(*spec.dim).agg(*[a.alias(m) for a, m in zip(aggregates, spec.metrics)])
    sorter = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in spec.sorter]
    return out.orderBy(*sorter) if sorter else out


def _bound(text: str, variables: dict) -> str:
    """Replace ``:name`` by a literal number or quoted text; nothing is evaluated."""
    for name, value in variables.items():
        literal = str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
        text = re.sub(rf":{re.escape(name)}\b", lambda _: literal, text)
    return text


def soft_delete(df: DataFrame, ident: str, ids: Sequence, flag: str = "is_delete") -> DataFrame:
    return df.withColumn(flag, F.when(F.col(ident).isin(*ids), True).otherwise(F.col(flag)))


def hard_delete(df: DataFrame, ident: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(ident), ident, "left_anti")


def bulk_insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def bulk_update(df: DataFrame, changes: DataFrame, ident: str) -> DataFrame:
    """Rows with the same id take the non-null values of ``changes``."""
    new = [c for c in changes.columns if c != ident]
    side = changes.select(ident, *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = df.join(side, ident, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])
