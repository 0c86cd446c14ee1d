"""Calendar resampling and the shape of long series tables ``(key?, ts, values...)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.calendar import bin_index, bin_start, from_micros, micros, parse, widen
from plumbline.functions.ordered import carry_both, describe, lookup_join, over_series, quantiles
from plumbline.operators.query import AGGREGATES

SPINE = 4096    # calendar periods that one row is expanded into at a time


def aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], agg: str) -> DataFrame:
    """Values aggregated by keys under their own names."""
    if agg == "median":
        parts = [quantiles(df, keys, v, [0.5]).select(*keys, F.col("q")[0].alias(v)) for v in values]
        return reduce(lambda a, b: a.join(b, list(keys), "full"), parts)
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    return df.groupBy(*keys).agg(*[AGGREGATES[agg](v).alias(v) for v in values])


def by_time(df: DataFrame, ts: str, values: Sequence[str], key: str | None = None, agg: str = "mean") -> DataFrame:
    """Without a period: one row per time (and series)."""
    return aggregate(df, [key, ts] if key else [ts], values, agg)


def resample(df: DataFrame, ts: str, values: Sequence[str], key: str | None = None, period: str = "D",
             agg: str = "mean", gap: int | None = None, interval: int | None = None,
             fill: str | dict | None = None) -> DataFrame:
    """Aggregate into periods on the full calendar of the table: every period for every series, gaps as null.

    ``gap`` and ``interval`` (minutes) widen the period as a field's own resolution asks.  Empty periods
    inside a series' own span are 0 for sum and count.  ``fill`` names the method for remaining nulls.
    """
    period = widen(period, gap, interval) if gap or interval else period
    n, unit = parse(period)
    keys = [key] if key else []
    rows = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts), *values)
    first_ts, last_ts = F.min(ts), F.max(ts)
    origin = 0
    if n > 1:
        start = rows.agg(micros(F.date_trunc("week" if unit == "W" else "day", first_ts)).alias("o")).first()["o"] or 0
        origin = start + (3 * 86_400_000_000 if unit == "W" else 0)
        shift = from_micros(micros(F.col(ts)) - origin)
        rows = rows.withColumn(ts, shift)
    binned = aggregate(rows.withColumn("_bin", bin_index(F.col(ts), period)), [*keys, "_bin"], values, agg)
    ends = rows.agg(bin_index(first_ts, period).alias("lo"), bin_index(last_ts, period).alias("hi")).first()
    if ends["lo"] is None:
        return df.select(*keys, ts, *values).limit(0)
    spans = binned.groupBy(*keys).agg(F.min("_bin").alias("_from"), F.max("_bin").alias("_to"))
    # in two steps, and from columns: neither the plan nor a row ever holds the whole calendar
    low, high, size = F.least(F.lit(ends["lo"]), "_from"), F.greatest(F.lit(ends["hi"]), "_to"), F.lit(SPINE)
    parts = spans.withColumn("_part", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    bins = F.sequence(F.greatest(F.col("_part") * size, low), F.least(F.col("_part") * size + size - 1, high))
    spine = parts.select(*keys, "_from", "_to", F.explode(bins).alias("_bin"))
    full = spine.join(binned, [*keys, "_bin"], "left")
    label = bin_start(F.col("_bin"), period)
    if n > 1:
        label = from_micros(micros(label) + origin)
    inside = F.col("_bin").between(F.col("_from"), F.col("_to"))
    value = (lambda v: F.coalesce(v, F.when(inside, 0))) if agg in ("sum", "count") else (lambda v: F.col(v))
    out = full.select(*keys, label.alias(ts), *[value(v).alias(v) for v in values])
    for v in values:
        method = fill.get(v) if isinstance(fill, dict) else fill
        if method:
            out = fill_series(out, ts, v, method, key)
    return out


def fill_series(df: DataFrame, ts: str, value: str, method: str, key: str | None = None) -> DataFrame:
    """Fill nulls of a series value; prev and next finish the open end from the other side."""
    keys = [key] if key else []
    match method:
        case "prev" | "next":
            return carry_both(df, keys, ts, [value], backward=method == "next")
        case "zero":
            return df.withColumn(value, F.coalesce(value, F.lit(0)))
        case "mean" | "median" | "mode":
            if method == "mean":
                side = df.groupBy(*keys).agg(F.avg(value).alias("_fill"))
            elif method == "median":
                side = quantiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("_fill"))
            else:
                counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
                best = F.min(F.struct((-F.col("_n")).alias("r"), F.col(value).alias("v")))
                side = counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias("_fill"))
            return lookup_join(df, side, keys).withColumn(value, F.coalesce(value, "_fill")).drop("_fill")
        case _:
            raise ValueError(f"unknown fill {method!r}")


def series_with_gaps(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per series: whether any period is missing."""
    return df.groupBy(key).agg(F.bool_or(F.col(value).isNull()).alias("has_gap"))


def overview(df: DataFrame, ts: str, key: str | None = None) -> DataFrame:
    """First and last time, distinct times, and smallest and largest gap in seconds per series."""
    keys = [key] if key else []
    times = df.where(F.col(ts).isNotNull()).select(*keys, ts).distinct()
    gaps = over_series(times, keys, ts, lambda w: {"_gap": (micros(F.col(ts)) - micros(F.lag(ts).over(w))) / 1e6}, before=1)
    return gaps.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("points"),
                                   F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"))


# The complete domain of each seasonal part, and how a time reads as a member of it.
PARTS = {"quarter": (1, 4), "month": (1, 12), "weekday": (0, 6), "hour": (0, 23), "day": (1, 31)}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def part(ts: Column, name: str) -> Column:
    match name:
        case "quarter":
            return F.quarter(ts)
        case "month":
            return F.month(ts)
        case "weekday":
            return F.weekday(ts)
        case "hour":
            return F.hour(ts)
        case "day":
            return F.dayofmonth(ts)
        case _:
            raise ValueError(f"unknown part {name!r}")


def seasonal_table(df: DataFrame, ts: str, value: str, name: str, agg: str = "mean", key: str | None = None,
                   digits: int = 3) -> DataFrame:
    """Aggregate by a seasonal part on its complete domain; parts without rows stay null."""
    keys = [key] if key else []
    found = aggregate(df.withColumn("part", part(F.col(ts), name)), [*keys, "part"], [value], agg)
    low, high = PARTS[name]
    domain = found.select(*keys).distinct() if key else df.sparkSession.range(1).drop("id")
    spine = domain.withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return spine.join(found, [*keys, "part"], "left").withColumn(value, F.round(value, digits))


# Label pattern of each comparison unit.
UNITS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def unit_label(ts: Column, unit: str) -> Column:
    if unit == "q":
        return F.concat(F.lit("Q"), F.quarter(ts).cast("string"))
    if unit == "w":
        return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_format(ts, UNITS[unit])


def compare(df: DataFrame, ts: str, value: str, group: str, period: str, agg: str = "mean") -> DataFrame:
    """Period over period: one row per (group unit, period unit)."""
    labelled = df.select(unit_label(F.col(ts), group).alias("group"), unit_label(F.col(ts), period).alias("period"), value)
    return aggregate(labelled, ["group", "period"], [value], agg)


def distribution(df: DataFrame, ts: str, value: str, unit: str, key: str | None = None) -> DataFrame:
    """Count, mean, std and quartiles per period label and series."""
    keys = ["period", *([key] if key else [])]
    labelled = df.withColumn("period", unit_label(F.col(ts), unit)).select(*keys, value)
    stats = describe(labelled, keys, [value], [0.25, 0.5, 0.75])
    return stats.select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("pct25"),
                        F.col("q")[1].alias("median"), F.col("q")[2].alias("pct75"), "max")


def difference(df: DataFrame, ts: str, value: str, lag: int = 1, order: int = 1, key: str | None = None,
               period: str | None = None) -> DataFrame:
    """n-th order difference at a lag, per series: one window with binomial weights instead of n windows."""
    weights = [1.0]
    for _ in range(order):
        weights = [a - b for a, b in zip([*weights, 0.0], [0.0, *weights])]

    def build(w):
        return {"diff": reduce(lambda a, b: a + b, [F.lag(value, i * lag).over(w) * weights[i] for i in range(order + 1)])}
    return over_series(df, [key] if key else [], ts, build, before=lag * order, period=period)
