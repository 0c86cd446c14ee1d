"""Anomalies of series: signed flags -1, 0, 1 with the limits beside them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grouped_map import per_series
from plumbline.functions.ordered import lookup_join, over_series, quantiles, running
from plumbline.operators.series import fill_series, series_with_gaps


def signed(value: Column, lower: Column, upper: Column) -> Column:
    return F.when(value < lower, -1).when(value > upper, 1).otherwise(0)


def _with_limits(df: DataFrame, limits: DataFrame, by: list[str], value: str) -> DataFrame:
    joined = lookup_join(df, limits, by)
    return joined.withColumn("outlier", signed(F.col(value), F.col("lower"), F.col("upper"))).drop("_all")


def _scope(df: DataFrame, key: str | None, whole: bool) -> tuple[DataFrame, list[str]]:
    """Limits per series, or one set for the whole table."""
    return (df, [key]) if key and not whole else (df.withColumn("_all", F.lit(0)), ["_all"])


def quartile_alerts(df: DataFrame, value: str, key: str | None = None, coefficient: float = 1.6, whole: bool = False) -> DataFrame:
    rows, by = _scope(df, key, whole)
    q = quantiles(rows, by, value, [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    limits = q.select(*by, (F.col("q")[0] - iqr * coefficient).alias("lower"), (F.col("q")[1] + iqr * coefficient).alias("upper"))
    return _with_limits(rows, limits, by, value)


def sigma_alerts(df: DataFrame, value: str, key: str | None = None, sigmas: float = 3, whole: bool = False) -> DataFrame:
    rows, by = _scope(df, key, whole)
    mean, sd = F.avg(value), F.stddev_samp(value)
    limits = rows.groupBy(*by).agg(F.round(mean - sd * sigmas, 3).alias("lower"), F.round(mean + sd * sigmas, 3).alias("upper"))
    return _with_limits(rows, limits, by, value)


def gap_alerts(df: DataFrame, value: str, key: str) -> DataFrame:
    """Missing periods flagged 1; only series that have any."""
    gaps = series_with_gaps(df, key, value).where("has_gap")
    return lookup_join(df, gaps, [key], "inner").drop("has_gap").withColumn("outlier", F.col(value).isNull().cast("int"))


def jump_alerts(df: DataFrame, ts: str, value: str, key: str | None = None, sigmas: float = 2,
                period: str | None = None, whole: bool = False) -> DataFrame:
    """Steps larger than ``sigmas`` standard deviations of the level."""
    rows, by = _scope(df, key, whole)
    keys = [key] if key else []
    stepped = over_series(rows, keys, ts, lambda w: {"_step": F.col(value) - F.lag(value).over(w)}, before=1, period=period)
    limits = rows.groupBy(*by).agg((F.stddev_samp(value) * sigmas).alias("_limit"))
    joined = lookup_join(stepped, limits, by)
    flag = signed(F.col("_step"), -F.col("_limit"), F.col("_limit"))
    return joined.select(*df.columns, F.round(F.col(value) - F.col("_limit"), 3).alias("lower"),
                         F.round(F.col(value) + F.col("_limit"), 3).alias("upper"), flag.alias("outlier"))


def rolling_alerts(df: DataFrame, ts: str, value: str, key: str | None = None, sigmas: float = 2,
                   period: str | None = None, whole: bool = False) -> DataFrame:
    """Values outside the centred three-point mean by ``sigmas`` standard deviations of that mean."""
    keys = [key] if key else []

    def build(w):
        frame = w.rowsBetween(-1, 1)
        return {"_mean": F.when(F.count(value).over(frame) == 3, F.avg(value).over(frame))}
    rolled = fill_series(over_series(df, keys, ts, build, before=1, after=1, period=period), ts, "_mean", "prev", key)
    rows, by = _scope(rolled, key, whole)
    limits = rows.groupBy(*by).agg((F.stddev_samp("_mean") * sigmas).alias("_limit"))
    joined = lookup_join(rows, limits, by)
    lower, upper = F.round(F.col("_mean") - F.col("_limit"), 3), F.round(F.col("_mean") + F.col("_limit"), 3)
    return joined.select(*df.columns, lower.alias("lower"), upper.alias("upper"), signed(F.col(value), lower, upper).alias("outlier"))


def alert_totals(df: DataFrame, ts: str) -> DataFrame:
    """Sums of positive and of negative flags per time."""
    hits = df.where(F.col("outlier") != 0)
    return hits.groupBy(ts, F.signum("outlier").cast("int").alias("sign")).agg(F.sum("outlier").cast("long").alias("alerts"))


# --- change points ---------------------------------------------------------------------------------

def change_points(df: DataFrame, ts: str, value: str, key: str | None = None, penalty: float = 5) -> DataFrame:
    """Segment ends (exclusive places) of least penalized Gaussian-kernel cost, per series.

    Kernel block sums come from one cumulative table; only starts that can still win are kept.
    """
    keys = [key] if key else []

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.dropna(subset=[value]).sort_values(ts)[value].to_numpy(dtype=float)
        n, least, jump = len(y), 2, 5
        ends = [n]
        if n >= 2 * least:
            d2 = (y[:, None] - y[None, :]) ** 2
            med = np.median(d2[np.triu_indices(n, 1)])
            gram = np.exp(-np.clip(d2 / med if med > 0 else d2, 0.01, 100))
            np.fill_diagonal(gram, 1.0)
            table = np.zeros((n + 1, n + 1))
            table[1:, 1:] = gram.cumsum(0).cumsum(1)
            cost = lambda a, b: (b - a) - (table[b, b] - table[a, b] - table[b, a] + table[a, a]) / (b - a)
            best, back, starts = {0: 0.0}, {}, [0]
            for end in [*range(jump, n, jump), n]:
                options = {s: best[s] + cost(s, end) + penalty for s in starts if end - s >= least}
                if not options:
                    continue
                back[end] = min(options, key=options.get)
                best[end] = options[back[end]]
                starts = [s for s in starts if s not in options or options[s] <= best[end] + penalty] + [end]
            ends, at = [], n
            while at > 0:
                ends.append(at)
                at = back[at]
            ends.reverse()
        out = pd.DataFrame({"segment": np.arange(len(ends)), "end": ends})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    return per_series(df.select(*keys, ts, value), key, split, f"{kind}segment int, `end` long", most=10_000)


def reshape_segments(df: DataFrame, ts: str, value: str, change: Column, key: str | None = None) -> DataFrame:
    """Calm segments (std below 1 without their two boundary points per inner edge) flattened to their mean.

    ``change`` marks the first row of each segment after the first.  Points outside the band keep their value.
    """
    keys = [key] if key else []
    placed = running(df.withColumn("_new", F.coalesce(change.cast("int"), F.lit(0))), keys, ts,
                     {"segment": F.col("_new"), "_place": F.lit(1)}, {"_cuts": F.col("_new"), "_size": F.lit(1)})
    by = [*keys, "segment"]
    ends = placed.groupBy(*by).agg(F.min("_place").alias("_a"), F.max("_place").alias("_b"))
    rows = placed.join(ends, by)
    edge = ((F.col("segment") > 0) & (F.col("_place") < F.col("_a") + 2)) | (
        (F.col("segment") < F.col("_cuts")) & (F.col("_place") > F.col("_b") - 2))
    stats = rows.where(~edge).groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    joined = lookup_join(rows, stats, by)
    margin = F.greatest(F.col("_sd") * 3, F.abs(F.col("_mean")) * 0.1)
    calm = (F.col("_cuts") > 0) & (F.col("_size") >= 7) & ~edge & (F.col("_sd") < 1)
    inside = F.abs(F.col(value) - F.col("_mean")) < margin
    return joined.select(*df.columns, "segment", F.when(calm & inside, F.col("_mean")).otherwise(F.col(value)).alias("reshaped"))
