"""Trend, season and residual of series on a full calendar."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.calendar import bin_index
from plumbline.functions.grouped_map import per_series
from plumbline.functions.ordered import lookup_join, over_series, running
from plumbline.operators.smooth import bisquare, local_fit


def trend_direction(df: DataFrame, ts: str, value: str, key: str | None = None) -> DataFrame:
    """Slope per place against 3 % of the population standard deviation."""
    keys = [key] if key else []
    rows = running(df.where(F.col(value).isNotNull()), keys, ts, {"_place": F.lit(1)})
    fit = rows.groupBy(*keys).agg(F.regr_slope(value, "_place").alias("slope"), F.stddev_pop(value).alias("_sd"))
    limit = F.col("_sd") * 0.03
    word = (F.when(F.col("slope") > limit, "increasing trend").when(F.col("slope") < -limit, "decreasing trend")
            .otherwise("no significant trend"))
    return fit.withColumn("trending", word).drop("_sd")


def centred_mean(value: Column, w: WindowSpec, sp: int) -> Column:
    """Centred moving average over one season (half weights at the ends when even); null unless all values are there."""
    half = sp // 2
    inner = w.rowsBetween(-half, half) if sp % 2 else w.rowsBetween(-(half - 1), half - 1)
    total, seen = F.sum(value).over(inner), F.count(value).over(inner)
    if sp % 2:
        return F.when(seen == sp, total / sp)
    first, last = F.lag(value, half).over(w), F.lead(value, half).over(w)
    return F.when(seen == sp - 1, (total + first / 2 + last / 2) / sp)


def decompose(df: DataFrame, ts: str, value: str, sp: int, period: str, key: str | None = None,
              model: str = "add") -> DataFrame:
    """Classical decomposition: trend, seasonal and resid; additive, or multiplicative for positive values."""
    by = [key or "_all"]
    keyed = df if key else df.withColumn("_all", F.lit(0))
    rows = over_series(keyed, by, ts, lambda w: {"trend": centred_mean(F.col(value), w, sp)},
                       before=sp // 2, after=sp // 2, period=period)
    start = df.agg(F.min(bin_index(F.col(ts), period))).first()[0] or 0
    add = model == "add"
    rest = F.col(value) - F.col("trend") if add else F.try_divide(F.col(value), F.col("trend"))
    rows = rows.withColumn("_phase", F.pmod(bin_index(F.col(ts), period) - start, F.lit(sp))).withColumn("_rest", rest)
    phases = rows.groupBy(*by, "_phase").agg(F.avg("_rest").alias("_m"))
    whole = Window.partitionBy(*by)          # at most one row per phase
    centre = F.col("_m") - F.avg("_m").over(whole) if add else F.col("_m") / F.avg("_m").over(whole)
    season = phases.select(*by, "_phase", centre.alias("seasonal"))
    joined = lookup_join(rows, season, [*by, "_phase"])
    resid = (F.col(value) - F.col("trend") - F.col("seasonal") if add
             else F.try_divide(F.col(value), F.col("trend") * F.col("seasonal")))
    return joined.withColumn("resid", resid).drop("_phase", "_rest", "_all")


def choose_model(df: DataFrame, ts: str, value: str, sp: int, period: str, key: str | None = None) -> DataFrame:
    """Residual spread and mean square of both models per series, and the better one."""
    by = [key or "_all"]
    keyed = df if key else df.withColumn("_all", F.lit(0))

    def spread(model: str) -> DataFrame:
        parts = decompose(keyed, ts, value, sp, period, by[0], model)
        return parts.groupBy(*by).agg(F.stddev_pop("resid").alias(f"{model}_std"),
                                      F.avg(F.col("resid") * F.col("resid")).alias(f"{model}_mse"))
    positive = keyed.groupBy(*by).agg((F.min(value) > 0).alias("_ok"))
    both = spread("add").join(spread("multi"), by).join(positive, by)
    better = F.col("_ok") & (F.col("multi_std") < F.col("add_std")) & (F.col("multi_mse") < F.col("add_mse"))
    return both.withColumn("model", F.when(better, "multiplicative").otherwise("additive")).drop("_ok", "_all")


def season_search(df: DataFrame, ts: str, value: str, period: str, key: str | None = None,
                  candidates: Sequence[int] = range(2, 31)) -> DataFrame:
    """Residual spread of the additive decomposition for every candidate season, with the smallest marked.

    One window computes all candidate trends; residual variances follow from phase sums without joining back.
    """
    by = [key or "_all"]
    keyed = df if key else df.withColumn("_all", F.lit(0))
    reach = max(candidates) // 2 + 1
    rows = over_series(keyed.select(*by, ts, F.col(value).cast("double").alias(value)), by, ts,
                       lambda w: {f"_t{p}": centred_mean(F.col(value), w, p) for p in candidates},
                       before=reach, after=reach, period=period)
    start = df.agg(F.min(bin_index(F.col(ts), period))).first()[0] or 0
    place = bin_index(F.col(ts), period) - start
    cells = F.array(*[F.struct(F.lit(p).alias("sp"), F.pmod(place, F.lit(p)).alias("_phase"),
                               (F.col(value) - F.col(f"_t{p}")).alias("_d")) for p in candidates])
    phases = rows.select(*by, F.inline(cells)).groupBy(*by, "sp", "_phase").agg(
        F.count("_d").alias("_n"), F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q"))
    season = Window.partitionBy(*by, "sp")   # at most sp rows
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    centred = phases.withColumn("_c", mean - F.avg(mean).over(season))
    total, n = F.sum(F.col("_s") - F.col("_n") * F.col("_c")), F.sum("_n")
    squares = F.sum(F.col("_q") - 2 * F.col("_c") * F.col("_s") + F.col("_n") * F.col("_c") * F.col("_c"))
    spread = F.sqrt(F.greatest(F.try_divide(squares, n) - F.pow(F.try_divide(total, n), F.lit(2)), F.lit(0.0)))
    found = centred.groupBy(*by, "sp").agg(spread.alias("resid_std"), F.count_if(F.col("_n") == 0).alias("_empty"))
    found = found.where((F.col("_empty") == 0) & F.col("resid_std").isNotNull()).drop("_empty")
    best = F.min(F.struct("resid_std", "sp")).over(Window.partitionBy(*by))     # one row per candidate
    return found.withColumn("best", F.col("sp") == best["sp"]).drop("_all")


def stl_parts(y: np.ndarray, sp: int, robust: bool, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend parts by repeated local regression."""
    n = len(y)
    x = np.arange(n, dtype=float)
    odd = lambda v: int(v) + (int(v) + 1) % 2
    trend_k = odd(np.ceil(1.5 * sp / (1 - 1.5 / seasonal)))
    low_k = odd(sp + 1)
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            wide = np.empty(n + 2 * sp)
            free = y - trend
            for phase in range(sp):
                px, py = x[phase::sp], free[phase::sp]
                at = np.concatenate([[px[0] - sp], px, [px[-1] + sp]])
                fitted = local_fit(px, py, at, seasonal, weights[phase::sp])
                places = np.round(at).astype(int) + sp
                wide[places[places < len(wide)]] = fitted[places < len(wide)]
            low = wide
            for width in (sp, sp, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            season = wide[sp:sp + n] - local_fit(x, low, x, low_k)
            trend = local_fit(x, y - season, x, trend_k, weights)
        if robust:
            weights = bisquare(y - season - trend)
    return season, trend


def stl(df: DataFrame, ts: str, value: str, sp: int, key: str | None = None, robust: bool = False) -> DataFrame:
    """Seasonal-trend decomposition by local regression, with the seasonal strength of the series on each row."""
    keys = [key] if key else []

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(ts)
        y = pdf[value].to_numpy(dtype=float)
        if len(y) < 2 * sp:
            return pdf.assign(trend=np.nan, seasonal=np.nan, resid=np.nan, strength=np.nan)
        season, trend = stl_parts(y, sp, robust)
        resid = y - season - trend
        both = (resid + season).var(ddof=1)
        return pdf.assign(trend=trend, seasonal=season, resid=resid,
                          strength=1 - resid.var(ddof=1) / both if both else np.nan)
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    return per_series(df.select(*keys, ts, F.col(value).cast("double").alias(value)), key, parts,
                      f"{kind}`{ts}` timestamp_ntz, `{value}` double, trend double, seasonal double, resid double, strength double")
