"""Autocorrelation, stationarity, periodogram and frequency filtering of series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grouped_map import per_series
from plumbline.functions.ordered import lookup_join, over_series


def autocovariance(df: DataFrame, ts: str, value: str, lags: int, key: str | None = None,
                   period: str | None = None) -> DataFrame:
    """Per series: n and the sums of lagged products around the mean (array, lag 0 first)."""
    by = key or "_all"
    rows = (df if key else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    means = rows.groupBy(by).agg(F.avg(value).alias("_mean"))
    centred = lookup_join(rows, means, [by]).withColumn("_v", F.col(value) - F.col("_mean"))
    lagged = over_series(centred.select(by, ts, "_v"), [by], ts,
                         lambda w: {f"_l{k}": F.lag("_v", k).over(w) for k in range(1, lags + 1)}, before=lags, period=period)
    parts = [F.sum(F.col("_v") * F.col("_v"))] + [F.coalesce(F.sum(F.col("_v") * F.col(f"_l{k}")), F.lit(0.0))
                                                  for k in range(1, lags + 1)]
    out = lagged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("cov"))
    return out if key else out.drop("_all")


def autocorrelation(df: DataFrame, ts: str, value: str, lags: int = 10, key: str | None = None,
                    period: str | None = None) -> DataFrame:
    """One row per series and lag: ``acf`` and the half width ``bound`` of its 95 % Bartlett band."""
    keys = [key] if key else []
    cov = autocovariance(df, ts, value, lags, key, period)
    rho = F.transform("cov", lambda c: F.try_divide(c, F.col("cov")[0]))
    rows = cov.withColumn("_rho", rho).select(*keys, "n", "_rho", F.posexplode("_rho").alias("lag", "acf"))
    rows = rows.where(F.col("lag") < F.greatest(F.floor(F.col("n") / 2), F.lit(1)))
    before = F.slice("_rho", F.lit(2), F.greatest(F.col("lag") - 1, F.lit(0)))
    spread = F.aggregate(before, F.lit(0.0), lambda a, r: a + r * r)
    band = F.when(F.col("lag") == 0, 0.0).otherwise(1.959963984540054 * F.sqrt((1 + 2 * spread) / F.col("n")))
    return rows.select(*keys, "lag", "acf", band.alias("bound"))


def partial_autocorrelation(df: DataFrame, ts: str, value: str, lags: int = 10, key: str | None = None,
                            period: str | None = None) -> DataFrame:
    """Adjusted Yule-Walker partial autocorrelation with its 1.96/sqrt(n) band."""
    keys = [key] if key else []

    @F.pandas_udf("array<double>")
    def levinson(cov: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for c, size in zip(cov, n):
            r = np.array(c, dtype=float) / (size - np.arange(len(c)))
            phi, variance, partial = np.zeros(0), r[0], [1.0]
            for k in range(1, len(r)):
                last = (r[k] - phi @ r[k - 1:0:-1]) / variance if variance else 0.0
                phi = np.append(phi - last * phi[::-1], last)
                variance *= 1 - last * last
                partial.append(last)
            out.append(partial)
        return pd.Series(out)

    cov = autocovariance(df, ts, value, lags, key, period)
    rows = cov.select(*keys, "n", F.posexplode(levinson("cov", "n")).alias("lag", "pacf"))
    return rows.select(*keys, "lag", "pacf", (1.959963984540054 / F.sqrt("n")).alias("bound"))


# Response surface of the unit-root test with a constant, and critical values of the level test.
ROOT_LIMITS = (-18.83, -1.61, 2.74)                       # smallest, switch, largest statistic
ROOT_SMALL = (2.1659, 1.4412, 0.038269)
ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
LEVEL_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def unit_root_p(y: np.ndarray) -> tuple[float, float]:
    """Augmented Dickey-Fuller statistic (constant, lag by AIC) and its approximate p value."""
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(y)

    def regress(lag: int, start: int):
        rows = np.arange(start, len(d))
        x = np.column_stack([y[rows], np.ones(len(rows)), *[d[rows - i] for i in range(1, lag + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        rss = float(((d[rows] - x @ beta) ** 2).sum())
        return x, beta, rss

    best, chosen = math.inf, 0
    for lag in range(most + 1):
        x, _, rss = regress(lag, most)
        m = len(x)
        aic = m * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / m) + 1) + 2 * (lag + 2)
        if aic < best:
            best, chosen = aic, lag
    x, beta, rss = regress(chosen, chosen)
    cov = np.linalg.pinv(x.T @ x) * rss / max(len(x) - x.shape[1], 1)
    stat = beta[0] / math.sqrt(cov[0, 0]) if cov[0, 0] > 0 else -math.inf
    low, switch, high = ROOT_LIMITS
    if stat <= low:
        return stat, 0.0
    if stat >= high:
        return stat, 1.0
    z = sum(c * stat ** i for i, c in enumerate(ROOT_SMALL if stat <= switch else ROOT_LARGE))
    return stat, 0.5 * math.erfc(-z / math.sqrt(2))


def level_p(y: np.ndarray) -> tuple[float, float]:
    """Level stationarity (KPSS) statistic with automatic Bartlett lag, and its clipped table p value."""
    n = len(y)
    e = y - y.mean()
    auto = int(n ** (2 / 9))
    prods = [e[i:] @ e[:n - i] / (n / 2) for i in range(1, auto + 1)]
    s0, s1 = e @ e / n + sum(prods), sum((i + 1) * p for i, p in enumerate(prods))
    lag = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    spread = e @ e / n + 2 / n * sum((e[i:] @ e[:n - i]) * (1 - i / (lag + 1)) for i in range(1, lag + 1))
    stat = float((e.cumsum() ** 2).sum() / (n * n * spread)) if spread > 0 else 0.0
    points, ps = zip(*LEVEL_POINTS)
    return stat, float(np.interp(stat, points, ps))


def stationarity(df: DataFrame, ts: str, value: str, key: str | None = None) -> DataFrame:
    """Stationary when the unit root is rejected (p < 0.05) and level stationarity is not (p > 0.05)."""
    keys = [key] if key else []

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].dropna().to_numpy(dtype=float)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        if len(y) < 8 or np.ptp(y) == 0:
            return pd.DataFrame({**head, "adf": [np.nan], "adf_p": [np.nan], "kpss": [np.nan], "kpss_p": [np.nan],
                                 "stationary": [None]})
        adf, adf_p = unit_root_p(y)
        kpss, kpss_p = level_p(y)
        return pd.DataFrame({**head, "adf": [adf], "adf_p": [adf_p], "kpss": [kpss], "kpss_p": [kpss_p],
                             "stationary": [bool(adf_p < 0.05 and kpss_p > 0.05)]})
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    return per_series(df.select(*keys, ts, value), key, test,
                      f"{kind}adf double, adf_p double, kpss double, kpss_p double, stationary boolean")


def power(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided periodogram of a series around its mean."""
    n = len(y)
    spectrum = np.abs(np.fft.rfft(y - y.mean())) ** 2 / n
    spectrum[1:(n + 1) // 2] *= 2
    return np.fft.rfftfreq(n), spectrum


def periodogram(df: DataFrame, ts: str, value: str, key: str | None = None) -> DataFrame:
    """Frequency and power per series (4 decimals)."""
    keys = [key] if key else []

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].dropna().to_numpy(dtype=float)
        f, p = power(y) if len(y) else (np.zeros(0), np.zeros(0))
        out = pd.DataFrame({"freq": f, "power": p})
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    rows = per_series(df.select(*keys, ts, value), key, transform, f"{kind}freq double, power double")
    return rows.withColumns({"freq": F.round("freq", 4), "power": F.round("power", 4)})


def top_cycles(df: DataFrame, ts: str, value: str, key: str | None = None, top: int = 5) -> DataFrame:
    """The strongest frequencies per series with their cycle length (1/frequency, one decimal)."""
    from pyspark.sql import Window
    spectrum = periodogram(df, ts, value, key)
    keys = [key] if key else []
    keyed = spectrum if key else spectrum.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*(keys or ["_all"])).orderBy(F.col("power").desc(), "freq")
    best = keyed.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= top) & (F.col("power") > 0))
    return best.select(*keys, "rank", "freq", "power", F.round(F.try_divide(F.lit(1.0), F.col("freq")), 1).alias("cycle"))


def low_pass(df: DataFrame, ts: str, value: str, cutoff: float, key: str | None = None) -> DataFrame:
    """Remove frequencies above ``cutoff`` (share of the sampling rate, 0 to 0.5); gaps must be filled before."""
    if not 0 < cutoff <= 0.5:
        raise ValueError("cutoff is a share of the sampling rate in (0, 0.5]")
    keys = [key] if key else []

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(ts)
        y = pdf[value].to_numpy(dtype=float)
        kept = np.fft.rfft(y) * (np.fft.rfftfreq(len(y)) <= cutoff) if len(y) else y
        return pdf.assign(clean=np.fft.irfft(kept, n=len(y)) if len(y) else y)
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    return per_series(df.select(*keys, ts, F.col(value).cast("double").alias(value)), key, clean,
                      f"{kind}`{ts}` timestamp_ntz, `{value}` double, clean double")
