"""Moving averages and trends of series."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.calendar import SECONDS, bin_index, micros, parse
from plumbline.functions.grouped_map import per_series
from plumbline.functions.ordered import carry, lookup_join, over_series, running
from plumbline.functions.settings import CHUNK_ROWS, bound
from plumbline.functions.tails import t_tail


def moving_average(df: DataFrame, ts: str, value: str, window: int | str, key: str | None = None,
                   period: str | None = None) -> DataFrame:
    """Simple moving average ``sma``: over rows (null below half a window) or over a time span such as ``2D``."""
    keys = [key] if key else []
    if isinstance(window, int):
        def build(w):
            frame = w.rowsBetween(-(window - 1), 0)
            enough = F.count(value).over(frame) >= math.ceil(window / 2)
            return {"sma": F.when(enough, F.avg(value).over(frame))}
        return over_series(df, keys, ts, build, before=window - 1, period=period)
    n, unit = parse(window)
    span = n * SECONDS[unit] * 1_000_000
    return _over_span(df, keys, ts, value, span)


def _over_span(df: DataFrame, keys: list[str], ts: str, value: str, span: int) -> DataFrame:
    """Mean over the half-open span ending at each row.

    Time is cut into chunks of one span, so a row's span is the beginning of its chunk up to the row and the end of the
    chunk before, behind the row's place in it.  Both are sums that only grow, one row at a time, however many rows a span holds.
    """
    at = micros(F.col(ts))
    placed = df.withColumn("_off", F.pmod(at, F.lit(span))).withColumn("_own", ((at - F.col("_off")) / span).cast("long"))
    halo = placed.withColumn("_part", F.explode(F.array_compact(F.array("_own", F.col("_own") + 1))))
    mine = F.col("_own") == F.col("_part")
    ahead = Window.partitionBy(*keys, "_part").orderBy("_off").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "_part").orderBy(F.col("_off").desc()).rangeBetween(Window.unboundedPreceding, -1)
    held = F.col(value).cast("double")
    total = [F.coalesce(F.sum(F.when(m, held)).over(w), F.lit(0.0)) for m, w in ((mine, ahead), (~mine, behind))]
    count = [F.count(F.when(m, held)).over(w) for m, w in ((mine, ahead), (~mine, behind))]
    out = halo.withColumns({"_s0": total[0], "_n0": count[0], "_s1": total[1], "_n1": count[1]}).where(mine)
    return out.select(*df.columns, F.try_divide(F.col("_s0") + F.col("_s1"), F.col("_n0") + F.col("_n1")).alias("sma"))


def weighted_average(df: DataFrame, ts: str, value: str, window: int, key: str | None = None,
                     period: str | None = None) -> DataFrame:
    """Linearly weighted moving average ``wma``: newest weight ``window``, oldest 1; null unless full."""
    total = window * (window + 1) / 2

    def build(w):
        return {"wma": reduce(lambda a, b: a + b, [F.lag(value, i).over(w) * (window - i) for i in range(window)]) / total}
    return over_series(df, [key] if key else [], ts, build, before=window - 1, period=period)


def exponential_average(df: DataFrame, ts: str, value: str, key: str | None = None, span: float | None = None,
                        halflife: float | None = None, period: str | None = None, name: str = "ema") -> DataFrame:
    """Adjusted exponentially weighted mean; gaps keep their place in the weights and repeat the last mean.

    Weights relative to a block start keep sums finite, so a block is at most 40 e-foldings long.  What a
    block needs from earlier ones is the previous block alone (older weights are below double precision) or,
    for slow decay, a short recursion over one row per block.
    """
    keys = [key] if key else []
    alpha = 2 / (span + 1) if span is not None else 1 - 0.5 ** (1 / halflife)
    rate = -math.log1p(-alpha) if alpha < 1 else 745.0
    longest = bound(df.sparkSession, CHUNK_ROWS)
    size = max(1, min(int(40 / rate), longest))
    placed = (df.withColumn("_place", bin_index(F.col(ts), period)) if period
              else running(df, keys, ts, {"_place": F.lit(1)}))
    block = F.floor(F.col("_place") / size)
    rows = placed.withColumn("_block", block).withColumn("_at", F.col("_place") - F.col("_block") * size)
    grow = F.exp(F.col("_at") * rate)
    seen = F.col(value).isNotNull()
    rows = rows.withColumns({"_num": F.when(seen, F.col(value) * grow), "_den": F.when(seen, grow)})
    # one row per block, brought to the block's last place
    end = math.exp(-rate * (size - 1))
    ends = rows.groupBy(*keys, "_block").agg((F.coalesce(F.sum("_num"), F.lit(0.0)) * end).alias("_n"),
                                             (F.coalesce(F.sum("_den"), F.lit(0.0)) * end).alias("_d"))
    if size < longest:
        before = ends.select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_n").alias("_pn"), F.col("_d").alias("_pd"))
    else:
        fade = math.exp(-rate * size)

        def recursion(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_block")
            n = d = 0.0
            last, out = None, []
            for b, num, den in zip(pdf["_block"], pdf["_n"], pdf["_d"]):
                gap = fade ** (b - last) if last is not None else 0.0
                n, d, last = num + n * gap, den + d * gap, b
                out.append((b + 1, n, d))
            made = pd.DataFrame(out, columns=["_block", "_pn", "_pd"])
            for k in keys:
                made.insert(0, k, pdf[k].iloc[0])
            return made
        kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
        before = per_series(ends, key, recursion, f"{kind}_block long, _pn double, _pd double")
    joined = rows.join(before, [*keys, "_block"], "left")
    w = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    old = math.exp(-rate)
    num = F.coalesce(F.sum("_num").over(w), F.lit(0.0)) + F.coalesce("_pn", F.lit(0.0)) * old
    den = F.coalesce(F.sum("_den").over(w), F.lit(0.0)) + F.coalesce("_pd", F.lit(0.0)) * old
    mean = joined.withColumn(name, F.when(seen, F.try_divide(num, den)))
    return carry(mean.select(*df.columns, name), keys, ts, [name])


def rolling_trend(df: DataFrame, ts: str, value: str, frac: float = 0.667, key: str | None = None) -> DataFrame:
    """Rolling mean over floor(frac * n) rows with one value enough.

    The window grows with the series, so it is a difference of two running sums found by an equi join on place.
    """
    keys = [key] if key else []
    share = min(max(frac, 0.0), 1.0)
    sums = running(df, keys, ts, {"_place": F.lit(1), "_sum": F.coalesce(value, F.lit(0.0)),
                                  "_cnt": F.col(value).isNotNull().cast("long")}, {"_size": F.lit(1)})
    window = F.greatest(F.floor(F.col("_size") * share), F.lit(1)).cast("long")
    sums = sums.withColumn("_back", F.col("_place") - window)
    earlier = sums.select(*keys, F.col("_place").alias("_back"), F.col("_sum").alias("_s0"), F.col("_cnt").alias("_c0"))
    joined = sums.join(earlier, [*keys, "_back"], "left")
    n = F.col("_cnt") - F.coalesce("_c0", F.lit(0))
    mean = F.try_divide(F.col("_sum") - F.coalesce("_s0", F.lit(0.0)), n)
    return joined.select(*df.columns, mean.alias("trend"))


def half_life_trend(df: DataFrame, ts: str, value: str, points: int, frac: float = 0.667, key: str | None = None,
                    period: str | None = None) -> DataFrame:
    """Exponentially weighted trend with half-life floor(frac * points)."""
    life = max(1, math.floor(points * min(max(frac, 0.0), 1.0)))
    return exponential_average(df, ts, value, key, halflife=life, period=period, name="trend")


# Significance marks and their upper p limits.
LEVELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))


def linear_trend(df: DataFrame, ts: str, value: str, key: str) -> DataFrame:
    """Slope (per minute since the first time) and intercept per series; t and p of the slope's difference
    from the first series, with the pooled residual variance."""
    start = df.agg(F.min(micros(F.col(ts)))).first()[0] or 0
    x = (micros(F.col(ts)) - start) / 60_000_000.0
    rows = df.where(F.col(value).isNotNull()).select(key, x.alias("_x"), F.col(value).cast("double").alias("_y"))
    fits = rows.groupBy(key).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.count(F.lit(1)).alias("n"), F.regr_sxx("_y", "_x").alias("_sxx"),
        (F.regr_syy("_y", "_x") - F.regr_sxy("_y", "_x") * F.regr_slope("_y", "_x")).alias("_sse"))
    pool = fits.agg(F.sum("_sse").alias("sse"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"),
                    F.min_by(F.struct("slope", "_sxx"), F.col(key)).alias("ref"), F.min(key).alias("name")).first()
    if pool is None or pool["ref"] is None:
        return fits.drop("_sxx", "_sse")
    free = pool["n"] - 2 * pool["g"]
    s2 = pool["sse"] / free if free > 0 else float("nan")
    t = (F.col("slope") - pool["ref"]["slope"]) / F.sqrt(F.lit(s2) * (1 / F.col("_sxx") + 1 / pool["ref"]["_sxx"]))
    other = F.col(key) != F.lit(pool["name"])
    out = fits.withColumn("t", F.when(other, t)).withColumn("p", F.when(other, t_tail(F.coalesce("t", F.lit(0.0)), F.lit(float(free)))))
    level = F.lit("-")
    for limit, mark in reversed(LEVELS):
        level = F.when(F.col("p") < limit, mark).otherwise(level)
    return out.withColumn("level", F.when(other, level).otherwise("reference")).drop("_sxx", "_sse")


def polynomial_trend(df: DataFrame, ts: str, value: str, frac: float = 0.667, key: str | None = None) -> DataFrame:
    """Least-squares polynomial of degree floor(1/frac) per series, from power sums of centred and scaled places."""
    degree = int(1 // frac)
    by = [key or "_all"]
    keyed = df if key else df.withColumn("_all", F.lit(0))
    placed = running(keyed, by, ts, {"_place": F.lit(1)}, {"_size": F.lit(1)})
    half = F.greatest((F.col("_size") - 1) / 2, F.lit(0.5))
    rows = placed.withColumn("_u", (F.col("_place") - 1 - (F.col("_size") - 1) / 2) / half)
    ok = F.col(value).isNotNull()
    sums = [F.sum(F.when(ok, F.pow("_u", F.lit(k)))).alias(f"_m{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(F.pow("_u", F.lit(k)) * F.col(value)).alias(f"_v{k}") for k in range(degree + 1)]
    moments = rows.groupBy(*by).agg(*sums)

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for ms, vs in zip(m, v):
            normal = np.array([[ms[i + j] for j in range(degree + 1)] for i in range(degree + 1)], dtype=float)
            out.append(np.linalg.lstsq(normal, np.array(vs, dtype=float), rcond=None)[0].tolist())
        return pd.Series(out)

    coefs = moments.select(*by, solve(F.array(*[f"_m{k}" for k in range(2 * degree + 1)]),
                                        F.array(*[f"_v{k}" for k in range(degree + 1)])).alias("_c"))
    joined = lookup_join(rows, coefs, by)
    trend = reduce(lambda a, b: a + b, [F.col("_c")[k] * F.pow("_u", F.lit(k)) for k in range(degree + 1)])
    return joined.select(*df.columns, trend.alias("trend"))


def local_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, k: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Tricube-weighted local lines through the ``k`` nearest of sorted ``x``, evaluated at ``at``."""
    n = len(x)
    k = min(max(k, 2), n)
    out = np.empty(len(at))
    left = 0
    for i, x0 in enumerate(at):
        while left + k < n and x0 - x[left] > x[left + k] - x0:
            left += 1
        xs, ys = x[left:left + k], y[left:left + k]
        far = max(abs(x0 - xs[0]), abs(xs[-1] - x0)) or 1.0
        w = (1 - np.minimum(np.abs(xs - x0) / (far * 1.0000001), 1) ** 3) ** 3
        if robust is not None:
            w = w * robust[left:left + k]
        s = w.sum()
        if s <= 0:
            out[i] = ys.mean()
            continue
        mx, my = (w * xs).sum() / s, (w * ys).sum() / s
        sxx = (w * (xs - mx) ** 2).sum()
        out[i] = my + ((w * (xs - mx) * (ys - my)).sum() / sxx * (x0 - mx) if sxx > 1e-12 * far * far else 0.0)
    return out


def bisquare(residual: np.ndarray) -> np.ndarray:
    scale = 6 * np.median(np.abs(residual))
    return (1 - np.minimum(np.abs(residual) / scale, 1) ** 2) ** 2 if scale > 0 else np.ones(len(residual))


def lowess_trend(df: DataFrame, ts: str, value: str, frac: float = 0.667, key: str | None = None) -> DataFrame:
    """Robust locally weighted line with three reweighting passes, per series."""
    share = min(max(frac, 0.0), 1.0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        out = pdf[[*keys, ts, value]].assign(trend=np.nan)
        ok = pdf[value].notna().to_numpy()
        x = (pdf[ts].astype("int64").to_numpy() / 1e9)[ok]
        y = pdf[value].to_numpy(dtype=float)[ok]
        if len(x) > 2:
            k, robust = max(2, int(share * len(x) + 1e-10)), None
            for _ in range(4):
                line = local_fit(x, y, x, k, robust)
                robust = bisquare(y - line)
            out.loc[ok, "trend"] = line
        return out
    keys = [key] if key else []
    kind = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)
    schema = f"{kind}`{ts}` timestamp_ntz, `{value}` double, trend double"
    return per_series(df.select(*keys, ts, F.col(value).cast("double").alias(value)), key, fit, schema, most=100_000)
