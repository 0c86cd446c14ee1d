"""Forecasts of many series at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.calendar import bin_index, bin_start
from plumbline.functions.grouped_map import per_series
from plumbline.functions.ordered import lookup_join


def persistence(df: DataFrame, ts: str, value: str, period: str, d: int = 0, season_d: int = 0, steps: int = 14,
                season: int = 12, key: str | None = None) -> DataFrame:
    """Forecast of a series whose d-th and seasonal differences are pure noise.

    (1 - B)^d (1 - B^s)^D y = 0 makes every prediction a fixed combination of the last d + s*D values, so only
    that short tail of each series is gathered.
    """
    keys = [key] if key else []
    coef = np.array([1.0])
    for _ in range(d):
        coef = np.convolve(coef, [1, -1])
    for _ in range(season_d):
        coef = np.convolve(coef, [1, *([0] * (season - 1)), -1])
    need = len(coef) - 1
    place = bin_index(F.col(ts), period)
    rows = df.where(F.col(value).isNotNull()).select(*keys, place.alias("_i"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.max("_i").alias("_end"))
    if need == 0:
        out = ends.select(*keys, "_end", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.lit(0.0).alias("forecast"))
        return out.select(*keys, "step", bin_start(F.col("_end") + F.col("step"), period).alias(ts), "forecast")
    on = keys or ["_all"]
    flagged, last = (rows, ends) if keys else (rows.withColumn("_all", F.lit(0)), ends.withColumn("_all", F.lit(0)))
    tail = flagged.join(last, on).where(F.col("_i") > F.col("_end") - need)
    tails = tail.groupBy(*on, "_end").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))),
                                                      lambda r: r["_v"]).alias("_tail"))
    used = [(i, -c) for i, c in enumerate(coef) if i and c]

    def extend(acc, _):
        nxt = sum((F.element_at(acc, F.lit(-i)) * F.lit(float(c)) for i, c in used), F.lit(0.0))
        return F.concat(acc, F.array(nxt))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_tail"), extend)
    whole = tails.where(F.size("_tail") == need)
    ahead = whole.select(*keys, "_end", F.posexplode(F.slice(grown, need + 1, steps)).alias("_p", "forecast"))
    return ahead.select(*keys, (F.col("_p") + 1).alias("step"),
                        bin_start(F.col("_end") + F.col("_p") + 1, period).alias(ts), "forecast")


# --- exponential smoothing ---------------------------------------------------------------------------

def smooth_paths(y: np.ndarray, grid: np.ndarray, trend: str | None, season: str | None, m: int, steps: int):
    """Run smoothing for all parameter rows (alpha, beta, gamma, phi) at once: squared error sums and forecasts."""
    alpha, beta, gamma, phi = grid.T
    n, g = len(y), len(grid)
    level = np.full(g, y[0])
    slope = np.full(g, (y[1] - y[0]) if trend == "add" else (y[1] / y[0] if trend else 0.0))
    if trend is None:
        slope = np.zeros(g)
    if season:
        first, second = y[:m].mean(), y[m:2 * m].mean()
        level = np.full(g, first)
        slope = np.full(g, (second - first) / m) if trend == "add" else np.full(g, (second / first) ** (1 / m)) if trend else slope
        seasons = np.tile((y[:m] - first) if season == "add" else y[:m] / first, (g, 1))
    sse = np.zeros(g)
    combine = (lambda a, s: a + s) if season == "add" else (lambda a, s: a * s)
    remove = (lambda a, s: a - s) if season == "add" else (lambda a, s: a / s)
    move = ((lambda a, b, h: a * b ** h) if trend == "mul" else (lambda a, b, h: a + b * h))
    for t in range(n):
        base = move(level, slope, phi) if trend else level
        s = seasons[:, t % m] if season else None
        error = y[t] - (combine(base, s) if season else base)
        sse += error * error
        seen = remove(y[t], s) if season else y[t]
        old = level
        level = alpha * seen + (1 - alpha) * base
        if trend == "add":
            slope = beta * (level - old) + (1 - beta) * phi * slope
        elif trend == "mul":
            slope = beta * (level / old) + (1 - beta) * slope ** phi
        if season:
            seasons[:, t % m] = gamma * remove(y[t], base) + (1 - gamma) * s
    ahead, damp = [], np.zeros(g)
    for h in range(1, steps + 1):
        damp = damp + phi ** h
        point = move(level, slope, damp) if trend else level
        ahead.append(combine(point, seasons[:, (n + h - 1) % m]) if season else point)
    return sse, np.array(ahead).T if steps else None


def smooth_fit(y: np.ndarray, trend: str | None, season: str | None, m: int, damped: bool, steps: int):
    """Parameters of least squared error by a grid refined four times; returns (sse, parameters, forecast)."""
    centre, width = [0.5, 0.2 if trend else 0.0, 0.2 if season else 0.0, 0.9 if damped else 1.0], 0.5
    moving = [True, bool(trend), bool(season), damped]
    best = None
    for _ in range(5):
        axes = []
        for i, c in enumerate(centre):
            low, high = (0.8, 0.995) if i == 3 else (0.0001, 0.9999)
            axes.append(np.unique(np.clip(np.linspace(c - width, c + width, 7), low, high)) if moving[i] else [c])
        grid = np.array(list(itertools.product(*axes)))
        with np.errstate(all="ignore"):
            sse, ahead = smooth_paths(y, grid, trend, season, m, steps)
        sse = np.where(np.isfinite(sse), sse, np.inf)
        at = int(np.argmin(sse))
        if best is None or sse[at] < best[0]:
            best = (float(sse[at]), grid[at].tolist(), ahead[at])
        centre, width = best[1], width / 3
    return best


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys) + rest


def _forecast(df: DataFrame, ts: str, value: str, period: str, key: str | None, steps: int,
              method: Callable[[np.ndarray, int], tuple[str, np.ndarray] | None]) -> DataFrame:
    """Apply a numpy forecaster to each series of a full calendar; too short series give no rows."""
    keys = [key] if key else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_v"]).sort_values("_i")
        y = pdf["_v"].to_numpy(dtype=float)
        made = method(y, steps) if len(y) >= 4 else None
        name, ahead = made if made is not None else ("", np.zeros(0))
        out = pd.DataFrame({"_end": int(pdf["_i"].max()) if len(pdf) else 0,
                            "step": np.arange(1, len(ahead) + 1), "model": name, "forecast": np.asarray(ahead, dtype=float)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
        return out
    rows = df.select(*keys, bin_index(F.col(ts), period).alias("_i"), F.col(value).cast("double").alias("_v"))
    out = per_series(rows, key, run, _schema(df, keys, "_end long, step int, model string, forecast double"))
    return out.select(*keys, "step", bin_start(F.col("_end") + F.col("step"), period).alias(ts), "model", "forecast")


def simple_smoothing(df, ts, value, period, key=None, steps=14) -> DataFrame:
    return _forecast(df, ts, value, period, key, steps, lambda y, h: ("ses", smooth_fit(y, None, None, 1, False, h)[2]))


def holt(df, ts, value, period, key=None, steps=14, damped=False) -> DataFrame:
    return _forecast(df, ts, value, period, key, steps, lambda y, h: ("holt", smooth_fit(y, "add", None, 1, damped, h)[2]))


def holt_winters(df, ts, value, period, key=None, steps=14, trend: str | None = None, season: str | None = None,
                 sp: int = 12) -> DataFrame:
    def method(y, h):
        if season and len(y) < 2 * sp or "mul" in (trend, season) and y.min() <= 0:
            return None
        return "ets", smooth_fit(y, trend, season, sp, False, h)[2]
    return _forecast(df, ts, value, period, key, steps, method)


def season_by_correlation(y: np.ndarray, most: int = 30) -> int:
    """Lag of the highest significant autocorrelation peak, or 1."""
    e = y - y.mean()
    total = e @ e
    r = np.array([e[k:] @ e[:len(e) - k] / total if total else 0.0 for k in range(min(most, len(y) // 2) + 1)])
    peaks = [k for k in range(2, len(r) - 1) if r[k] > r[k - 1] and r[k] >= r[k + 1] and r[k] > 1.96 / math.sqrt(len(y))]
    return max(peaks, key=lambda k: r[k]) if peaks else 1


def best_smoothing(y: np.ndarray, steps: int) -> tuple[str, np.ndarray]:
    """Smoothing model of the smallest corrected information criterion."""
    m, n, best = season_by_correlation(y), len(y), None
    kinds = [None, "add", "mul"] if y.min() > 0 else [None, "add"]
    for trend in (None, "add"):
        for season in (kinds if m > 1 and n >= 2 * m + 3 else [None]):
            sse, _, ahead = smooth_fit(y, trend, season, max(m, 1), False, steps)
            k = 2 + 2 * bool(trend) + (m + 1 if season else 0)
            score = n * math.log(max(sse, 1e-300) / n) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf)
            if best is None or score < best[0]:
                best = (score, f"ets({trend or 'none'},{season or 'none'},{m})", ahead)
    return best[1], best[2]


def auto_smoothing(df, ts, value, period, key=None, steps=14) -> DataFrame:
    return _forecast(df, ts, value, period, key, steps, best_smoothing)


def best_autoregression(y: np.ndarray, steps: int, sp: int = 12) -> tuple[str, np.ndarray]:
    """Autoregression with order by AIC on the difference (none, first, seasonal) of the smallest spread."""
    options = [(0, 0), (1, 0)] + ([(0, 1), (1, 1)] if len(y) >= 3 * sp else [])

    def differ(v, d, s):
        v = v[sp:] - v[:-sp] if s else v
        return np.diff(v) if d else v
    d, s = min(options, key=lambda o: differ(y, *o).std())
    z = differ(y, d, s)
    mean, e = z.mean(), z - z.mean()
    most = max(0, min(6, len(e) // 4))
    best = (math.inf, 0, np.zeros(0))
    for p in range(most + 1):
        x = np.column_stack([e[most - i:len(e) - i] for i in range(1, p + 1)]) if p else np.zeros((len(e) - most, 0))
        phi = np.linalg.lstsq(x, e[most:], rcond=None)[0] if p else np.zeros(0)
        rss = float(((e[most:] - x @ phi) ** 2).sum())
        score = len(x) * math.log(max(rss, 1e-300) / len(x)) + 2 * (p + 1)
        if score < best[0] - 1e-9:
            best = (score, p, phi)
    _, p, phi = best
    past, full = list(e), list(y)
    for _ in range(steps):
        past.append(float(sum(phi[i] * past[-1 - i] for i in range(p))))
        step = past[-1] + mean
        if s and d:
            full.append(step + full[-1] + full[-sp] - full[-sp - 1])
        else:
            full.append(step + (full[-1] if d else full[-sp] if s else 0.0))
    return f"ar({p}) d={d} D={s}", np.array(full[len(y):])


def auto_autoregression(df, ts, value, period, key=None, steps=14, sp=12) -> DataFrame:
    """Role of automatic ARIMA: moving-average terms are not fitted."""
    return _forecast(df, ts, value, period, key, steps, lambda y, h: best_autoregression(y, h, sp))


def seasonal_regression(y: np.ndarray, steps: int, sp: float, multiplicative: bool = False, waves: int = 3,
                        knots: int = 8, extra: np.ndarray | None = None) -> tuple[str, np.ndarray]:
    """Ridge least squares on a piecewise linear trend and Fourier terms of the season."""
    target = np.log(y) if multiplicative else y
    n = len(y)
    t = np.arange(n + steps, dtype=float)
    bends = np.linspace(0, 0.8 * n, knots + 1)[1:]
    x = [np.ones_like(t), t / n] + [np.maximum(0, t - b) / n for b in bends]
    x += [f(2 * np.pi * k * t / sp) for k in range(1, min(waves, int(sp // 2)) + 1) for f in (np.sin, np.cos)]
    if extra is not None:
        x.append(extra[:n + steps].astype(float))
    x = np.column_stack(x)
    ridge = np.full(x.shape[1], 1e-6 * n)
    ridge[2:2 + knots] = 0.05 * n
    past = x[:n]
    beta = np.linalg.solve(past.T @ past + np.diag(ridge), past.T @ target)
    ahead = x[n:] @ beta
    return "trend+season", np.exp(ahead) if multiplicative else ahead


def trend_season_regression(df, ts, value, period, key=None, steps=14, sp=12, season: str = "additive", waves: int = 3, knots: int = 8) -> DataFrame:
    """Linear growth with bends and an additive or multiplicative season; the latter needs positive values.

    Ridge least squares on a piecewise linear trend and Fourier terms, from sums of products: rows meet only in one
    aggregate per series, combined inside each task, and what is solved is one small system per series.  Places are
    those of the calendar, so gaps carry no weight.
    """
    keys = [key] if key else ["_all"]
    multiplicative = season != "additive"
    rows = df.where(F.col(value).isNotNull()).select(
        *([key] if key else [F.lit(0).alias("_all")]), bin_index(F.col(ts), period).alias("_i"), F.col(value).cast("double").alias("_v"))
    spans = rows.groupBy(*keys).agg(F.min("_i").alias("_first"), (F.max("_i") - F.min("_i") + 1).alias("_n"), F.min("_v").alias("_low"),
                                    F.count(F.lit(1)).alias("_seen"))
    spans = spans.where((F.col("_seen") >= 4) & ((F.col("_low") > 0) if multiplicative else F.lit(True))).drop("_low", "_seen")

    def design(t, n):
        terms = [F.lit(1.0), t / n] + [F.greatest(F.lit(0.0), t - n * (0.8 * k / knots)) / n for k in range(1, knots + 1)]
        return terms + [f(t * (2 * math.pi * k / sp)) for k in range(1, min(waves, int(sp // 2)) + 1) for f in (F.sin, F.cos)]

    size = len(design(F.lit(0), F.lit(1)))
    names = [f"_x{i}" for i in range(size)]
    placed = lookup_join(rows, spans, keys, "inner").withColumn("_y", F.ln("_v") if multiplicative else F.col("_v"))
    placed = placed.withColumns(dict(zip(names, design(F.col("_i") - F.col("_first"), F.col("_n")))))
    pairs = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(size) for j in range(i, size)]
    sums = placed.groupBy(*keys, "_first", "_n").agg(F.array(*pairs).alias("_xx"), F.array(*[F.sum(F.col(x) * F.col("_y")) for x in names]).alias("_xy"))

    @F.pandas_udf("array<double>")
    def solved(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
        upper = np.triu_indices(size)
        out = []
        for products, moments, length in zip(xx, xy, n):
            ridge = np.full(size, 1e-6 * length)
            ridge[2:2 + knots] = 0.05 * length
            whole = np.zeros((size, size))
            whole[upper] = products
            whole = whole + np.triu(whole, 1).T + np.diag(ridge)
            out.append(np.linalg.solve(whole, moments).tolist())
        return pd.Series(out)

    ahead = sums.select(*keys, "_first", "_n", solved("_xx", "_xy", "_n").alias("_b"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    along = sum((x * F.get("_b", F.lit(i)) for i, x in enumerate(design(F.col("_n") - 1 + F.col("step"), F.col("_n")))), F.lit(0.0))
    return ahead.select(*([key] if key else []), "step", bin_start(F.col("_first") + F.col("_n") - 1 + F.col("step"), period).alias(ts),
                        F.lit("trend+season").alias("model"), (F.exp(along) if multiplicative else along).alias("forecast"))


# --- comparison --------------------------------------------------------------------------------------

METHODS: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {
    "naive": lambda y, h, sp: np.repeat(y[-1], h),
    "seasonal naive": lambda y, h, sp: np.array([y[-sp + i % sp] for i in range(h)]),
    "ses": lambda y, h, sp: smooth_fit(y, None, None, 1, False, h)[2],
    "holt": lambda y, h, sp: smooth_fit(y, "add", None, 1, True, h)[2],
    "holt-winters": lambda y, h, sp: smooth_fit(y, None, "add", sp, False, h)[2],
    "autoregression": lambda y, h, sp: best_autoregression(y, h, sp)[1],
    "regression": lambda y, h, sp: seasonal_regression(y, h, sp)[1],
}


def compare_forecasts(df: DataFrame, ts: str, value: str, period: str, key: str | None = None, sp: int = 12,
                      folds: int = 5, horizon: int = 6) -> DataFrame:
    """Rolling-origin mean absolute error per series and method; (series, method) pairs are separate tasks."""
    keys = [key] if key else []
    names = F.array(*[F.lit(n) for n in METHODS])
    rows = df.select(*keys, ts, F.col(value).cast("double").alias("_v"), F.explode(names).alias("method"))
    by = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys], F.col("method"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_v"]).sort_values(ts)
        out = {k: [pdf[k].iloc[0]] for k in keys} if len(pdf) else {k: [None] for k in keys}
        y, method, errors = pdf["_v"].to_numpy(dtype=float), pdf["method"].iloc[0] if len(pdf) else "", []
        for fold in range(folds, 0, -1):
            cut = len(y) - fold * horizon
            if cut >= max(2 * sp + 1, 8):
                errors.append(np.abs(METHODS[method](y[:cut], horizon, sp) - y[cut:cut + horizon]).mean())
        return pd.DataFrame({**out, "method": [method], "folds": [len(errors)],
                             "mae": [float(np.mean(errors)) if errors else np.nan]})
    return per_series(rows.withColumn("_by", by), "_by", score,
                      _schema(df, keys, "method string, folds int, mae double"))


def best_forecast(df: DataFrame, ts: str, value: str, period: str, key: str | None = None, sp: int = 12,
                  folds: int = 5, horizon: int = 6, steps: int = 24) -> DataFrame:
    """Forecast of each series by its method of the smallest rolling-origin error."""
    def method(y, h):
        scores = {}
        for name, run in METHODS.items():
            cuts = [len(y) - f * horizon for f in range(folds, 0, -1)]
            cuts = [c for c in cuts if c >= max(2 * sp + 1, 8)]
            if cuts:
                scores[name] = np.mean([np.abs(run(y[:c], horizon, sp) - y[c:c + horizon]).mean() for c in cuts])
        name = min(scores, key=scores.get) if scores else "naive"
        return name, METHODS[name](y, h, sp)
    return _forecast(df, ts, value, period, key, steps, method)
