"""Time-series queries: events by type (daily, hourly) and orders by priority (monthly)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import alerts, decompose, forecast, series, smooth, spectral
from plumbline.plans.profiles import NULLED, events_with_nulls
from plumbline.plans.registry import Tables, query


def spine_sql(name: str, table: str, ts: str, value: str, key: str, unit: str, agg: str) -> str:
    """Oracle form of a full-calendar resample: ``name(k, ts, v)``; sums and counts are 0 inside a series' own span."""
    held = "CASE WHEN b.v IS NULL AND s.ts BETWEEN lo AND hi THEN 0 ELSE b.v END" if agg.startswith(("sum", "count")) else "b.v"
    return f"""
{name}_b AS (SELECT {key} AS k, date_trunc('{unit}', {ts}) AS ts, {agg.format(value)} AS v FROM {table} GROUP BY 1, 2),
{name}_s AS (SELECT k, unnest(generate_series((SELECT min(ts) FROM {name}_b), (SELECT max(ts) FROM {name}_b),
  INTERVAL 1 {unit})) AS ts FROM (SELECT DISTINCT k FROM {name}_b)),
{name} AS (SELECT s.k, s.ts, {held} AS v FROM {name}_s s LEFT JOIN {name}_b b ON s.k = b.k AND s.ts = b.ts
  JOIN (SELECT k, min(ts) AS lo, max(ts) AS hi FROM {name}_b GROUP BY k) e ON s.k = e.k)"""


DAILY = "WITH " + spine_sql("d", "events", "ts", "value", "event_type", "day", "avg({})")
HOURLY = "WITH " + spine_sql("h", "events", "ts", "value", "event_type", "hour", "avg({})")
LOGGED = "WITH " + spine_sql("m", "orders", "o_orderdate", "o_totalprice", "o_orderpriority", "month", "avg(ln({}))")
MONTHLY = "WITH " + spine_sql("m", "orders", "o_orderdate", "o_totalprice", "o_orderpriority", "month", "sum({})")


def daily(t: Tables):
    df = t("events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("v"))
    return series.resample(df, "ts", ["v"], "k", "D", "mean")


def hourly(t: Tables):
    df = t("events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("v"))
    return series.resample(df, "ts", ["v"], "k", "h", "mean")


def monthly(t: Tables):
    df = t("orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    return series.resample(df, "ts", ["v"], "k", "MS", "sum")


def monthly_log(t: Tables):
    """Monthly mean of log prices: its averages have no rounding ties, so both engines round alike."""
    df = t("orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"),
                            F.ln("o_totalprice").alias("v"))
    return series.resample(df, "ts", ["v"], "k", "MS", "mean")


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- resampling ------------------------------------------------------------------------------------

@query("series_resample_day", "X1 J4", f"{DAILY} SELECT k, ts, round(v, 8) AS v FROM d")
def _(t):
    return rounded(daily(t), 8, "v")


@query("series_resample_hour_gaps", "X1 J4", f"{HOURLY} SELECT k, ts, round(v, 8) AS v FROM h")
def _(t):
    return rounded(hourly(t), 8, "v")


def unit_query(name: str, period: str, unit: str, label: str, agg: str, sql_agg: str):
    body = spine_sql("x", "orders", "o_orderdate", "o_totalprice", "o_orderpriority", unit, sql_agg)
    if unit == "quarter":
        body = body.replace("INTERVAL 1 quarter", "INTERVAL 3 month")
    value = "v" if agg == "count" else "round(v, 4)"

    @query(name, "X1", f"WITH {body} SELECT k, {label} AS ts, {value} AS v FROM x")
    def _(t):
        df = t("orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"),
                                F.col("o_totalprice").alias("v"))
        out = series.resample(df, "ts", ["v"], "k", period, agg)
        return out if agg == "count" else rounded(out, 4, "v")


unit_query("series_resample_week", "W", "week", "ts + INTERVAL 6 day", "max", "max({})")
unit_query("series_resample_month_median", "MS", "month", "ts", "median", "quantile_cont({}, 0.5)")
unit_query("series_resample_quarter", "QS", "quarter", "ts", "std", "stddev_samp({})")
unit_query("series_resample_year", "YS", "year", "ts", "count", "count({})")


@query("series_resample_minute_count", "X1", """
WITH b AS (SELECT date_trunc('minute', ts) AS ts, count(value) AS v FROM events GROUP BY 1),
     s AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 minute)) AS ts)
SELECT ts, coalesce(v, 0) AS v FROM s LEFT JOIN b USING (ts)""")
def _(t):
    return series.resample(t("events").select("ts", F.col("value").alias("v")), "ts", ["v"], None, "min", "count")


@query("series_resample_widened", "X2", """
WITH b AS (SELECT event_type AS k, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2024-01-01') AS ts, avg(value) AS v
           FROM events GROUP BY 1, 2),
     s AS (SELECT k, unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL '3 hours')) AS ts
           FROM (SELECT DISTINCT k FROM b))
SELECT k, ts, round(v, 8) AS v FROM s LEFT JOIN b USING (k, ts)""")
def _(t):
    df = t("events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("v"))
    return rounded(series.resample(df, "ts", ["v"], "k", "min", "mean", gap=1, interval=150), 8, "v")


def widened(name: str, minutes: int, step: str, label: str = "ts"):
    """Gaps that are whole hours, days and weeks."""
    @query(name, "X2", f"""
WITH b AS (SELECT event_type AS k, date_trunc('{step}', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2),
     s AS (SELECT k, unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 {step})) AS ts FROM (SELECT DISTINCT k FROM b))
SELECT k, {label} AS ts, round(v, 8) AS v FROM s LEFT JOIN b USING (k, ts)""")
    def _(t):
        df = t("events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("v"))
        return rounded(series.resample(df, "ts", ["v"], "k", "min", "mean", gap=minutes), 8, "v")


widened("series_widened_hour", 60, "hour")
widened("series_widened_day", 1440, "day")
widened("series_widened_week", 10_080, "week", "ts + INTERVAL 6 day")


@query("series_fill_previous", "X3", f"""{HOURLY}
SELECT k, ts, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS v FROM h""")
def _(t):
    return rounded(series.fill_series(hourly(t), "ts", "v", "prev", "k"), 8, "v")


@query("series_fill_median", "X3", f"""{HOURLY}
SELECT k, ts, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM h i WHERE i.k = h.k)), 8) AS v FROM h""")
def _(t):
    return rounded(series.fill_series(hourly(t), "ts", "v", "median", "k"), 8, "v")


@query("series_by_time", "X4", """
SELECT o_orderdate AS ts, o_orderpriority AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2""")
def _(t):
    df = t("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(series.by_time(df, "ts", ["v"], "k", "sum"), 2, "v")


@query("series_gap_flags", "X5", f"{HOURLY} SELECT k, bool_or(v IS NULL) AS has_gap FROM h GROUP BY k")
def _(t):
    return series.series_with_gaps(hourly(t), "k", "v")


@query("series_overview", "X6", """
SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS points, round(min(g), 5) AS min_gap, round(max(g), 5) AS max_gap
FROM (SELECT event_type, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6 AS g
      FROM (SELECT DISTINCT event_type, ts FROM events)) GROUP BY event_type""")
def _(t):
    return rounded(series.overview(t("events"), "ts", "event_type"), 5, "min_gap", "max_gap")


PART_SQL = {"quarter": "quarter({})", "month": "month({})", "weekday": "isodow({}) - 1", "hour": "hour({})", "day": "day({})"}


def seasonal_query(part: str):
    low, high = series.PARTS[part]
    name = PART_SQL[part]

    @query(f"series_seasonal_{part}", "X7 J3", f"""
WITH p AS (SELECT CAST({name.format('ts')} AS INTEGER) AS part, avg(value) AS value FROM events GROUP BY 1)
SELECT CAST(i AS INTEGER) AS part, round(value, 3) AS value FROM generate_series({low}, {high}) g(i) LEFT JOIN p ON part = i""")
    def _(t):
        return series.seasonal_table(t("events"), "ts", "value", part)


for _part in series.PARTS:
    seasonal_query(_part)


@query("series_compare_periods", "X8", """
SELECT strftime(o_orderdate, '%Y') AS "group", strftime(o_orderdate, '%m') AS period, round(avg(o_totalprice), 6) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def _(t):
    return rounded(series.compare(t("orders"), "o_orderdate", "o_totalprice", "Y", "m"), 6, "o_totalprice")


@query("series_compare_weekdays", "X8", """
SELECT 'Q' || quarter(o_orderdate) AS "group", dayname(o_orderdate) AS period, count(o_totalprice) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def _(t):
    return series.compare(t("orders"), "o_orderdate", "o_totalprice", "q", "w", "count")


@query("series_difference", "X9", f"""{MONTHLY}
SELECT k, ts, round(v - 2 * lag(v) OVER w + lag(v, 2) OVER w, 2) AS diff FROM m WINDOW w AS (PARTITION BY k ORDER BY ts)""")
def _(t):
    out = series.difference(monthly(t), "ts", "v", 1, 2, "k", "MS")
    return rounded(out.drop("v"), 2, "diff")


# --- smoothing ---------------------------------------------------------------------------------------

@query("series_moving_average", "X10", f"""{HOURLY}
SELECT k, ts, CASE WHEN count(v) OVER w >= 3 THEN round(avg(v) OVER w, 8) END AS sma FROM h
WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    return rounded(smooth.moving_average(hourly(t), "ts", "v", 5, "k", "h").drop("v"), 8, "sma")


@query("series_moving_average_span", "X10", """
SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
  RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), 8) AS sma FROM events""")
def _(t):
    df = t("events").select("event_id", "event_type", "ts", "value")
    return smooth.moving_average(df, "ts", "value", "6h", "event_type").select("event_id", F.round("sma", 8).alias("sma"))


@query("series_weighted_average", "X11", f"""{MONTHLY}
SELECT k, ts, round((3 * v + 2 * lag(v) OVER w + lag(v, 2) OVER w) / 6, 5) AS wma FROM m WINDOW w AS (PARTITION BY k ORDER BY ts)""")
def _(t):
    return rounded(smooth.weighted_average(monthly(t), "ts", "v", 3, "k", "MS").drop("v"), 5, "wma")


EWM = """, p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM {t})
SELECT a.k, a.ts, round(sum(b.v * pow({d}, a.i - b.i)) / sum(CASE WHEN b.v IS NOT NULL THEN pow({d}, a.i - b.i) END), 8) AS {n}
FROM p a JOIN p b ON a.k = b.k AND b.i <= a.i GROUP BY a.k, a.ts"""


@query("series_exponential_average", "X12", DAILY + EWM.format(t="d", d="(1 - 2 / 8.0)", n="ema"))
def _(t):
    return rounded(smooth.exponential_average(daily(t), "ts", "v", "k", span=7, period="D").drop("v"), 8, "ema")


@query("series_exponential_average_gaps", "X12", HOURLY + EWM.format(t="h", d="(1 - 2 / 13.0)", n="ema"))
def _(t):
    return rounded(smooth.exponential_average(hourly(t), "ts", "v", "k", span=12, period="h").drop("v"), 8, "ema")


@query("series_distribution", "X13", """
SELECT strftime(ts, '%d') AS period, event_type, count(value) AS count, round(avg(value), 8) AS mean,
  round(stddev_samp(value), 8) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 8) AS pct25,
  round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75), 8) AS pct75, max(value) AS max
FROM events GROUP BY 1, 2""")
def _(t):
    out = series.distribution(t("events"), "ts", "value", "d", "event_type")
    return rounded(out, 8, "mean", "std", "pct25", "median", "pct75")


# --- trends --------------------------------------------------------------------------------------------

@query("series_linear_trend", "X14", f"""{DAILY}, x AS (SELECT k, v, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM d)) / 60000000.0 AS x FROM d),
f AS (SELECT k, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, count(v) AS n, regr_sxx(v, x) AS sxx,
        regr_syy(v, x) - regr_sxy(v, x) * regr_slope(v, x) AS sse FROM x GROUP BY k),
s AS (SELECT sum(sse) / (sum(n) - 2 * count(*)) AS s2 FROM f), r AS (SELECT slope AS b0, sxx AS s0, k AS k0 FROM f ORDER BY k LIMIT 1)
SELECT k, round(slope, 9) AS slope, round(intercept, 6) AS intercept, n,
       CASE WHEN k <> k0 THEN round((slope - b0) / sqrt(s2 * (1 / sxx + 1 / s0)), 6) END AS t FROM f, s, r""")
def _(t):
    out = smooth.linear_trend(daily(t), "ts", "v", "k")
    return out.select("k", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), "n",
                      F.round("t", 6).alias("t"))


@query("series_trend_levels", "X14")
def _(t):
    return smooth.linear_trend(daily(t), "ts", "v", "k")


@query("series_lowess_trend", "X15")
def _(t):
    return smooth.lowess_trend(daily(t), "ts", "v", 0.5, "k")


@query("series_rolling_trend", "X16", f"""{LOGGED}, n AS (SELECT max(c) AS n FROM (SELECT k, count(*) AS c FROM m GROUP BY k)),
p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM m)
SELECT a.k, a.ts, round(avg(b.v), 8) AS trend FROM p a JOIN p b ON a.k = b.k AND b.i <= a.i
  AND b.i > a.i - (SELECT floor(n * 0.25) FROM n) GROUP BY a.k, a.ts""")
def _(t):
    return rounded(smooth.rolling_trend(monthly_log(t), "ts", "v", 0.25, "k").drop("v"), 8, "trend")


@query("series_half_life_trend", "X17", DAILY + EWM.format(t="d", d="pow(0.5, 1 / 20.0)", n="trend"))
def _(t):
    return rounded(smooth.half_life_trend(daily(t), "ts", "v", 30, 0.667, "k", "D").drop("v"), 8, "trend")


@query("series_polynomial_trend", "X18", f"""{DAILY}, p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 - (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS x FROM d),
m AS (SELECT k, avg(v) AS a, avg(x * x) AS m2, sum(x * v) / sum(x * x) AS b FROM p GROUP BY k),
q AS (SELECT p.k, sum((x * x - m2) * v) / sum((x * x - m2) * (x * x - m2)) AS c FROM p JOIN m ON p.k = m.k GROUP BY p.k)
SELECT p.k, ts, round(a + b * x + c * (x * x - m2), 6) AS trend FROM p JOIN m ON p.k = m.k JOIN q ON p.k = q.k""")
def _(t):
    return rounded(smooth.polynomial_trend(daily(t), "ts", "v", 0.4, "k").drop("v"), 6, "trend")


# --- correlation and spectra -----------------------------------------------------------------------------

@query("series_autocorrelation", "X19", f"""{DAILY}, p AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS e,
  row_number() OVER (PARTITION BY k ORDER BY ts) AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
c AS (SELECT a.k, b.i - a.i AS lag, sum(a.e * b.e) AS c, max(a.n) AS n FROM p a JOIN p b ON a.k = b.k AND b.i - a.i BETWEEN 0 AND 10 GROUP BY 1, 2),
r AS (SELECT k, lag, n, c / first_value(c) OVER (PARTITION BY k ORDER BY lag) AS r FROM c)
SELECT k, CAST(lag AS INTEGER) AS lag, round(r, 8) AS acf, round(CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(
  sum(CASE WHEN lag > 0 THEN r * r END) OVER (PARTITION BY k ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 8) AS bound FROM r""")
def _(t):
    return rounded(spectral.autocorrelation(daily(t), "ts", "v", 10, "k", "D"), 8, "acf", "bound")


@query("series_partial_autocorrelation", "X20", f"""{DAILY}, p AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS e,
  row_number() OVER (PARTITION BY k ORDER BY ts) AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
c AS (SELECT a.k, max(a.n) AS n, sum(a.e * b.e) FILTER (WHERE b.i = a.i) / max(a.n) AS c0, sum(a.e * b.e) FILTER (WHERE b.i = a.i + 1) / (max(a.n) - 1) AS c1,
  sum(a.e * b.e) FILTER (WHERE b.i = a.i + 2) / (max(a.n) - 2) AS c2 FROM p a JOIN p b ON a.k = b.k AND b.i BETWEEN a.i AND a.i + 2 GROUP BY a.k),
r AS (SELECT k, n, [1.0, c1 / c0, (c2 / c0 - (c1 / c0) * (c1 / c0)) / (1 - (c1 / c0) * (c1 / c0))] AS r FROM c)
SELECT k, CAST(g.i AS INTEGER) AS lag, round(r[g.i + 1], 8) AS pacf, round(1.959963984540054 / sqrt(n), 8) AS bound FROM r, generate_series(0, 2) g(i)""")
def _(t):
    return rounded(spectral.partial_autocorrelation(daily(t), "ts", "v", 2, "k", "D"), 8, "pacf", "bound")


@query("series_stationarity", "X21")
def _(t):
    return spectral.stationarity(monthly(t), "ts", "v", "k")


@query("series_cycles", "X22 Y3", f"""{DAILY}, p AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS e,
  row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
w AS (SELECT k, f, n, sum(e * cos(2 * pi() * f * i / n)) AS a, sum(e * sin(2 * pi() * f * i / n)) AS b
      FROM p, generate_series(0, 15) g(f) WHERE f <= n // 2 GROUP BY 1, 2, 3),
q AS (SELECT k, round(f / n, 4) AS freq, round((a * a + b * b) / n * CASE WHEN f = 0 OR 2 * f = n THEN 1 ELSE 2 END, 4) AS power FROM w),
o AS (SELECT k, freq, power, CAST(row_number() OVER (PARTITION BY k ORDER BY power DESC, freq) AS INTEGER) AS rank FROM q)
SELECT k, rank, freq, power, round(1 / freq, 1) AS cycle FROM o WHERE rank <= 5 AND power > 0""")
def _(t):
    return spectral.top_cycles(daily(t), "ts", "v", "k")


@query("series_low_pass", "X48", f"""{DAILY}, p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
w AS (SELECT k, f, n, sum(v * cos(2 * pi() * f * i / n)) AS a, sum(v * sin(2 * pi() * f * i / n)) AS b
      FROM p, generate_series(0, 15) g(f) WHERE f * 1.0 / n <= 0.2 GROUP BY 1, 2, 3)
SELECT p.k, ts, round(sum((a * cos(2 * pi() * f * i / p.n) + b * sin(2 * pi() * f * i / p.n)) / p.n * CASE WHEN f = 0 OR 2 * f = p.n THEN 1 ELSE 2 END), 7) AS clean
FROM p JOIN w ON p.k = w.k GROUP BY p.k, ts""")
def _(t):
    return rounded(spectral.low_pass(daily(t), "ts", "v", 0.2, "k").drop("v"), 7, "clean")


# --- decomposition -----------------------------------------------------------------------------------------

@query("series_trend_direction", "X23", f"""{MONTHLY}, p AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM m),
f AS (SELECT k, regr_slope(v, i) AS slope, stddev_pop(v) * 0.03 AS lim FROM p GROUP BY k)
SELECT k, round(slope, 3) AS slope, CASE WHEN slope > lim THEN 'increasing trend' WHEN slope < -lim THEN 'decreasing trend'
  ELSE 'no significant trend' END AS trending FROM f""")
def _(t):
    return rounded(decompose.trend_direction(monthly(t), "ts", "v", "k"), 3, "slope")


DECOMP = """, p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i FROM m),
t AS (SELECT k, ts, v, i, CASE WHEN count(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
  (sum(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + lag(v, 6) OVER (PARTITION BY k ORDER BY i) / 2
   + lead(v, 6) OVER (PARTITION BY k ORDER BY i) / 2) / 12 END AS trend FROM p),
{n}s AS (SELECT k, i % 12 AS ph, avg(v {op} trend) AS a FROM t GROUP BY 1, 2),
{n}c AS (SELECT k, ph, a {op} avg(a) OVER (PARTITION BY k) AS seasonal FROM {n}s),
{n}r AS (SELECT t.k, ts, v, trend, seasonal, {resid} AS resid FROM t JOIN {n}c c ON t.k = c.k AND i % 12 = ph)"""
ADD = DECOMP.format(n="q", op="-", resid="v - trend - seasonal")
MULTI = DECOMP.format(n="x", op="/", resid="v / (trend * seasonal)")


@query("series_decompose_additive", "X24", LOGGED + ADD + """
SELECT k, ts, round(v, 8) AS v, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(resid, 8) AS resid FROM qr""")
def _(t):
    out = decompose.decompose(monthly_log(t), "ts", "v", 12, "MS", "k")
    return rounded(out, 8, "v", "trend", "seasonal", "resid")


@query("series_decompose_multiplicative", "X25", LOGGED + MULTI + """
SELECT k, ts, round(v, 8) AS v, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(resid, 8) AS resid FROM xr""")
def _(t):
    out = decompose.decompose(monthly_log(t), "ts", "v", 12, "MS", "k", "multi")
    return rounded(out, 8, "v", "trend", "seasonal", "resid")


@query("series_choose_model", "X25", LOGGED + ADD + ",\n" + MULTI[MULTI.index("xs AS"):] + """,
e AS (SELECT k, stddev_pop(resid) AS s, avg(resid * resid) AS q FROM qr GROUP BY k),
g AS (SELECT k, stddev_pop(resid) AS s, avg(resid * resid) AS q FROM xr GROUP BY k)
SELECT k, round(e.s, 8) AS add_std, round(e.q, 8) AS add_mse, round(g.s, 8) AS multi_std, round(g.q, 8) AS multi_mse,
  CASE WHEN g.s < e.s AND g.q < e.q THEN 'multiplicative' ELSE 'additive' END AS model FROM e JOIN g USING (k)""")
def _(t):
    out = decompose.choose_model(monthly_log(t), "ts", "v", 12, "MS", "k")
    return rounded(out, 8, "add_std", "add_mse", "multi_std", "multi_mse")


@query("series_stl", "X26")
def _(t):
    return decompose.stl(monthly(t), "ts", "v", 12, "k", robust=True)


@query("series_season_search", "X27", MONTHLY + """, p AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY k) AS n FROM m),
j AS (SELECT a.k, sp, a.i, a.v, sum(b.v * CASE WHEN sp % 2 = 0 AND abs(a.i - b.i) = sp // 2 THEN 0.5 ELSE 1 END) / sp AS trend
  FROM p a, generate_series(2, 30) g(sp), p b WHERE a.k = b.k AND abs(a.i - b.i) <= sp // 2
  GROUP BY 1, 2, 3, 4 HAVING count(b.v) = 2 * (sp // 2) + 1),
s AS (SELECT k, sp, i % sp AS ph, avg(v - trend) AS a FROM j GROUP BY 1, 2, 3),
c AS (SELECT k, sp, ph, a - avg(a) OVER (PARTITION BY k, sp) AS s FROM s),
r AS (SELECT j.k, j.sp, stddev_pop(v - trend - s) AS sd FROM j JOIN c ON j.k = c.k AND j.sp = c.sp AND j.i % j.sp = ph GROUP BY 1, 2)
SELECT k, CAST(sp AS INTEGER) AS sp, round(sd, 2) AS resid_std, sd = min(sd) OVER (PARTITION BY k) AS best FROM r""")
def _(t):
    return rounded(decompose.season_search(monthly(t), "ts", "v", "MS", "k"), 2, "resid_std")


# --- forecasts -----------------------------------------------------------------------------------------------

@query("forecast_persistence", "X31", MONTHLY + """, p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS back FROM m WHERE v IS NOT NULL),
l AS (SELECT a.k, a.ts AS last, a.v - b.v AS delta FROM p a JOIN p b ON a.k = b.k AND a.back = 1 AND b.back = 13)
SELECT l.k, CAST(h AS INTEGER) AS step, last + to_months(CAST(h AS INTEGER)) AS ts,
  round(v + (1 + (h - 1) // 12) * delta, 2) AS forecast
FROM l, generate_series(1, 14) g(h) JOIN p ON p.k = l.k AND p.back = 12 - (h - 1) % 12""")
def _(t):
    return rounded(forecast.persistence(monthly(t), "ts", "v", "MS", d=1, season_d=1, key="k"), 2, "forecast")


@query("forecast_last_value", "X31", DAILY + """
SELECT k, CAST(h AS INTEGER) AS step, ts + to_days(CAST(h AS INTEGER)) AS ts, round(v, 8) AS forecast
FROM d, generate_series(1, 14) g(h) WHERE ts = (SELECT max(ts) FROM d)""")
def _(t):
    return rounded(forecast.persistence(daily(t), "ts", "v", "D", d=1, key="k"), 8, "forecast")


@query("forecast_simple_smoothing", "X28")
def _(t):
    return forecast.simple_smoothing(monthly(t), "ts", "v", "MS", "k")


@query("forecast_holt", "X29")
def _(t):
    return forecast.holt(monthly(t), "ts", "v", "MS", "k", damped=True)


@query("forecast_holt_winters", "X30")
def _(t):
    return forecast.holt_winters(monthly(t), "ts", "v", "MS", "k", season="add")


@query("forecast_auto_smoothing", "X32")
def _(t):
    return forecast.auto_smoothing(monthly(t), "ts", "v", "MS", "k")


@query("forecast_auto_regression", "X33")
def _(t):
    return forecast.auto_autoregression(monthly(t), "ts", "v", "MS", "k")


@query("forecast_trend_season", "X34")
def _(t):
    return forecast.trend_season_regression(monthly(t), "ts", "v", "MS", "k")


@query("forecast_compare", "L10")
def _(t):
    return forecast.compare_forecasts(monthly(t), "ts", "v", "MS", "k")


# --- anomalies -------------------------------------------------------------------------------------------------

@query("anomaly_quartile", "X35", f"""{HOURLY}, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM h GROUP BY k)
SELECT k, ts, round(a - 1.6 * (b - a), 8) AS lower, round(b + 1.6 * (b - a), 8) AS upper,
  CASE WHEN v < a - 1.6 * (b - a) THEN -1 WHEN v > b + 1.6 * (b - a) THEN 1 ELSE 0 END AS outlier FROM h JOIN q USING (k)""")
def _(t):
    return rounded(alerts.quartile_alerts(hourly(t), "v", "k").drop("v"), 8, "lower", "upper")


@query("anomaly_zscore", "X36", f"""{DAILY}, q AS (SELECT k, round(avg(v) - 2 * stddev_samp(v), 3) AS lower,
  round(avg(v) + 2 * stddev_samp(v), 3) AS upper FROM d GROUP BY k)
SELECT k, ts, round(v, 8) AS v, lower, upper, CASE WHEN v < lower THEN -1 WHEN v > upper THEN 1 ELSE 0 END AS outlier FROM d JOIN q USING (k)""")
def _(t):
    return rounded(alerts.sigma_alerts(daily(t), "v", "k", 2), 8, "v")


@query("anomaly_zscore_whole", "X36", f"""{DAILY}, q AS (SELECT round(avg(v) - 2 * stddev_samp(v), 3) AS lower,
  round(avg(v) + 2 * stddev_samp(v), 3) AS upper FROM d)
SELECT k, ts, lower, upper, CASE WHEN v < lower THEN -1 WHEN v > upper THEN 1 ELSE 0 END AS outlier FROM d, q""")
def _(t):
    return alerts.sigma_alerts(daily(t), "v", "k", 2, whole=True).drop("v")


@query("anomaly_gaps", "X37", f"""{HOURLY}
SELECT k, ts, CAST(v IS NULL AS INTEGER) AS outlier FROM h WHERE k IN (SELECT k FROM h WHERE v IS NULL)""")
def _(t):
    return alerts.gap_alerts(hourly(t), "v", "k").drop("v")


@query("anomaly_jump", "X38", f"""{DAILY}, q AS (SELECT k, 2 * stddev_samp(v) AS lim FROM d GROUP BY k),
p AS (SELECT k, ts, v, v - lag(v) OVER (PARTITION BY k ORDER BY ts) AS step FROM d)
SELECT k, ts, round(v - lim, 3) AS lower, round(v + lim, 3) AS upper,
  CASE WHEN step > lim THEN 1 WHEN step < -lim THEN -1 ELSE 0 END AS outlier FROM p JOIN q USING (k)""")
def _(t):
    return alerts.jump_alerts(daily(t), "ts", "v", "k", period="D").drop("v")


@query("anomaly_rolling", "X39", f"""{DAILY}, p AS (SELECT k, ts, v, CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END AS mean FROM d
  WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
f AS (SELECT k, ts, v, coalesce(last_value(mean IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(mean IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mean FROM p),
q AS (SELECT k, 2 * stddev_samp(mean) AS lim FROM f GROUP BY k),
b AS (SELECT k, ts, v, round(mean - lim, 3) AS lower, round(mean + lim, 3) AS upper FROM f JOIN q USING (k))
SELECT k, ts, lower, upper, CASE WHEN v < lower THEN -1 WHEN v > upper THEN 1 ELSE 0 END AS outlier FROM b""")
def _(t):
    return alerts.rolling_alerts(daily(t), "ts", "v", "k", period="D").drop("v")


@query("anomaly_totals", "A10", f"""{HOURLY}, q AS (SELECT k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM h GROUP BY k),
o AS (SELECT ts, CASE WHEN v < a - 0.2 * (b - a) THEN -1 WHEN v > b + 0.2 * (b - a) THEN 1 ELSE 0 END AS s FROM h JOIN q USING (k))
SELECT ts, s AS sign, CAST(sum(s) AS BIGINT) AS alerts FROM o WHERE s <> 0 GROUP BY 1, 2""")
def _(t):
    return alerts.alert_totals(alerts.quartile_alerts(hourly(t), "v", "k", 0.2), "ts")


@query("anomaly_change_points", "X43")
def _(t):
    return alerts.change_points(monthly(t), "ts", "v", "k")


@query("anomaly_reshape_segments", "X44", f"""{DAILY}, p AS (SELECT k, ts, v / 100 AS v, row_number() OVER (PARTITION BY k ORDER BY ts) AS i,
  count(*) OVER (PARTITION BY k) AS n, CAST(isodow(ts) = 1 AND ts > TIMESTAMP '2024-01-01' AS INTEGER) AS cut FROM d),
s AS (SELECT *, sum(cut) OVER (PARTITION BY k ORDER BY i) AS segment, sum(cut) OVER (PARTITION BY k) AS cuts FROM p),
e AS (SELECT *, min(i) OVER (PARTITION BY k, segment) AS a, max(i) OVER (PARTITION BY k, segment) AS b FROM s),
g AS (SELECT *, (segment > 0 AND i < a + 2) OR (segment < cuts AND i > b - 2) AS edge FROM e),
m AS (SELECT k, segment, avg(v) AS mean, stddev_samp(v) AS sd FROM g WHERE NOT edge GROUP BY 1, 2)
SELECT k, ts, CAST(segment AS BIGINT) AS segment, round(CASE WHEN NOT edge AND sd < 1 AND abs(v - mean) < greatest(3 * sd, abs(mean) * 0.1)
  THEN mean ELSE v END, 6) AS reshaped FROM g LEFT JOIN m USING (k, segment)""")
def _(t):
    df = daily(t).withColumn("v", F.col("v") / 100)
    change = (F.weekday("ts") == 0) & (F.col("ts") > F.lit("2024-01-01").cast("timestamp_ntz"))
    return rounded(alerts.reshape_segments(df, "ts", "v", change, "k").drop("v"), 6, "reshaped")
