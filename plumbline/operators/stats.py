"""Distributions, variance analysis and correlations."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import (average_ranks, column_quantiles, describe, lookup_join, running)
from plumbline.functions.settings import cut_lineage
from plumbline.functions.tails import f_tail, f_upper
from plumbline.operators import level_fit
from plumbline.spec import DatasetSpec


# --- quality ---------------------------------------------------------------------------------------

def null_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in columns])


def quality_overview(df: DataFrame) -> DataFrame:
    """Rows that are valid, have a missing cell, or repeat an earlier row (valid = total - both)."""
    counts = df.withColumn("_miss", (null_count(df.columns) > 0).cast("long")).groupBy(*df.columns, "_miss").agg(
        F.count(F.lit(1)).alias("_n"))
    sums = counts.agg(F.sum("_n").alias("total"), F.sum(F.col("_miss") * F.col("_n")).alias("missing"),
                      F.sum(F.col("_n") - 1).alias("duplicate"))
    cells = F.array(F.struct(F.lit("Valid").alias("name"), (F.col("total") - F.col("missing") - F.col("duplicate")).alias("rows")),
                    F.struct(F.lit("Missing").alias("name"), F.col("missing").alias("rows")),
                    F.struct(F.lit("Duplicate").alias("name"), F.col("duplicate").alias("rows")))
    return sums.select(F.inline(cells))


def role_table(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """``role_counts`` as rows."""
    return df.sparkSession.createDataFrame(list(role_counts(df, spec).items()), "name string, fields int")


def role_counts(df: DataFrame, spec: DatasetSpec) -> dict[str, int]:
    """Fields per role, and configured fields the table lacks."""
    names = {"Continuous": "conti", "Discrete": "disc", "Category": "cat", "Datetime": "date", "Coordinate": "coord"}
    return {n: len(spec.names(df, r)) for n, r in names.items()} | {"Invalid": len(spec.invalid(df))}


def missing_histogram(df: DataFrame) -> DataFrame:
    """Rows by their number of missing cells (at least one)."""
    counted = df.select(null_count(df.columns).alias("missing")).where(F.col("missing") > 0)
    return counted.groupBy("missing").agg(F.count(F.lit(1)).alias("rows"))


def missing_and_outliers(df: DataFrame, numeric: Sequence[str], coefficient: float = 1.6) -> DataFrame:
    """Missing cells of every column and quartile outliers of the numeric ones (null for others and for none)."""
    fences = {}
    for c, (low, high) in column_quantiles(df, numeric, [0.25, 0.75]).items():
        if low is not None:
            fences[c] = (low - (high - low) * coefficient, high + (high - low) * coefficient)

    def outer(c: str) -> Column:
        if c not in fences:
            return F.lit(None).cast("long")
        low, high = fences[c]
        return F.nullif(F.count_if((F.col(c) < low) | (F.col(c) > high)), F.lit(0))
    parts = [F.struct(F.lit(c).alias("name"), F.count_if(F.col(c).isNull()).alias("miss"), outer(c).alias("outer"))
             for c in df.columns]
    return df.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


# --- distributions -----------------------------------------------------------------------------------

def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def box_statistics(df: DataFrame, columns: Sequence[str], category: str | None = None, coefficient: float = 1.5) -> DataFrame:
    """Mean, spread, quartiles, fences and outlier counts per column (and category)."""
    keys = [category] if category else []
    stats = describe(df, keys, columns, [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    # one row per column and category, read twice below
    box = cut_lineage(stats.select(*keys, "name", "count", "mean", "std", "min", F.col("q")[0].alias("pct25"), F.col("q")[1].alias("median"),
                       F.col("q")[2].alias("pct75"), "max", (F.col("q")[0] - iqr * coefficient).alias("lower"),
                       (F.col("q")[2] + iqr * coefficient).alias("upper")))
    outside = box_outliers(df, box, columns, category).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("outliers"))
    return lookup_join(box, outside, [*keys, "name"]).withColumn("outliers", F.coalesce("outliers", F.lit(0).cast("long"))).orderBy("mean")


def box_outliers(df: DataFrame, box: DataFrame, columns: Sequence[str], category: str | None = None) -> DataFrame:
    """The values outside the fences."""
    keys = [category] if category else []
    rows = lookup_join(long_values(df, columns, keys), box.select(*keys, "name", "lower", "upper"), [*keys, "name"], "inner")
    return rows.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).select(*keys, "name", "value")


def variance_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("name"), F.var_samp(c).alias("variance")) for c in columns]
    return df.agg(F.array(*parts).alias("_a")).select(F.inline("_a")).orderBy(F.col("variance").desc())


def density(df: DataFrame, value: str, keys: Sequence[str] = (), points: int = 100, ends: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian kernel density with Scott bandwidth on an even grid over the whole range, per key.

    Distinct values are counted first, and kernel sums combine inside each task, so the shuffle carries only
    (key, grid point) sums.
    """
    by = list(keys) or ["_all"]
    rows = (df if keys else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull())
    if ends is None:
        row = rows.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
        ends = (row[0], row[1])
    if ends[0] is None:
        return df.select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    step = (ends[1] - ends[0]) / (points - 1)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), (F.stddev_samp(value) * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("_h"))
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    joined = lookup_join(counts, sizes.where(F.col("_h") > 0), by, "inner")
    spread = joined.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_g"))
    z = (F.lit(ends[0]) + F.col("_g") * step - F.col("_v")) / F.col("_h")
    height = F.sum(F.col("_n") * F.exp(-z * z / 2) / (F.col("_size") * F.col("_h") * math.sqrt(2 * math.pi)))
    out = spread.groupBy(*by, "_g").agg(height.alias("density"))
    return out.select(*keys, (F.lit(ends[0]) + F.col("_g") * step).alias("x"), "density")


def ridge(df: DataFrame, columns: Sequence[str], points: int = 100) -> DataFrame:
    """One density per column on a common grid, with the column means to order by."""
    means = df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean")) for c in columns]).alias("_a")).select(F.inline("_a"))
    return lookup_join(density(long_values(df, columns), "value", ["name"], points), means, ["name"])


def violin(df: DataFrame, columns: Sequence[str], category: str | None = None, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """Box statistics and a density per column (and category)."""
    keys = [category] if category else []
    return box_statistics(df, columns, category), density(long_values(df, columns, keys), "value", [*keys, "name"], points)


def reference_densities(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """Normal, lognormal, exponential and Laplace densities with the sample mean and spread, on the grid."""
    row = df.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.avg(value), F.stddev_samp(value)).first()
    low, high, mean, sd = row
    step = (high - low) / (points - 1)
    x = F.lit(low) + F.col("id") * step
    z = (x - mean) / sd
    root = math.sqrt(2 * math.pi)
    log_sd = F.lit(sd)
    grid = df.sparkSession.range(points).select(
        x.alias("x"), (F.exp(-z * z / 2) / (sd * root)).alias("normal"),
        F.when(x - mean > 0, F.exp(-F.pow(F.ln(x - mean) / log_sd, F.lit(2)) / 2) / ((x - mean) * log_sd * root)).otherwise(0.0).alias("lognormal"),
        F.when(x >= mean, F.exp(-z) / sd).otherwise(0.0).alias("exponential"),
        (F.exp(-F.abs(z)) / (2 * sd)).alias("laplace"))
    return grid


def histogram(df: DataFrame, value: str, bins: int = 30, category: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range: bin number, left edge and rows, per category."""
    keys = [category] if category else []
    rows = df.where(F.col(value).isNotNull())
    low, high = rows.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        return rows.select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("left"), F.lit(0).cast("long").alias("rows")).limit(0)
    width = (high - low) / bins or 1.0
    bin_ = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(*keys, "bin", (F.lit(low) + F.col("bin") * width).alias("left"), "rows")


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    row = df.agg(*[f(c).cast("double") for c in (x, y) for f in (F.min, F.max)]).first()
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(cell(x, row[0], row[1]).alias("x_bin"), cell(y, row[2], row[3]).alias("y_bin")).agg(F.count(F.lit(1)).alias("rows"))


# --- variance analysis -------------------------------------------------------------------------------

def anova_groups(df: DataFrame, columns: Sequence[str], category: str, order: str | None = None) -> DataFrame:
    """Mean and standard deviation per column and category."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
             for c in columns]
    out = df.groupBy(category).agg(F.array(*parts).alias("_a")).select(category, F.inline("_a"))
    return out.orderBy(F.col(order).desc()) if order else out


def anova_f(df: DataFrame, columns: Sequence[str], category: str) -> DataFrame:
    """One-way F per column from one grouped pass of moments: F = (SSB / (k - 1)) / (SSW / (n - k))."""
    parts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("m"),
                      (F.var_pop(c) * F.count(c)).alias("w")) for c in columns]
    cells = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.array(*parts).alias("_a")).select(F.inline("_a")).where("n > 0")
    sums = cells.groupBy("name").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"))
    ssb = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    f = F.try_divide(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return sums.select("name", "k", "n", ssb.alias("ssb"), "ssw", f.alias("f"))


def significance(p: Column) -> Column:
    """Fixed levels: below 1 % high, 5 % medium, 10 % low, otherwise no."""
    return F.when(p < 0.01, "high").when(p < 0.05, "medium").when(p < 0.1, "low").otherwise("no")


def anova(df: DataFrame, columns: Sequence[str], category: str) -> DataFrame:
    out = anova_f(df, columns, category)
    out = out.withColumn("p", f_tail(F.col("f"), F.col("k") - F.lit(1.0), F.col("n") - F.col("k").cast("double")))
    return out.withColumn("level", significance(F.col("p")))


MOST_LEVELS = 1000    # levels whose normal matrix the driver solves; more are fitted by rounds on Spark
FACTOR_SUMS = ("name string, df double, sum_sq double, f double, p double, neg_log10 double, "
               "omega_sq double, eta_sq double, eta_sq_factors double")


def factor_anova(df: DataFrame, value: str, factors: Sequence[str]) -> DataFrame:
    """Sequential sums of squares of ``value ~ factor1 + factor2 + ...`` with F, p, -log10 p and both effect sizes.

    Rows with a null value or factor are left out.  Up to about ``MOST_LEVELS`` levels the sums of levels and of pairs of
    levels are solved on the driver; beyond, the fit stays on Spark (``level_fit``).  Rows never reach the driver.
    Without rows there is no result row.
    """
    rows = df.where(F.col(value).isNotNull()).dropna(subset=list(factors))
    centre, spread, n, *levels = rows.agg(F.avg(value), F.var_pop(value), F.count(F.lit(1)), *[F.approx_count_distinct(c) for c in factors]).first()
    if not n:
        return df.sparkSession.createDataFrame([], f"{FACTOR_SUMS}, level string")
    y, total = F.col(value) - centre, spread * n
    found = level_fit.sequential_sums(rows, y, factors) if sum(levels) > MOST_LEVELS else _matrix_sums(rows, y, factors, n, total)
    rest, free = total - sum(s for *_, s in found), n - 1 - sum(d for _, d, _ in found)
    error = rest / free if free > 0 else math.nan
    explained = sum(s for *_, s in found)
    out = []
    for c, d, s in found:
        f = (s / d) / error if d and error else math.nan
        p = f_upper(f, d, free)
        out.append((c, float(d), float(s), float(f), float(p), -math.log10(max(p, 1e-308)),
                    float((s - d * error) / (total + rest)), float(s / (explained + rest)), float(s / explained) if explained else math.nan))
    return df.sparkSession.createDataFrame(out, FACTOR_SUMS).withColumn("level", significance(F.col("p")))


def _matrix_sums(rows: DataFrame, y: Column, factors: Sequence[str], n: int, total: float) -> list[tuple[str, int, float]]:
    """(factor, degrees of freedom, sum of squares) from the normal matrix of all levels."""
    text = {c: F.col(c).cast("string") for c in factors}
    ones = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), text[c].alias("v"), y.alias("y")) for i, c in enumerate(factors)])))
    single = ones.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()
    pair_rows = []
    if len(factors) > 1:
        pairs = [F.struct(F.lit(i).alias("f"), text[a].alias("v"), F.lit(j).alias("g"), text[b].alias("w"))
                 for (i, a), (j, b) in itertools.combinations(enumerate(factors), 2)]
        pair_rows = rows.select(F.inline(F.array(*pairs))).groupBy("f", "v", "g", "w").agg(F.count(F.lit(1)).alias("n")).collect()
    place, first = {}, {}
    for r in sorted(single, key=lambda r: (r["f"], r["v"])):
        if r["f"] in first:
            place[r["f"], r["v"]] = len(place) + 1
        else:
            first[r["f"]] = r["v"]                # reference level
    size = len(place) + 1
    xx, xy = np.zeros((size, size)), np.zeros(size)
    xx[0, 0] = n
    for r in single:
        if (at := place.get((r["f"], r["v"]))) is not None:
            xx[0, at] = xx[at, 0] = xx[at, at] = r["n"]
            xy[at] = r["s"]
    for r in pair_rows:
        a, b = place.get((r["f"], r["v"])), place.get((r["g"], r["w"]))
        if a is not None and b is not None:
            xx[a, b] = xx[b, a] = r["n"]
    used, rest, ranks, found = [0], total, 1, []
    for i, c in enumerate(factors):
        used += [at for (f, _), at in place.items() if f == i]
        sub = xx[np.ix_(used, used)]
        beta = np.linalg.lstsq(sub, xy[used], rcond=None)[0]
        left, rank = total - float(beta @ xy[used]), int(np.linalg.matrix_rank(sub))
        found.append((c, rank - ranks, rest - left))
        rest, ranks = left, rank
    return found


def effect_sizes(anova_rows: DataFrame) -> DataFrame:
    """omega² (with total + error in the denominator) and eta² of one-way results."""
    total = F.col("ssb") + F.col("ssw")
    mse = F.col("ssw") / (F.col("n") - F.col("k"))
    return anova_rows.withColumns({"omega_sq": (F.col("ssb") - (F.col("k") - 1) * mse) / (total + F.col("ssw")),
                                   "eta_sq": F.col("ssb") / total})


# --- correlation -----------------------------------------------------------------------------------

def pair_matrix(df: DataFrame, columns: Sequence[str], measure) -> DataFrame:
    """Lower triangle with diagonal of a pairwise measure, all in one aggregate."""
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), measure(F.col(a), F.col(b)).alias("value"))
             for i, a in enumerate(columns) for b in columns[:i + 1]]
    return df.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


def to_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column replaced by its tie-averaged rank."""
    out = df.select(*columns)
    for c in columns:
        ranks = average_ranks(df, c).select(c, F.col("rank").alias("_rank"))
        out = lookup_join(out, ranks, [c]).withColumn(c, F.col("_rank")).drop("_rank")
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson", digits: int = 2) -> DataFrame:
    if method == "kendall":
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i + 1]]
        parts = [kendall(df, a, b).select(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col("tau").alias("value")) for a, b in pairs]
        out = reduce(DataFrame.unionAll, parts)
    else:
        out = pair_matrix(to_ranks(df, columns) if method == "spearman" else df, columns, F.corr)
    return out.withColumn("value", F.round("value", digits))


def covariance_matrix(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return pair_matrix(df, columns, F.covar_samp).withColumn("value", F.round("value", digits))


def target_correlation(df: DataFrame, features: Sequence[str], target: str, method: str = "pearson", digits: int = 3) -> DataFrame:
    """Absolute correlation of every feature with the target, strongest first."""
    rows = to_ranks(df, [*features, target]) if method == "spearman" else df
    cells = [F.struct(F.lit(c).alias("name"), F.round(F.abs(F.corr(F.col(c), F.col(target))), digits).alias("value")) for c in features]
    return rows.agg(F.array(*cells).alias("_a")).select(F.inline("_a")).orderBy(F.col("value").desc())


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b without forming pairs of rows.

    Two rows that differ in y differ first at exactly one bit of y's dense rank.  Per bit level, rows sharing
    the higher bits are ordered by x, and running counts of one bit value before the other give the
    concordant and discordant pairs.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    places = running(rows.select("y").distinct(), [], "y", {"_code": F.lit(1)})
    size = places.count()
    levels = max(1, (max(size - 1, 1)).bit_length())
    coded = lookup_join(cells, places, ["y"]).withColumn("_code", F.col("_code") - 1)
    bits = coded.select("x", "n", "_code", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    high = F.floor(F.col("_code") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("long")
    bit = F.pmod(F.floor(F.col("_code") / F.pow(F.lit(2.0), F.col("level"))).cast("long"), F.lit(2))
    sums = bits.groupBy("level", high.alias("high"), "x").agg(
        F.sum(F.when(bit == 0, F.col("n")).otherwise(0.0)).alias("zero"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0.0)).alias("one"))
    upto = running(sums, ["level", "high"], "x", {"_z": F.col("zero"), "_o": F.col("one")})
    found = upto.agg(F.sum(F.col("one") * (F.col("_z") - F.col("zero"))).alias("c"), F.sum(F.col("zero") * (F.col("_o") - F.col("one"))).alias("d"))

    def ties(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("t"))
        return counts.agg(F.sum(F.col("t") * (F.col("t") - 1) / 2))
    n = rows.count()
    whole = n * (n - 1) / 2
    return found.select(F.try_divide(F.col("c") - F.col("d"), F.sqrt((F.lit(whole) - ties("x").scalar()) * (F.lit(whole) - ties("y").scalar()))).alias("tau"))


# --- row displays -----------------------------------------------------------------------------------

def scatter(df: DataFrame, x: str, y: str, category: str | None = None, facet: str | None = None,
            errors: Sequence[str] = ()) -> DataFrame:
    return df.select(*dict.fromkeys([x, y, *([category] if category else []), *([facet] if facet else []), *errors]))


def scatter_pairs(df: DataFrame, columns: Sequence[str], category: str | None = None) -> DataFrame:
    """(x_name, y_name, x, y) rows of all column pairs."""
    cells = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y")) for a, b in itertools.combinations(columns, 2)]
    return df.select(*([category] if category else []), F.inline(F.array(*cells)))


def marginals(df: DataFrame, columns: Sequence[str], bins: int = 10, category: str | None = None) -> DataFrame:
    """Histograms of the columns beside a scatter or on the diagonal of a pair matrix: name, bin, left edge, rows.

    One pass finds all ranges and one counts all columns, whose bins are the only rows shuffled.
    """
    keys = [category] if category else []
    row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
    cells = []
    for i, c in enumerate(columns):
        low = row[2 * i] if row[2 * i] is not None else 0.0
        width = ((row[2 * i + 1] or 0.0) - low) / bins or 1.0
        at = F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("name"), at.alias("bin"), (F.lit(low) + at * width).alias("left")))
    rows = df.select(*keys, F.inline(F.array(*cells))).where(F.col("bin").isNotNull())
    return rows.groupBy(*keys, "name", "bin", "left").agg(F.count(F.lit(1)).alias("rows"))


def parallel_coordinates(df: DataFrame, ident: str, columns: Sequence[str], category: str | None = None) -> DataFrame:
    """(id, axis, value scaled to 0..1, category) rows."""
    row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
    cells = [F.struct(F.lit(c).alias("axis"), ((F.col(c) - row[2 * i]) / ((row[2 * i + 1] - row[2 * i]) or 1.0)).alias("value"))
             for i, c in enumerate(columns)]
    return df.select(ident, *([category] if category else []), F.inline(F.array(*cells)))


def andrews_curves(df: DataFrame, ident: str, columns: Sequence[str], category: str | None = None, points: int = 100) -> DataFrame:
    """x1/sqrt(2) + x2 sin t + x3 cos t + x4 sin 2t + ... on an even grid of [-pi, pi] for every row."""
    t = F.lit(-math.pi) + F.col("point") * (2 * math.pi / (points - 1))
    terms = [F.col(columns[0]) / math.sqrt(2)]
    for i, c in enumerate(columns[1:]):
        angle = t * (i // 2 + 1)
        terms.append(F.col(c) * (F.sin(angle) if i % 2 == 0 else F.cos(angle)))
    keep = [ident, *([category] if category else [])]
    rows = df.select(*dict.fromkeys([*keep, *columns]), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return rows.select(*keep, "point", reduce(lambda a, b: a + b, terms).alias("value"))
