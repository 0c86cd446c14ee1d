"""Feature scores, selection and generation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.calendar import micros
from plumbline.functions.ordered import describe, hot_keys, lookup_join, over_series, running
from plumbline.functions.settings import cut_lineage, kept, spread, use_all_cores
from plumbline.functions.tails import chi_upper, f_upper
from plumbline.operators.stats import anova_f

# --- filter scores ------------------------------------------------------------------------------------


def f_scores(df: DataFrame, features: Sequence[str], target: str, classify: bool = True) -> DataFrame:
    """F per feature with its degrees of freedom: one-way variance analysis, or from r for a numeric target."""
    if classify:
        return anova_f(df, features, target).select("name", F.col("f").alias("value"), (F.col("k") - 1).cast("double").alias("d1"),
                                                    (F.col("n") - F.col("k")).cast("double").alias("d2"))
    cells = [F.struct(F.lit(c).alias("name"), F.corr(c, target).alias("r"), F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias("n"))
             for c in features]
    rows = df.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    square = F.col("r") * F.col("r")
    return rows.select("name", F.try_divide(square * (F.col("n") - 2), 1 - square).alias("value"), F.lit(1.0).alias("d1"),
                       (F.col("n") - 2).cast("double").alias("d2"))


def chi_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Chi-square of class sums of min-max scaled features against class shares."""
    row = df.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.min, F.max)]).first()
    scaled = [((F.col(c) - row[2 * i]) / ((row[2 * i + 1] - row[2 * i]) or 1.0)).alias(f"x{i}") for i, c in enumerate(features)]
    sums = df.where(F.col(target).isNotNull()).select(F.col(target).alias("t"), *scaled).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(c).alias("name"), F.sum(f"x{i}").alias("o")) for i, c in enumerate(features)]).alias("_a"))
    cells = sums.select("t", "n", F.inline("_a"))
    totals = cells.groupBy("name").agg(F.sum("o").alias("all"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    joined = cells.join(F.broadcast(totals), "name")     # one row per feature
    expected = F.col("all") * F.col("n") / F.col("rows")
    return joined.groupBy("name").agg(F.sum(F.try_divide(F.pow(F.col("o") - expected, F.lit(2)), expected)).alias("value"),
                                      (F.max("k") - 1).cast("double").alias("d1"))


def information_scores(df: DataFrame, features: Sequence[str], target: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """Mutual information of binned features with a class (or a binned numeric target), from contingency counts."""
    names = [*features, *([target] if target_bins else [])]
    row = df.agg(*[f(F.col(c).cast("double")) for c in names for f in (F.min, F.max)]).first()

    def binned(i: int, c: str, count: int) -> Column:
        low, high = row[2 * i], row[2 * i + 1]
        return F.least(F.floor((F.col(c) - low) / ((high - low) / count or 1.0)), F.lit(count - 1))
    goal = binned(len(features), target, target_bins).cast("string") if target_bins else F.col(target).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("name"), binned(i, c, bins).alias("x")) for i, c in enumerate(features)])
    counts = df.where(F.col(target).isNotNull()).select(goal.alias("y"), F.inline(cells)).where(F.col("x").isNotNull()).groupBy("name", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    plogp = lambda d: d.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("e"))
    both = plogp(counts)
    xs = plogp(counts.groupBy("name", "x").agg(F.sum("n").alias("n"))).select("name", F.col("e").alias("ex"))
    ys = plogp(counts.groupBy("name", "y").agg(F.sum("n").alias("n"))).select("name", F.col("e").alias("ey"))
    joined = both.join(xs, "name").join(ys, "name")
    return joined.select("name", (F.ln("n") + (F.col("e") - F.col("ex") - F.col("ey")) / F.col("n")).alias("value"))


def select(scores: DataFrame, mode: str = "percentile", param: float | str | None = None) -> DataFrame:
    """Mark kept features of a score table (one row per feature): percentile, k_best, fpr, fdr or fwe."""
    rows = scores.collect()
    values = {r["name"]: (r["value"] if r["value"] is not None else 0.0) for r in rows}
    ps = {}
    for r in rows:
        cells = r.asDict()
        if "d2" in cells:
            ps[r["name"]] = f_upper(values[r["name"]], r["d1"], r["d2"])
        elif "d1" in cells:
            ps[r["name"]] = chi_upper(values[r["name"]], r["d1"])
    ranked = sorted(values, key=lambda n: (-values[n], n))
    alpha = 0.05 if param is None else param
    match mode:
        case "percentile":
            share = 20 if param is None else param
            limit = float(np.percentile(list(values.values()), 100 - share)) if share < 100 else -math.inf
            kept = [n for n in ranked if values[n] > limit]
            room = int(len(values) * share / 100) - len(kept)
            kept += [n for n in ranked if values[n] == limit][:max(room, 0)]
        case "k_best":
            kept = ranked if param in (None, "all") else ranked[:int(param)]
        case "fpr" | "fwe" | "fdr" if not ps:
            raise ValueError(f"{mode} needs a score with p values")
        case "fpr":
            kept = [n for n in ranked if ps[n] < alpha]
        case "fwe":
            kept = [n for n in ranked if ps[n] < alpha / len(ps)]
        case "fdr":
            order = sorted(ps.values())
            good = [p for i, p in enumerate(order) if p <= alpha * (i + 1) / len(order)]
            kept = [n for n in ranked if good and ps[n] <= max(good)]
        case _:
            raise ValueError(f"unknown mode {mode!r}")
    out = [(n, n in set(kept), round(values[n], 3)) for n in ranked]
    return scores.sparkSession.createDataFrame(out, "name string, prime boolean, value double")


# --- model scores -------------------------------------------------------------------------------------

def _rows(df: DataFrame, features: Sequence[str], target: str, classify: bool) -> DataFrame:
    data = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df.dropna(subset=[target]))
    if classify:
        return StringIndexer(inputCol=target, outputCol="label").fit(data).transform(data)
    return data.withColumn("label", F.col(target).cast("double"))


def _importance(df: DataFrame, features: Sequence[str], scores: Sequence[float]) -> DataFrame:
    mean = float(np.mean(np.abs(scores)))
    out = sorted(((n, bool(abs(v) >= mean), round(float(v), 3)) for n, v in zip(features, scores)), key=lambda r: -r[2])
    return df.sparkSession.createDataFrame(out, "name string, prime boolean, value double")


def _one_feature_importances(model, width: int) -> np.ndarray:
    models = model.models if hasattr(model, "models") else [model]
    return np.mean([m.featureImportances.toArray() for m in models], axis=0)


def model_scores(df: DataFrame, features: Sequence[str], target: str, model: str = "linear", classify: bool = False, seed: int = 0) -> DataFrame:
    """Coefficients or importances; features at or above the mean are kept."""
    rows = _rows(df, features, target, classify)
    if model == "boost" and classify:
        return _importance(df, features, _boosted_scores(rows, features, seed))
    with kept(spread(rows.select("features", "label"))) as data:
        scores = _fitted_scores(data, features, model, classify, seed)
    return _importance(df, features, scores)


def _boosted_scores(rows: DataFrame, features: Sequence[str], seed: int) -> np.ndarray:
    """Importances of boosted trees, which see of a row nothing but its label and the bins of its features.

    Rows equal in these are one cell, with their number as its weight: trees read cells, which never outnumber the rows.
    """
    booster = GBTClassifier(seed=seed, maxIter=10)
    values = [f"_x{i}" for i in range(len(features))]
    rows = rows.select(*[F.col(c).cast("double").alias(x) for c, x in zip(features, values)], "label")
    cuts = _tree_cuts(rows.select(*values), booster)
    cells = _binned(rows, values, cuts).groupBy(*values, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    with kept(cells.select(array_to_vector(F.array(*values)).alias("features"), "label", "weight")) as held:
        # every bin stays one: a booster looks for cuts in maxBins ** 2 rows at least, and takes all between up to maxBins values
        booster.setWeightCol("weight").setMaxBins(max(booster.getMaxBins(), math.isqrt(held.count()) + 1, *[len(c) + 1 for c in cuts]))
        data, classes = use_all_cores(spread(held)), held.select("label").distinct().count()
        fitted = booster.fit(data) if classes == 2 else OneVsRest(classifier=booster, weightCol="weight").fit(data)
    return _one_feature_importances(fitted, len(features))


def _tree_cuts(values: DataFrame, booster: GBTClassifier) -> list[np.ndarray]:
    """Cuts between the bins of each column: those that the booster finds before its first tree, from the rows that it draws for that."""
    spark, bins = values.sparkSession, booster.getMaxBins()
    endless = reduce(Column.__or__, [F.abs(c) == math.inf for c in values.columns])
    count, wrong = values.agg(F.count(F.lit(1)), F.count_if(endless)).first()
    if wrong:
        raise ValueError("features must not be infinite")
    share = min(1.0, max(bins * bins, 10_000) / max(count, 1))
    drawn = values
    if share < 1:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(booster.getSeed()).nextInt()
        drawn = DataFrame(spark._jsparkSession.createDataFrame(values._jdf.toJavaRDD().sample(False, share, draw), values._jdf.schema()), spark)
    table = drawn.toPandas()
    return [_column_cuts(table[c].to_numpy(), share * count, min(bins, count) - 1) for c in values.columns]


def _column_cuts(drawn: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Middles between neighbouring values where the rows up to there are nearest a multiple of the stride, as Spark's trees take them.

    Like there, zeros are the rows that were expected and not drawn as other values.
    """
    values, counts = np.unique(drawn[drawn != 0], return_counts=True)
    zeros = expected - counts.sum()
    if len(values) and zeros > np.finfo(float).eps * counts.sum() * 100:
        place = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, place, 0.0), np.insert(counts.astype(float), place, zeros)
    if len(values) <= most + 1:
        return (values[:-1] + values[1:]) / 2
    stride = expected / (most + 1)
    cuts, target, reached = [], stride, np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            cuts.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(cuts)


def _binned(rows: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """The columns' values as the number of cuts below them, by halving."""
    steps = [1 << k for k in reversed(range(max(len(c) for c in cuts).bit_length()))]
    ends = [F.array(*[F.lit(float(v)) for v in c], *[F.lit(math.inf)] * (2 * steps[0] - 1 - len(c))) if steps else None for c in cuts]
    others = [c for c in rows.columns if c not in columns]
    out = rows.select("*", *[F.lit(0).alias(f"{c}_bin") for c in columns])
    for step in steps:
        out = out.select(*rows.columns, *[(F.col(f"{c}_bin") + F.when(F.col(c) > F.get(end, F.col(f"{c}_bin") + (step - 1)), step).otherwise(0))
                                          .alias(f"{c}_bin") for c, end in zip(columns, ends)])
    return out.select(*others, *[F.col(f"{c}_bin").cast("double").alias(c) for c in columns])


def _fitted_scores(data: DataFrame, features: Sequence[str], model: str, classify: bool, seed: int):
    match model:
        case "linear" if classify:
            scores = np.abs(LogisticRegression(regParam=0.01).fit(data).coefficientMatrix.toArray()[0])
        case "linear":
            scores = LinearRegression().fit(data).coefficients.toArray()
        case "lasso" if classify:
            scores = np.abs(LogisticRegression(regParam=0.01, elasticNetParam=1.0).fit(data).coefficientMatrix.toArray()[0])
        case "lasso":
            lasso = LinearRegression(elasticNetParam=1.0)
            grid = ParamGridBuilder().addGrid(lasso.regParam, [0.001, 0.01, 0.1, 1.0]).build()
            scores = CrossValidator(estimator=lasso, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=3, seed=seed,
                                    parallelism=2).fit(data).bestModel.coefficients.toArray()
        case "randomf":
            scores = (RandomForestClassifier(seed=seed) if classify else RandomForestRegressor(seed=seed)).fit(data).featureImportances.toArray()
        case "boost":      # of numbers; classes have _boosted_scores
            scores = GBTRegressor(seed=seed, maxIter=10).fit(data).featureImportances.toArray()
        case _:
            raise ValueError(f"unknown model {model!r}")
    return scores


def _forest(classify: bool, seed: int, trees: int = 10):
    return RandomForestClassifier(seed=seed, numTrees=trees) if classify else RandomForestRegressor(seed=seed, numTrees=trees)


def _judge(classify: bool):
    return MulticlassClassificationEvaluator(metricName="accuracy") if classify else RegressionEvaluator(metricName="r2")


def elimination(df: DataFrame, features: Sequence[str], target: str, classify: bool = True, seed: int = 0) -> DataFrame:
    """Drop the least important feature until two remain; the best two-fold score decides which rank as kept."""
    if len(features) < 2:
        raise ValueError("elimination needs two features")
    left, trail = list(features), []
    while True:
        with kept(spread(_rows(df, left, target, classify).select("features", "label"))) as data:
            checked = CrossValidator(estimator=_forest(classify, seed), estimatorParamMaps=[{}], evaluator=_judge(classify), numFolds=2, seed=seed).fit(data)
        trail.append((checked.avgMetrics[0], list(left)))
        if len(left) <= 2:
            break
        left.pop(int(np.argmin(checked.bestModel.featureImportances.toArray())))
    best = max(trail, key=lambda r: (r[0], -len(r[1])))[1]
    ranks = {}
    for _, names in trail:
        for n in names:
            ranks[n] = ranks.get(n, 0) + 1
    top = ranks[min(best, key=ranks.get)]
    return df.sparkSession.createDataFrame(sorted(((n, n in best, float(min(ranks[n], top))) for n in features), key=lambda r: -r[2]),
                                           "name string, prime boolean, value double")


DEALT_ROWS = 100_000     # rows that one task puts in order to deal them


def _shuffled_column(data: DataFrame, column: str, ident: Sequence[str], seed: int) -> DataFrame:
    """The column's values dealt to other rows: two hash orders are numbered and joined on the number."""
    givers, takers = _hash_numbered(data.select(*dict.fromkeys([*ident, column])), ident, seed), _hash_numbered(data, ident, seed + 1)
    return takers.drop(column).join(givers.select("_i", column), "_i").drop("_i")


def _hash_numbered(data: DataFrame, ident: Sequence[str], seed: int) -> DataFrame:
    """Rows with their number ``_i`` (from 1) in the order of a hash; the leading bits of a hash say which rows are numbered together."""
    bits = math.ceil(math.log2(max(1, data.count() / DEALT_ROWS)))
    lead = F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = data.withColumn("_h", F.xxhash64(F.lit(seed), *ident)).withColumn("_b", lead)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # a row per part
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ident))
    return rows.join(F.broadcast(sizes), "_b").withColumn("_i", inside + F.col("_first")).drop("_h", "_b", "_first")


def permutation_scores(df: DataFrame, features: Sequence[str], target: str, ident: Sequence[str], classify: bool = True,
                       repeats: int = 5, seed: int = 0) -> DataFrame:
    """Mean drop of the score of a boosted (or forest) model when one column is dealt anew."""
    data = cut_lineage(_rows(df, features, target, classify).select(*dict.fromkeys([*ident, *features, "features", "label"])))
    model = (_forest(True, seed) if classify else GBTRegressor(seed=seed, maxIter=10)).fit(data)
    judge, base = _judge(classify), _judge(classify).evaluate(model.transform(data))
    drops = []
    for c in features:
        lost = []
        for r in range(repeats):
            dealt = _shuffled_column(data.drop("features"), c, ident, seed + 101 * r)
            again = VectorAssembler(inputCols=list(features), outputCol="features").transform(dealt)
            lost.append(base - judge.evaluate(model.transform(again)))
        drops.append(float(np.mean(lost)))
    out = sorted(((n, True, round(v, 3)) for n, v in zip(features, drops)), key=lambda r: -r[2])
    return df.sparkSession.createDataFrame(out, "name string, prime boolean, value double")


def null_importance(df: DataFrame, features: Sequence[str], target: str, ident: Sequence[str], classify: bool = True,
                    runs: int = 10, seed: int = 0) -> DataFrame:
    """ln(1e-10 + gain / (1 + 75 % quantile of gains under a dealt target))."""
    data = cut_lineage(_rows(df, features, target, classify).select(*dict.fromkeys([*ident, "features", "label"])))
    real = _forest(classify, seed).fit(data).featureImportances.toArray()
    nulls = [_forest(classify, seed).fit(_shuffled_column(data, "label", ident, seed + 17 * (r + 1))).featureImportances.toArray()
             for r in range(runs)]
    limit = np.percentile(np.array(nulls), 75, axis=0)
    out = sorted(((n, True, round(math.log(1e-10 + g / (1 + q)), 3)) for n, g, q in zip(features, real, limit)), key=lambda r: -r[2])
    return df.sparkSession.createDataFrame(out, "name string, prime boolean, value double")


# --- generated features ---------------------------------------------------------------------------------

def table_features(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Date parts, text lengths and word counts by column type, beside the kept columns."""
    made = []
    for c, t in df.dtypes:
        if c in keep:
            continue
        if t.startswith("timestamp") or t == "date":
            made += [F.year(c).alias(f"{c}_year"), F.month(c).alias(f"{c}_month"), F.dayofmonth(c).alias(f"{c}_day"), F.weekday(c).alias(f"{c}_weekday")]
        elif t == "string":
            words = F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != ""))
            made += [F.length(c).alias(f"{c}_chars"), words.alias(f"{c}_words")]
        else:
            made.append(F.col(c))
    return df.select(*keep, *made)


def series_features(df: DataFrame, key: str, ts: str, value: str, lags: Sequence[int] = (1, 2, 3), sigmas: float = 2) -> DataFrame:
    """Summary, change, location, strike, peak, correlation and trend features per series.

    Two ordered passes with halo rows and grouped sums; no series is gathered.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(ts), F.col(value).cast("double").alias("v"))
    stats = describe(rows, [key], ["v"], [0.25, 0.5, 0.75]).drop("name")
    base = stats.select(key, F.col("mean").alias("_mean"), F.col("std").alias("_sd"), F.col("q")[1].alias("_median"), F.col("min").alias("_min"),
                        F.col("max").alias("_max"))
    hot = hot_keys(rows, [key])
    placed = lookup_join(running(rows, [key], ts, {"_place": F.lit(1)}, {"_size": F.lit(1)}, hot), base, [key])
    reach = max([1, *lags])

    def near(w):
        return {"_prev": F.lag("v").over(w), "_next": F.lead("v").over(w), **{f"_lag{k}": F.lag("v", k).over(w) for k in lags}}
    wide = over_series(placed, [key], ts, near, before=reach, after=1, hot=hot)
    above, below = F.col("v") > F.col("_mean"), F.col("v") < F.col("_mean")
    n, v, mean = F.count(F.lit(1)), F.col("v"), F.col("_mean")
    change, e = F.col("v") - F.col("_prev"), F.col("v") - F.col("_mean")
    # sample-adjusted forms of the population skewness and excess kurtosis
    skew = F.when(n > 2, F.skewness("v") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    kurt = F.when(n > 3, ((n + 1.0) * F.kurtosis("v") + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))
    where = lambda c: F.when(v == F.col(c), F.col("_place"))
    centre = F.max("_size")
    parts = {
        "sum": F.sum(v), "skewness": skew, "kurtosis": kurt, "abs_energy": F.sum(v * v), "abs_change_sum": F.coalesce(F.sum(F.abs(change)), F.lit(0.0)),
        "mean_abs_change": F.avg(F.abs(change)), "mean_change": F.avg(change), "count_above_mean": F.count_if(above),
        "count_below_mean": F.count_if(below), "first_max": (F.min(where("_max")) - 1) / centre, "last_max": F.max(where("_max")) / centre,
        "first_min": (F.min(where("_min")) - 1) / centre, "last_min": F.max(where("_min")) / centre,
        "peaks": F.count_if((v > F.col("_prev")) & (v > F.col("_next"))), "slope": F.regr_slope(v, F.col("_place") - 1.0),
        "intercept": F.regr_intercept(v, F.col("_place") - 1.0),
        "beyond_sigma": F.avg((F.abs(e) > F.col("_sd") * sigmas).cast("double")),
        "duplicate_max": F.count_if(v == F.col("_max")) > 1, "duplicate_min": F.count_if(v == F.col("_min")) > 1}
    for k in lags:
        covariance = F.sum(e * (F.col(f"_lag{k}") - mean)) / (n - k)
        parts[f"autocorrelation_{k}"] = F.when(n > k, F.try_divide(covariance, F.var_pop(v)))
    found = wide.groupBy(key).agg(*[c.alias(name) for name, c in parts.items()])
    strikes = _longest_strike(wide.select(key, ts, "_place", above.alias("up")), key, hot)
    repeats = rows.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg((F.max("n") > 1).alias("duplicates"))
    named = stats.select(key, F.col("count").alias("length"), "mean", F.col("q")[1].alias("median"), "min", "max", "std", "variance",
                         F.col("q")[0].alias("quantile_25"), F.col("q")[2].alias("quantile_75"))
    return named.join(found, key).join(strikes, key).join(repeats, key)


def _longest_strike(rows: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Longest run above the mean: inside a run, place minus the running count of hits is constant."""
    counted = running(rows, [key], "_place", {"_hits": F.col("up").cast("long")}, hot=hot)
    runs = counted.where("up").groupBy(key, (F.col("_place") - F.col("_hits")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    best = runs.groupBy(key).agg(F.max("n").alias("longest_above"))
    return rows.select(key).distinct().join(best, key, "left").withColumn("longest_above", F.coalesce("longest_above", F.lit(0).cast("long")))


def informative(df: DataFrame, key: Sequence[str], digits: int = 5, limit: int | None = 10) -> DataFrame:
    """Drop empty, constant and duplicate columns; round; first rows by key (``limit`` None keeps all).

    Columns of equal order-free hash sums are then compared cell by cell.
    """
    names = [c for c in df.columns if c not in key]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.approx_count_distinct(c).alias("d"), F.min(text(c)).alias("lo"), F.max(text(c)).alias("hi"),
                            F.sum(F.xxhash64(*key, text(c)).cast("decimal(38,0)")).alias("h")).alias(c) for c in names]).first()
    kept = [c for c in names if row[c]["n"] and row[c]["lo"] != row[c]["hi"]]
    same: dict = {}
    for c in kept:
        same.setdefault(row[c]["h"], []).append(c)
    pairs = [(g[0], c) for g in same.values() for c in g[1:]]
    if pairs:
        differ = df.agg(*[F.count_if(~F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        kept = [c for c in kept if c not in {b for i, (_, b) in enumerate(pairs) if not differ[f"p{i}"]}]
    numbers = {c for c, t in df.dtypes if t in ("double", "float")}
    out = df.select(*key, *[F.round(c, digits).alias(c) if c in numbers else F.col(c) for c in kept])
    return out.orderBy(*key).limit(limit) if limit else out
