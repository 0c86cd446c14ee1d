"""Scores of predictions as aggregates over (label, prediction)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import column_quantiles, running
from plumbline.functions.settings import cut_lineage


def regression_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, MSE, RMSE, R², explained variance, MAPE, MSLE, RMSLE, maximum and median error, Poisson and gamma deviance."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    mse, msle = F.avg(e * e), F.avg(F.when((y > -1) & (p > -1), F.pow(F.log1p(y) - F.log1p(p), F.lit(2))))
    poisson = F.avg(F.when(p > 0, 2 * (F.when(y > 0, y * F.ln(y / p)).otherwise(0.0) - y + p)))
    gamma = F.avg(F.when((p > 0) & (y > 0), 2 * (F.ln(p / y) + y / p - 1)))
    median = column_quantiles(df.select(F.abs(e).alias("e")), ["e"], [0.5])["e"][0]
    return df.agg(F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
                  (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"), (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
                  F.avg(F.try_divide(F.abs(e), F.abs(y))).alias("mape"), msle.alias("msle"), F.sqrt(msle).alias("rmsle"),
                  F.max(F.abs(e)).alias("max_error"), F.lit(median).alias("median_error"),
                  poisson.alias("poisson_deviance"), gamma.alias("gamma_deviance"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall and F1 per class from the confusion counts."""
    c = confusion(df, label, prediction)
    both = F.array(F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said")),
                   F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said")))
    sides = c.select(F.inline(both)).groupBy("class").agg(F.sum("truth").alias("support"), F.sum("said").alias("said"))
    hits = c.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"), F.col("n").alias("hits"))
    out = sides.join(hits, "class", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return out.select("class", "support", zero(F.try_divide(F.col("hits"), F.col("said"))).alias("precision"),
                      zero(F.try_divide(F.col("hits"), F.col("support"))).alias("recall"),
                      zero(F.try_divide(2 * F.col("hits"), F.col("said") + F.col("support"))).alias("f1"), "hits")


def classification_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted precision, recall and F1, and Cohen's kappa."""
    per = class_scores(df, label, prediction)
    counts = per.withColumn("_said", F.when(F.col("precision") > 0, F.col("hits") / F.col("precision")))
    total = F.sum("support")
    real = F.col("support") > 0
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    sides = confusion(df, label, prediction)
    chance = sides.groupBy("label").agg(F.sum("n").alias("t")).join(
        sides.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("s")), "label").agg(
        F.sum(F.col("t").cast("double") * F.col("s"))).scalar()
    accuracy = F.sum("hits") / total
    expected = F.coalesce(chance, F.lit(0.0)) / (total * total.cast("double"))
    return counts.agg(accuracy.alias("accuracy"), F.avg(F.when(real, F.col("recall"))).alias("balanced_accuracy"),
                      F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
                      weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"),
                      weighted("f1").alias("weighted_f1"), F.try_divide(accuracy - expected, 1 - expected).alias("kappa"))


def binary_scores(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Log loss, Brier score, hinge-free counts, ROC AUC and average precision of a probability for label 1.

    AUC counts ties by half from running class counts over distinct scores, so rows are never ranked together.
    """
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    base = df.agg(F.avg(-(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"),
                  F.avg(((p >= threshold) == (y == 1)).cast("double")).alias("accuracy"))
    counts = df.groupBy((-p).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    walked = running(counts, [], "s", {"_tp": F.col("pos"), "_fp": F.col("neg")}, {"_P": F.col("pos"), "_Q": F.col("neg")})
    area = F.sum(F.col("neg") * (F.col("_tp") - F.col("pos") / 2)) / F.max(F.col("_P") * F.col("_Q"))
    average = F.sum(F.col("pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))) / F.max("_P")
    found = walked.agg(area.alias("auc"), average.alias("average_precision"))
    return base.select("*", found.select("auc").scalar().alias("auc"), found.select("average_precision").scalar().alias("average_precision"))


def ranking_scores(df: DataFrame, group: str, relevance: str, score: str, k: int = 10) -> DataFrame:
    """Mean NDCG@k, precision@k and reciprocal rank over groups; only the top k of a group are gathered."""
    from pyspark.sql import Window
    by = lambda c: Window.partitionBy(group).orderBy(F.col(c).desc(), F.col(relevance))
    top = df.withColumn("r", F.row_number().over(by(score))).where(F.col("r") <= k)
    best = df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(relevance).desc()))).where(F.col("r") <= k)
    gain = (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col("r") + 1)
    seen = top.groupBy(group).agg(F.sum(gain).alias("dcg"), F.avg((F.col(relevance) > 0).cast("double")).alias("precision"),
                                  F.min(F.when(F.col(relevance) > 0, F.col("r"))).alias("first"))
    ideal = best.groupBy(group).agg(F.sum(gain).alias("ideal"))
    both = seen.join(ideal, group)
    return both.agg(F.avg(F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), F.lit(0.0))).alias("ndcg"),
                    F.avg("precision").alias("precision"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def cluster_agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Rand, adjusted Rand, mutual information, homogeneity, completeness, V and Fowlkes-Mallows from the contingency table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda v: v * (v - 1) / 2

    def side(name: str) -> DataFrame:
        sums = cells.groupBy(name).agg(F.sum("n").alias("n"))
        return sums.agg(F.sum(pairs(F.col("n"))).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("e"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("p"), F.sum(F.col("n") * F.ln("n")).alias("e"))
    s = lambda d, c: d.select(c).scalar()
    t, c = side("t"), side("c")
    base = whole.select("n", "p", "e", s(t, "p").alias("tp"), s(t, "e").alias("te"), s(c, "p").alias("cp"), s(c, "e").alias("ce"))
    n, all_pairs = F.col("n"), pairs(F.col("n"))
    h_t, h_c = F.ln(n) - F.col("te") / n, F.ln(n) - F.col("ce") / n
    mi = F.ln(n) + (F.col("e") - F.col("te") - F.col("ce")) / n
    homogeneity = F.when(h_t > 0, mi / h_t).otherwise(1.0)
    completeness = F.when(h_c > 0, mi / h_c).otherwise(1.0)
    expected = F.col("tp") * F.col("cp") / all_pairs
    return base.select(((all_pairs + 2 * F.col("p") - F.col("tp") - F.col("cp")) / all_pairs).alias("rand"),
                       F.try_divide(F.col("p") - expected, (F.col("tp") + F.col("cp")) / 2 - expected).alias("adjusted_rand"),
                       mi.alias("mutual_info"), homogeneity.alias("homogeneity"), completeness.alias("completeness"),
                       F.try_divide(2 * homogeneity * completeness, homogeneity + completeness).alias("v_measure"),
                       F.try_divide(F.col("p"), F.sqrt(F.col("tp") * F.col("cp"))).alias("fowlkes_mallows"))


CENTRES = 4096     # cluster centres of a block


def cluster_shape(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from cluster sums; only centres are compared, never rows.

    Each cluster's worst partner is the maximum over blocks of centres that meet in tasks, so any number of clusters
    will do.  Rows without a cluster are left out.  A centre that coincides with another has no ratio with it.
    """
    rows = df.where(F.col(cluster).isNotNull())
    names = [f"m{i}" for i in range(len(columns))]
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    sums = cut_lineage(rows.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(m) for m, c in zip(names, columns)],
                                                                    *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]))
    total = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[(F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(m) for m in names]).first()
    n, k = total["n"], total["k"]
    between, within = sums.agg(F.sum(F.col("n") * add([F.pow(F.col(m) - F.lit(total[m]), F.lit(2)) for m in names])),
                               F.sum(F.col("n") * add([F.col(f"v{i}") for i in range(len(columns))]))).first()
    gap = F.sqrt(add([F.pow(F.col(c) - F.col(m), F.lit(2)) for m, c in zip(names, columns)]))
    near = rows.join(sums.select("_c", *names), F.col(cluster) == F.col("_c")).groupBy("_c").agg(F.avg(gap).alias("s"))
    many = max(1, math.ceil(k / CENTRES))
    place = F.pmod(F.xxhash64("_c"), F.lit(many))
    centres = cut_lineage(sums.join(near, "_c").select(F.xxhash64(F.lit("id"), "_c").alias("id"), F.array(*names).alias("m"), "s", place.alias("block")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))

    def worst(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({})
        x, y = (np.asarray(t["m"].combine_chunks().flatten(), float).reshape(len(t), -1) for t in (a, b))
        mine, theirs = a["s"].to_numpy(), b["s"].to_numpy()
        most = np.zeros(len(x))
        for at in range(0, len(x), 256):
            apart = np.sqrt(sum((x[at:at + 256, i][:, None] - y[:, i]) ** 2 for i in range(x.shape[1])))
            ratio = np.divide(mine[at:at + 256, None] + theirs, apart, out=np.zeros_like(apart), where=apart > 0)
            most[at:at + 256] = ratio.max(axis=1)
        return pa.table({"id": a["id"], "worst": pa.array(most)})

    left = centres.select("id", "m", "s", F.col("block").alias("a"), every.alias("b"))
    right = centres.select(F.col("m").alias("m"), F.col("s").alias("s"), F.col("block").alias("b"), every.alias("a"))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(worst, "id long, worst double")
    mean = found.groupBy("id").agg(F.max("worst").alias("worst")).agg(F.avg("worst")).first()[0]
    ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within else None
    return df.sparkSession.createDataFrame([(ch, mean if k > 1 else None)], "calinski_harabasz double, davies_bouldin double")
