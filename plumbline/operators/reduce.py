"""Clusters by k-means and dimension reduction by linear projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grouped_map import check_length
from plumbline.functions.settings import spread
from plumbline.operators import series_clusters


def assembled(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric columns (or one array column) as an ML vector; rows with nulls are left out."""
    if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array"):
        return df.where(F.col(columns[0]).isNotNull()).withColumn(name, array_to_vector(F.col(columns[0]).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, columns: Sequence[str], k: int = 2, iterations: int = 300, tolerance: float = 1e-4, seed: int = 0):
    """(rows with ``cluster``, fitted model)."""
    rows = assembled(df, columns)
    model = KMeans(k=k, maxIter=iterations, tol=tolerance, seed=seed, predictionCol="cluster").fit(spread(rows.select("features")))
    return model.transform(rows), model


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    return clustered.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"))


def silhouette(clustered: DataFrame, cluster: str = "cluster", features: str = "features") -> float:
    """Squared-distance silhouette, computed from cluster sums in one pass."""
    return ClusteringEvaluator(predictionCol=cluster, featuresCol=features).evaluate(clustered)


MOST_COLUMNS = 4096     # the driver decomposes a square matrix of that many rows, 128 MB


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance of a vector column; only the d x d result reaches the driver."""
    n, mean, sd = rows.select(Summarizer.count(F.col("features")), Summarizer.mean(F.col("features")),
                              Summarizer.std(F.col("features"))).first()
    if n < 2:
        raise ValueError("at least two complete rows are needed")
    if len(mean) > MOST_COLUMNS:
        raise ValueError(f"{len(mean)} columns, more than {MOST_COLUMNS}: their matrix would not fit the driver")
    sd = sd.toArray()
    r = np.nan_to_num(Correlation.corr(rows, "features").first()[0].toArray())
    return n, mean.toArray(), r * np.outer(sd, sd)


def _fixed_signs(axes: np.ndarray) -> np.ndarray:
    """Flip columns so that the largest loading is positive, which makes results repeatable."""
    top = np.abs(axes).argmax(0)
    return axes * np.where(axes[top, range(axes.shape[1])] < 0, -1.0, 1.0)


def projected(df: DataFrame, axes: np.ndarray, shift: np.ndarray) -> DataFrame:
    """``d0, d1, ...``: dot products with the axes after subtracting ``shift``, as column expressions."""
    values = vector_to_array("features")
    out = df.withColumn("_v", values)
    for j in range(axes.shape[1]):
        weights = F.array(*[F.lit(float(w)) for w in axes[:, j]])
        offset = float(shift @ axes[:, j])
        dot = F.aggregate(F.zip_with("_v", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - F.lit(offset)
        out = out.withColumn(f"d{j}", dot)
    return out.drop("_v")


def pca(df: DataFrame, columns: Sequence[str], k: int = 2):
    """Centred principal components ``d0..``, the variance shares and the axes."""
    rows = assembled(df, columns)
    _, mean, cov = _moments(rows)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1][:k]
    axes = _fixed_signs(vectors[:, order])
    share = (values[order] / values.sum()).tolist() if values.sum() else [0.0] * len(order)
    return projected(rows, axes, mean), share, axes


def svd(df: DataFrame, columns: Sequence[str], k: int = 2):
    """Truncated singular value decomposition without centring: projections, singular values, axes."""
    rows = assembled(df, columns)
    n, mean, cov = _moments(rows)
    values, vectors = np.linalg.eigh(cov * (n - 1) + n * np.outer(mean, mean))
    order = values.argsort()[::-1][:k]
    axes = _fixed_signs(vectors[:, order])
    return projected(rows, axes, np.zeros(axes.shape[0])), np.sqrt(np.maximum(values[order], 0)).tolist(), axes


def ica(df: DataFrame, columns: Sequence[str], k: int = 2, iterations: int = 200, tolerance: float = 1e-4, seed: int = 0,
        deflation: bool = False):
    """Independent components: whitening by PCA, then fixed-point steps with one aggregate each (tanh contrast)."""
    rows = assembled(df, columns)
    n, mean, cov = _moments(rows)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1][:k]
    white = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300))
    base = projected(rows, white, mean)
    names = [f"d{j}" for j in range(k)]
    z = base.select(F.array(*names).alias("z")).persist()

    def step(w: np.ndarray) -> np.ndarray:
        parts = []
        for row in w:
            y = sum((F.col("z")[i] * float(row[i]) for i in range(k)), F.lit(0.0))
            g = F.tanh(y)
            parts += [*[F.avg(F.col("z")[i] * g) for i in range(k)], F.avg(1 - g * g)]
        got = np.array(z.agg(*[p.alias(f"a{i}") for i, p in enumerate(parts)]).first(), dtype=float).reshape(len(w), k + 1)
        return got[:, :k] - got[:, k:] * w

    def orthogonal(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w, full_matrices=False)
        return u @ v
    try:
        w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
        if deflation:
            for j in range(k):
                for _ in range(iterations):
                    new = step(w[j:j + 1])[0]
                    new -= w[:j].T @ (w[:j] @ new)
                    new /= np.linalg.norm(new) or 1.0
                    moved, w[j] = 1 - abs(new @ w[j]), new
                    if moved < tolerance:
                        break
        else:
            for _ in range(iterations):
                new = orthogonal(step(w))
                moved = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
                w = new
                if moved < tolerance:
                    break
    finally:
        z.unpersist()
    axes = white @ w.T
    return projected(rows, axes, mean), axes


def _between(rows: DataFrame, label: str, mean: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of classes and their scatter around the mean: classes stay a table, each task returns one square matrix."""
    means = rows.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"), F.count(F.lit(1)).alias("n")).select("m", "n")
    width = len(mean)

    def scatter(batches):
        total, classes = np.zeros((width, width)), 0
        for pdf in batches:
            if len(pdf):
                gap = np.stack(pdf["m"].to_numpy()) - mean
                total += gap.T @ (gap * pdf["n"].to_numpy(dtype=float)[:, None])
                classes += len(pdf)
        if classes:
            yield pd.DataFrame({"classes": [classes], "scatter": [total.ravel().tolist()]})

    parts = means.mapInPandas(scatter, "classes long, scatter array<double>").collect()
    return sum(p.classes for p in parts), sum((np.array(p.scatter).reshape(width, width) for p in parts), np.zeros((width, width)))


def lda(df: DataFrame, columns: Sequence[str], label: str, k: int | None = None):
    """Linear discriminants from class sums: projections ``d0..`` and the axes (at most classes - 1)."""
    rows = assembled(df, columns).where(F.col(label).isNotNull())
    n, mean, cov = _moments(rows)
    classes, between = _between(rows, label, mean)
    within = cov * (n - 1) - between
    most = min(classes - 1, len(mean))
    k = min(k or most, most)
    low = np.linalg.cholesky(within + np.eye(len(mean)) * 1e-9 * max(np.trace(within) / len(mean), 1e-300))
    inverse = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inverse @ between @ inverse.T)
    axes = inverse.T @ vectors[:, values.argsort()[::-1][:k]]
    axes = _fixed_signs(axes * np.sqrt(max(n - classes, 1)))
    return projected(rows, axes, mean), axes


def display(df: DataFrame, columns: Sequence[str], label: str, k: int = 2) -> DataFrame:
    """Projection of labelled rows for a chart."""
    return pca(df, columns, k)[0].select(label, *[f"d{j}" for j in range(k)])


def component_bands(projected_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centre and the two- and eight-sigma bands per component."""
    cells = [F.struct(F.lit(c).alias("name"), F.avg(c).alias("centre"), F.stddev_pop(c).alias("sd")) for c in names]
    out = projected_rows.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    band = lambda times: ((F.col("centre") - F.col("sd") * times), (F.col("centre") + F.col("sd") * times))
    return out.select("name", "centre", band(1)[0].alias("low_2"), band(1)[1].alias("high_2"), band(4)[0].alias("low_8"), band(4)[1].alias("high_8"))


def component_values(projected_rows: DataFrame, ident: Sequence[str], names: Sequence[str], raw: Sequence[str]) -> DataFrame:
    """Unpivoted components beside the raw values of their row; the row carries both, so nothing is joined back."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])
    return projected_rows.select(*ident, *raw, F.inline(cells))


# --- whole series ------------------------------------------------------------------------------------

def series_vectors(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """One vector per series of a full calendar, gaps filled before; its length is the calendar's."""
    check_length(df, key)
    rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ts, F.col(value).cast("double").alias("v")))),
                                           lambda r: r["v"]).alias("values"))
    return rows.withColumn("features", array_to_vector("values"))


def cluster_series(df: DataFrame, key: str, ts: str, value: str, k: int = 2, seed: int = 0):
    """(series with their cluster, centre points (cluster, place, value), silhouette); see ``series_clusters``."""
    return series_clusters.cluster_series(df, key, ts, value, k, seed)


def cluster_series_by_density(df: DataFrame, key: str, ts: str, value: str, eps: float, least: int = 5, k: int = 2):
    """Density clusters of series on their first principal components, with sizes and silhouette.

    The components come from the products of series where there are no more series than times, otherwise from the
    matrix of times.
    """
    from plumbline.operators import neighbors
    rows = series_clusters.placed(df, key, ts, value)
    many, places = rows.agg(F.count_distinct(key), F.max("place") + 1).first()
    names = [f"d{j}" for j in range(k)]
    if many <= places:
        flat = series_clusters.series_components(rows, key, k)
    else:
        parts, _, _ = pca(series_vectors(df, key, ts, value).select(key, "values"), ["values"], k)
        flat = parts.select(key, *names)
    out = neighbors.attach(flat, names, neighbors.density_clusters(flat, names, eps, least))
    kept = assembled(out, names).where(F.col("cluster") >= 0)
    score = silhouette(kept) if kept.select("cluster").distinct().count() > 1 else None
    return out, cluster_sizes(out), score


def reduce_series(df: DataFrame, key: str, values: Sequence[str], k: int = 2) -> DataFrame:
    """Mean position of each multi-value series on ``k`` principal components of its own values.

    Centred components average to zero, so the position is the projection of the series mean without centring.
    """
    cells = [F.avg(c).alias(f"m_{c}") for c in values]
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i + 1]]
    stats = df.groupBy(key).agg(*cells, *[F.covar_samp(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    width = len(values)

    @F.pandas_udf("array<double>")
    def position(means, covs):
        import pandas as pd
        out = []
        for m, s in zip(means, covs):
            cov = np.zeros((width, width))
            for (a, b), v in zip([(i, j) for i in range(width) for j in range(i + 1)], s):
                cov[a, b] = cov[b, a] = v if v is not None and v == v else 0.0
            vals, vecs = np.linalg.eigh(cov)
            axes = _fixed_signs(vecs[:, vals.argsort()[::-1][:k]])
            out.append((np.asarray(m, dtype=float) @ axes).tolist())
        return pd.Series(out)
    done = stats.select(key, position(F.array(*[f"m_{c}" for c in values]), F.array(*[f"s{i}" for i in range(len(pairs))])).alias("_p"))
    return done.select(key, *[F.col("_p")[j].alias(f"d{j}") for j in range(min(k, width))])
