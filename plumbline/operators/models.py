"""Training, search, comparison and scoring with Spark ML, and step graphs of named tables."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import (BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import DataFrame

from plumbline.functions.settings import kept
from plumbline.operators import clean
from plumbline.operators.reduce import kmeans
from plumbline.spec import DatasetSpec, FittedSpec

CLASSIFIERS: dict[str, Callable[[], Any]] = {
    "logistic": C.LogisticRegression, "tree": C.DecisionTreeClassifier, "forest": lambda: C.RandomForestClassifier(seed=0),
    "boost": lambda: C.GBTClassifier(seed=0, maxIter=10), "bayes": lambda: C.NaiveBayes(modelType="gaussian"),
    "linear svc": C.LinearSVC, "factorization": lambda: C.FMClassifier(seed=0, stepSize=0.01)}
REGRESSORS: dict[str, Callable[[], Any]] = {
    "linear": R.LinearRegression, "tree": R.DecisionTreeRegressor, "forest": lambda: R.RandomForestRegressor(seed=0),
    "boost": lambda: R.GBTRegressor(seed=0, maxIter=10), "generalized": R.GeneralizedLinearRegression,
    "isotonic": R.IsotonicRegression, "survival": R.AFTSurvivalRegression, "factorization": lambda: R.FMRegressor(seed=0, stepSize=0.01)}
BINARY_ONLY = ("boost", "linear svc", "factorization")


def estimator(kind: str, classify: bool, classes: int = 2, params: dict | None = None):
    """A named estimator; two-class learners become one-versus-rest for more classes."""
    table = CLASSIFIERS if classify else REGRESSORS
    if kind == "perceptron" and classify:
        made = C.MultilayerPerceptronClassifier(seed=0)
    elif kind not in table:
        raise ValueError(f"unknown model {kind!r}")
    else:
        made = table[kind]()
    if params:
        made = made.copy({made.getParam(k): v for k, v in params.items()})
    return C.OneVsRest(classifier=made) if classify and classes > 2 and kind in BINARY_ONLY else made


def prepared(df: DataFrame, features: Sequence[str], target: str, classify: bool) -> tuple[list, int]:
    """Stages that assemble features and index the label, and the number of classes."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
    if not classify:
        return stages, 0
    stages.append(StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"))
    return stages, df.select(target).dropna().distinct().count()


def judge(classify: bool, target: str, metric: str | None = None):
    if not classify:
        return RegressionEvaluator(labelCol=target, metricName=metric or "rmse")
    if metric in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(labelCol="label", metricName=metric)
    return MulticlassClassificationEvaluator(labelCol="label", metricName=metric or "accuracy")


def _pipeline(df: DataFrame, features, target, kind, classify, params=None) -> Pipeline:
    stages, classes = prepared(df, features, target, classify)
    model = estimator(kind, classify, classes, params)
    if kind == "perceptron":
        model = model.setLayers([len(features), max(4, len(features)), classes])
    if not classify:
        model = model.setLabelCol(target)
        if kind == "survival":
            from pyspark.ml.feature import SQLTransformer
            stages.append(SQLTransformer(statement="SELECT *, 1.0 AS censor FROM __THIS__"))
    return Pipeline(stages=[*stages, model])


def train(df: DataFrame, features: Sequence[str], target: str, kind: str, classify: bool = True, ratio: float = 0.25,
          key: Sequence[str] = (), params: dict | None = None, metric: str | None = None) -> tuple[PipelineModel, float, DataFrame]:
    """Fit on training rows, score validation rows: (model, validation metric, validation predictions)."""
    with kept(df) as rows:
        fit_rows, held = clean.split(rows, ratio, key or df.columns)
        model = _pipeline(rows, features, target, kind, classify, params).fit(fit_rows)
        score = judge(classify, target, metric).evaluate(model.transform(held))
    return model, score, model.transform(clean.split(df, ratio, key or df.columns)[1])


# --- search ------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Range:
    """Numbers between two bounds, drawn afresh for every trial; whole ones where both bounds are whole."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        whole = isinstance(self.low, int) and isinstance(self.high, int)
        return rng.randint(self.low, self.high) if whole else rng.uniform(self.low, self.high)


def parse_space(text: dict[str, str]) -> dict[str, list | Range]:
    """Search space from text: ``(low, high, step)``, ``(low, high)``, ``[a, b]`` or one value.

    A number is whole unless it has a point; nothing is evaluated.
    """
    def value(t: str):
        t = t.strip().strip("'\"")
        if re.fullmatch(r"[+-]?\d+", t):
            return int(t)
        if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", t):
            return float(t)
        return {"True": True, "False": False, "true": True, "false": False}.get(t, t)

    space = {}
    for name, raw in text.items():
        raw = str(raw).strip()
        inner = [value(p) for p in raw[1:-1].split(",")] if raw[:1] in "([" and raw[-1:] in ")]" else None
        if raw[:1] == "(" and inner and len(inner) == 3:
            low, high, step = inner
            count = int(math.floor((high - low) / step + 1e-9))
            space[name] = [low + i * step for i in range(count + 1)]
        elif raw[:1] == "(" and inner and len(inner) == 2:
            space[name] = Range(*inner)
        elif inner is not None:
            space[name] = inner
        else:
            space[name] = [value(raw)]
    return space


def trials(space: dict[str, list | Range], count: int, rng: random.Random) -> list[dict]:
    """Settings to try: the whole grid when it has no ranges and is no larger than ``count``, else ``count`` of them.

    Lists and stepped ranges form a grid, whose settings differ as long as it lasts; ranges are drawn per trial.
    """
    lists = {name: values for name, values in space.items() if not isinstance(values, Range)}
    size = math.prod(len(v) for v in lists.values())
    wanted = count if len(lists) < len(space) else min(count, size)
    places = []
    while len(places) < wanted:
        left = wanted - len(places)
        places += list(range(size)) if size <= left else rng.sample(range(size), left)
    out = []
    for at in places:
        setting = {}
        for name, values in space.items():
            if isinstance(values, Range):
                setting[name] = values.draw(rng)
            else:
                at, i = divmod(at, len(values))
                setting[name] = values[i]
        out.append(setting)
    return out


def search(df: DataFrame, features: Sequence[str], target: str, kind: str, space: dict[str, str], count: int = 10,
           classify: bool = True, metric: str | None = None, folds: int = 0, parallelism: int = 4, stop: float | None = None,
           seed: int = 0, epochs: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """Try settings and keep the best; (best model, leaderboard).

    With ``stop`` trials end once it is reached; with ``epochs`` no trial iterates more often, whatever its setting says.
    """
    rng = random.Random(seed)
    settings = trials(parse_space(space), count, rng)
    pipe = _pipeline(df, features, target, kind, classify)
    model, score = pipe.getStages()[-1], judge(classify, target, metric)
    inner = model.getClassifier() if isinstance(model, C.OneVsRest) else model
    better = max if score.isLargerBetter() else min
    rows, best = [], None

    if epochs is not None and inner.hasParam("maxIter"):
        inner.set(inner.getParam("maxIter"), min(epochs, inner.getOrDefault("maxIter")))
        settings = [{k: min(v, epochs) if k == "maxIter" else v for k, v in s.items()} for s in settings]

    def run(batch: list[dict]):
        maps = [{inner.getParam(k): v for k, v in s.items()} for s in batch]
        if folds:
            return CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=score, numFolds=folds, seed=seed, parallelism=parallelism).fit(df)
        return TrainValidationSplit(estimator=pipe, estimatorParamMaps=maps, evaluator=score, trainRatio=0.75, seed=seed, parallelism=parallelism).fit(df)
    step = parallelism if stop is not None else len(settings)
    with kept(df):
        for at in range(0, len(settings), step):
            batch = settings[at:at + step]
            fitted = run(batch)
            scores = fitted.avgMetrics if folds else fitted.validationMetrics
            rows += [(at + i, str(s), float(v)) for i, (s, v) in enumerate(zip(batch, scores))]
            top = better(scores)
            if best is None or better(top, best[0]) == top:
                best = (top, fitted.bestModel)
            if stop is not None and (best[0] >= stop if score.isLargerBetter() else best[0] <= stop):
                break
    rows.sort(key=lambda r: -r[2] if score.isLargerBetter() else r[2])
    return best[1], df.sparkSession.createDataFrame(rows, "trial int, params string, score double")


# --- comparison --------------------------------------------------------------------------------------

CLASS_METRICS = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
NUMBER_METRICS = {"mae": "mae", "mse": "mse", "rmse": "rmse", "r2": "r2"}


def compare(df: DataFrame, features: Sequence[str], target: str, kinds: Sequence[str], classify: bool = True, folds: int = 3,
            key: Sequence[str] = (), seed: int = 0) -> tuple[DataFrame, PipelineModel]:
    """Out-of-fold metrics of several models (leaderboard), and the best one refitted on all rows."""
    from pyspark.sql import functions as F
    fold = F.pmod(F.xxhash64(F.lit(seed), *(key or df.columns)), F.lit(folds))
    metrics = CLASS_METRICS if classify else NUMBER_METRICS
    board = []
    with kept(df.withColumn("_fold", fold)) as rows:
        for kind in kinds:
            pipe = _pipeline(rows, features, target, kind, classify)
            totals = {m: 0.0 for m in metrics}
            auc = 0.0
            for i in range(folds):
                fitted = pipe.fit(rows.where(F.col("_fold") != i))
                with kept(fitted.transform(rows.where(F.col("_fold") == i))) as said:
                    for name, metric in metrics.items():
                        totals[name] += judge(classify, target, metric).evaluate(said) / folds
                    if classify and "rawPrediction" in said.columns and said.select("label").distinct().count() == 2:
                        auc += judge(True, target, "areaUnderROC").evaluate(said) / folds
            board.append({"model": kind, **totals, **({"auc": auc} if classify else {})})
        main = "accuracy" if classify else "rmse"
        board.sort(key=lambda r: -r[main] if classify else r[main])
        best = _pipeline(rows, features, target, board[0]["model"], classify).fit(rows)
    fields = ["model", *metrics, *(["auc"] if classify else [])]
    schema = "model string, " + ", ".join(f"{f} double" for f in fields[1:])
    return df.sparkSession.createDataFrame([tuple(r[f] for f in fields) for r in board], schema), best


def assign_clusters(df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 0) -> tuple[DataFrame, float]:
    """Rows with their k-means cluster, and the silhouette."""
    out, _ = kmeans(df, columns, k, seed=seed)
    return out, ClusteringEvaluator(predictionCol="cluster").evaluate(out)


def score_rows(df: DataFrame, fitted: FittedSpec, model: PipelineModel) -> DataFrame:
    """The cleaning learned in training, then the model; works on batches and streams."""
    return model.transform(clean.apply(df, fitted))


def fit_and_train(df: DataFrame, spec: DatasetSpec, kind: str, classify: bool = True, **options):
    """Clean, train and return (fitted cleaning, model, validation metric)."""
    fitted, rows = clean.fit(df, spec)
    target = spec.targets(rows)[0]
    features = [c for c, t in rows.dtypes if c != target and t in clean.NUMERIC]
    model, metric, _ = train(rows, features, target, kind, classify, **options)
    return fitted, model, metric


# --- step graph --------------------------------------------------------------------------------------

@dataclass
class Step:
    """A named table: a function of the tables it names as inputs."""

    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()


@dataclass
class Graph:
    steps: dict[str, Step] = field(default_factory=dict)

    @classmethod
    def of(cls, nodes: list[dict], edges: list[dict], kinds: dict[str, Callable[..., DataFrame]]) -> "Graph":
        """From saved nodes ``{id, data: {type, kind, data}}`` and edges ``{source: {cell}, target: {cell}}``;
        ``kinds`` maps a node type to a function of (input tables..., data)."""
        inputs: dict[str, list[str]] = {n["id"]: [] for n in nodes}
        for e in edges:
            inputs[e["target"]["cell"]].append(e["source"]["cell"])

        def made(node: dict) -> Step:
            kind = node["data"]["type"]
            if kind not in kinds:
                raise ValueError(f"unknown step type {kind!r}")
            return Step(lambda *tables: kinds[kind](*tables, node["data"].get("data", {})), tuple(inputs[node["id"]]))
        return cls({n["id"]: made(n) for n in nodes})


def run_graph(graph: Graph) -> DataFrame:
    """Compose the steps in dependency order into one lazy plan; returns the last step's table.

    A step read by several others is persisted, so that it is computed once.
    """
    order = list(TopologicalSorter({n: s.inputs for n, s in graph.steps.items()}).static_order())
    uses = {n: sum(n in s.inputs for s in graph.steps.values()) for n in order}
    tables: dict[str, DataFrame] = {}
    for name in order:
        step = graph.steps[name]
        made = step.run(*[tables[i] for i in step.inputs])
        tables[name] = made.persist() if uses[name] > 1 else made
    return tables[order[-1]]
