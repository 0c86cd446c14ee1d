"""Cleaning from a per-column specification: conversion, missing values, resampling, encoding, scaling, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordered import carry, carry_both, column_quantiles, hot_keys, lookup_join, over_series, running
from plumbline.functions.settings import cut_lineage
from plumbline.operators.query import drop_empty_columns
from plumbline.operators.series import resample
from plumbline.spec import DatasetSpec, FieldSpec, FittedSpec

LITERAL_DOMAIN = 64      # larger domains are joined, not written into the plan; the codes are the same


# --- conversion ----------------------------------------------------------------------------------

def to_time(c: str | Column) -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def to_double(c: str) -> Column:
    return F.col(c).try_cast("double")


def to_integer(c: str) -> Column:
    number = F.col(c).try_cast("double")
    return F.when(number == F.floor(number), F.floor(number)).cast("long")


def frequency_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their frequency, most frequent first (value breaks ties)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def in_domain(column: str, values: Sequence) -> Column:
    return F.when(F.col(column).isin(*values), F.col(column))


def convert(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Bring every live column to the type of its role; unreadable text becomes null."""
    types = dict(df.dtypes)

    def made(f: FieldSpec) -> Column | None:
        kind = types[f.name]
        if f.attr == "date" and not kind.startswith("timestamp"):
            return to_time(f.name) if kind == "string" else F.col(f.name).cast("timestamp_ntz")
        if f.attr == "cat" and f.values and kind == "string":
            return in_domain(f.name, f.values)
        if f.attr == "conti" and kind != "double":
            return to_double(f.name)
        if f.attr == "disc" and kind == "string":
            return to_integer(f.name)
        return None

    changes = {f.name: c for f in spec.live(df) if (c := made(f)) is not None}
    return df.withColumns(changes) if changes else df


# --- missing values ------------------------------------------------------------------------------

CONSTANT_FILLS = ("mean", "median", "mode", "min", "max")


def fill_constants(df: DataFrame, methods: dict[str, str]) -> dict[str, float | str | None]:
    """Fill values learned from a table: one aggregate for mean, min and max, exact medians, smallest mode."""
    unknown = set(methods.values()) - set(CONSTANT_FILLS)
    if unknown:
        raise ValueError(f"unknown fill {unknown}")
    simple = {"mean": F.avg, "min": F.min, "max": F.max}
    parts = [simple[m](c).alias(c) for c, m in methods.items() if m in simple]
    found = df.agg(*parts).first().asDict() if parts else {}
    medians = [c for c, m in methods.items() if m == "median"]
    if medians:
        found |= {c: q[0] for c, q in column_quantiles(df, medians, [0.5]).items()}
    for c in (c for c, m in methods.items() if m == "mode"):
        top = frequency_domain(df, c).first()
        found[c] = top[0] if top else None
    return found


def fill(df: DataFrame, column: str, method, key: str | None = None, order: str | None = None) -> DataFrame:
    """Fill (or drop) the nulls of one column.  A value that names no method is used as the constant."""
    keys = [key] if key else []
    if method == "drop":
        return df.dropna(subset=[column])
    if method in CONSTANT_FILLS:
        value = fill_constants(df, {column: method})[column]
        return df if value is None else df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    if method == "zero":
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(0).cast(dict(df.dtypes)[column])))
    if method in ("prev", "next"):
        if order is None:
            raise ValueError(f"{method} needs an order column")
        return carry_both(df, keys, order, [column], backward=method == "next")
    if isinstance(method, str) and dict(df.dtypes)[column] != "string":
        raise ValueError(f"unknown fill {method!r} for {column}")
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(method)))


def resample_mean(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Mean of every numeric column per ``minutes`` bin on the full calendar, gaps carried forward."""
    period = (f"{minutes // 1440}D" if minutes % 1440 == 0 else f"{minutes // 60}h" if minutes % 60 == 0
              else f"{minutes}min")
    numbers = [c for c, t in df.dtypes if c != ts and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return carry(resample(df, ts, numbers, period=period, agg="mean"), [], ts, numbers)


# --- encoding ------------------------------------------------------------------------------------

def sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): position of each distinct value in sorted order, from 0."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return running(values, [], column, {"code": F.lit(1)}).withColumn("code", (F.col("code") - 1).cast("long"))


def domain_code(column: str, values: Sequence) -> Column:
    """Position in a given ordered domain; -1 outside it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1, F.lit(-1)).cast("long")


def ordinal(df: DataFrame, column: str, codes: DataFrame | None = None, integer: bool = False) -> DataFrame:
    """Replace values by their sorted position (double codes, or integers for the label flavour).

    Null and values without a code become -1, however the codes are looked up.
    """
    codes = sorted_codes(df, column) if codes is None else codes
    joined = lookup_join(df, codes.withColumnRenamed("code", "_code"), [column])
    return joined.withColumn(column, F.coalesce("_code", F.lit(-1)).cast("long" if integer else "double")).drop("_code")


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """One 0/1 column per value in sorted order, all 0 for null and other values.  For wide domains see ``hot_vector``."""
    if values is None:
        values = [r[0] for r in sorted_codes(df, column).orderBy("code").collect()]
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}")
                            for v in values]).drop(column)


def hot_vector(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """One sparse 0/1 vector ``<column>_hot`` per row, a place per value; all 0 for null and values without a code."""
    codes = cut_lineage(sorted_codes(df, column)) if codes is None else codes
    size = codes.count()
    if not size:
        raise ValueError(f"{column} has no values")
    coded = ordinal(df, column, codes)
    coded = coded.withColumn(column, F.when(F.col(column) < 0, F.lit(float(size))).otherwise(F.col(column)))
    known = df.sparkSession.createDataFrame([(float(size - 1),)], f"`{column}` double")    # the encoder only asks for the largest code
    return OneHotEncoder(inputCol=column, outputCol=f"{column}_hot", handleInvalid="keep").fit(known).transform(coded).drop(column)


def hashed(df: DataFrame, column: str, width: int = 1 << 20) -> DataFrame:
    hasher = FeatureHasher(inputCols=[column], outputCol="_hashed", numFeatures=width, categoricalCols=[column])
    return hasher.transform(df).drop(column).withColumnRenamed("_hashed", column)


def binarize(c: Column, threshold: float = 1) -> Column:
    return F.when(c > threshold, 1.0).when(c.isNotNull(), 0.0)


def equal_width(c: Column, low: float, width: float, bins: int = 10) -> Column:
    if not width:
        return F.when(c.isNotNull(), 0.0)
    return F.greatest(F.lit(0.0), F.least(F.floor((c - low) / width), F.lit(bins - 1))).cast("double")


def count_encode(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("code"))


def mean_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.groupBy(column).agg(F.avg(target).alias("code"))


def woe_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """Weight of evidence of a 0/1 target per category, half a row added to every count."""
    cells = df.groupBy(column).agg(F.sum(target).alias("_pos"), F.count(target).alias("_n"))
    whole = df.agg(F.sum(target).alias("pos"), F.count(target).alias("n")).first()
    good = (F.col("_pos") + 0.5) / (whole["pos"] + 0.5)
    bad = (F.col("_n") - F.col("_pos") + 0.5) / (whole["n"] - whole["pos"] + 0.5)
    return cells.select(column, F.ln(good / bad).alias("code"))


def attach_code(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    return (lookup_join(df, codes.withColumnRenamed("code", "_code"), [column])
            .withColumn(column, F.col("_code")).drop("_code"))


# --- scaling -------------------------------------------------------------------------------------

def scale_constants(df: DataFrame, methods: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column from one aggregate (plus exact quantiles for robust)."""
    makers = {"std": lambda c: F.struct(F.avg(c), F.stddev_pop(c)),
              "minmax": lambda c: F.struct(F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
              "maxabs": lambda c: F.struct(F.lit(0.0), F.max(F.abs(c)).cast("double"))}
    parts = [makers[m](F.col(c)).alias(c) for c, m in methods.items() if m in makers]
    row = df.agg(*parts).first().asDict() if parts else {}
    found = {c: (v[0], v[1]) for c, v in row.items()}
    robust = [c for c, m in methods.items() if m == "robust"]
    if robust:
        found |= {c: (q[1], q[2] - q[0]) for c, q in column_quantiles(df, robust, [0.25, 0.5, 0.75]).items()
                  if q[0] is not None}
    return {c: (shift, divisor) for c, (shift, divisor) in found.items() if shift is not None}


def scaled(column: str, shift: float, divisor: float) -> Column:
    return (F.col(column) - F.lit(shift)) / F.lit(divisor if divisor else 1.0)


def row_norm(columns: Sequence[str], norm: str) -> list[Column]:
    """Each column divided by the L1 or L2 norm of the row over the chosen columns (0 rows stay 0)."""
    total = sum((F.abs(F.col(c)) if norm == "l1" else F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    size = total if norm == "l1" else F.sqrt(total)
    return [F.coalesce(F.try_divide(F.col(c), size), F.col(c).cast("double")).alias(c) for c in columns]


# --- the whole sequence ----------------------------------------------------------------------------

SCALES = ("std", "minmax", "maxabs", "robust", "l1", "l2")
ENCODES = ("ordinal", "hot", "hot_vector", "hash", "binary", "bins", "label", "count", "mean", "woe")
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def prepare(df: DataFrame, spec: DatasetSpec, train: bool) -> DataFrame:
    out = df.drop(*spec.omitted())
    if train:
        out = drop_empty_columns(out.dropna("all")).dropDuplicates()
    return convert(out, spec)


def fit(df: DataFrame, spec: DatasetSpec, order: str | None = None) -> tuple[FittedSpec, DataFrame]:
    """Learn every constant of the cleaning on training rows; returns them with the cleaned rows."""
    fitted = FittedSpec(spec)
    out = cut_lineage(prepare(df, spec, train=True))    # read by every constant that follows
    fitted.dropped = [f.name for f in spec.fields if f.name not in out.columns]
    pending: dict[str, str] = {}

    def settle(frame: DataFrame) -> DataFrame:
        if pending:
            # a whole-number column without nulls keeps its type and values, as there is nothing to fill
            whole = [c for c in pending if dict(frame.dtypes)[c] in NUMERIC[:2]]
            nulls = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first() if whole else {}
            wanted = {c: m for c, m in pending.items() if c not in whole or nulls[c]}
            fitted.fill |= {c: v for c, v in fill_constants(frame, wanted).items() if v is not None}
            pending.clear()
        return frame

    for f in spec.live(out):
        method = spec.method(f, "miss")
        if method is None:
            continue
        if method in CONSTANT_FILLS:
            if method == "mode" or dict(out.dtypes)[f.name] in NUMERIC:
                pending[f.name] = method
        elif method == "drop":
            out = settle(out).dropna(subset=[f.name])
        elif method in ("prev", "next"):
            out = fill(out, f.name, method, order=order)
        else:
            out = fill(out, f.name, method)
            fitted.fill[f.name] = 0 if method == "zero" else method
    out = _fill_known(settle(out), fitted)
    timeline = next((f for f in spec.live(out) if f.timeline and f.resample), None)
    if timeline:
        out = resample_mean(out, timeline.name, timeline.resample)
    out = _fit_encodings(out, fitted)
    out = _encode(out, fitted)
    wanted = {}
    for f in spec.live(out):
        method = spec.method(f, "scale")
        if method is None or dict(out.dtypes)[f.name] not in NUMERIC:
            continue
        if method not in SCALES:
            raise ValueError(f"unknown scale {method!r}")
        wanted[f.name] = method
    fitted.scale = scale_constants(out, {c: m for c, m in wanted.items() if m not in ("l1", "l2")})
    return fitted, _scale(out, fitted)


def _fill_known(df: DataFrame, fitted: FittedSpec) -> DataFrame:
    changes = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fitted.fill.items() if c in df.columns}
    return df.withColumns(changes) if changes else df


def _fit_encodings(df: DataFrame, fitted: FittedSpec) -> DataFrame:
    spec = fitted.spec
    target = next(iter(spec.targets(df)), None)
    ranges = []
    for f in spec.live(df):
        method = spec.method(f, "encode")
        if method is None:
            continue
        if method not in ENCODES:
            raise ValueError(f"unknown encoding {method!r}")
        if method == "ordinal" and f.target and f.values:
            fitted.domains[f.name] = list(f.values)
        elif method == "hot":
            fitted.domains[f.name] = [r[0] for r in sorted_codes(df, f.name).orderBy("code").collect()]
        elif method == "hot_vector":
            fitted.lookups[f.name] = cut_lineage(sorted_codes(df, f.name))
        elif method in ("ordinal", "label"):
            codes = sorted_codes(df, f.name)
            head = codes.limit(LITERAL_DOMAIN + 1).collect()
            if len(head) <= LITERAL_DOMAIN:
                fitted.domains[f.name] = [r[0] for r in sorted(head, key=lambda r: r["code"])]
            else:
                fitted.lookups[f.name] = cut_lineage(codes)
        elif method == "bins":
            ranges.append(f.name)
        elif method == "count":
            fitted.lookups[f.name] = cut_lineage(count_encode(df, f.name))
        elif method == "mean":
            fitted.lookups[f.name] = cut_lineage(mean_encode(df, f.name, target))
        elif method == "woe":
            fitted.lookups[f.name] = cut_lineage(woe_encode(df, f.name, target))
    if ranges:
        row = df.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in ranges]).first()
        fitted.bins = {c: (row[c][0], (row[c][1] - row[c][0]) / 10) for c in ranges if row[c][0] is not None}
    return df


def _encode(df: DataFrame, fitted: FittedSpec) -> DataFrame:
    spec, out = fitted.spec, df
    for f in spec.live(df):
        method = spec.method(f, "encode")
        if method is None:
            continue
        if method == "hot":
            out = one_hot(out, f.name, fitted.domains[f.name])
        elif method == "hot_vector":
            out = hot_vector(out, f.name, fitted.lookups[f.name])
        elif method == "hash":
            out = hashed(out, f.name)
        elif method == "binary":
            out = out.withColumn(f.name, binarize(F.col(f.name)))
        elif method == "bins" and f.name in fitted.bins:
            out = out.withColumn(f.name, equal_width(F.col(f.name), *fitted.bins[f.name]))
        elif method in ("ordinal", "label"):
            whole = f.target or method == "label"
            if f.name in fitted.domains:
                out = out.withColumn(f.name, domain_code(f.name, fitted.domains[f.name]).cast("long" if whole else "double"))
            else:
                out = ordinal(out, f.name, fitted.lookups[f.name], whole)
        elif f.name in fitted.lookups:
            out = attach_code(out, fitted.lookups[f.name], f.name)
    return out


def _scale(df: DataFrame, fitted: FittedSpec) -> DataFrame:
    spec = fitted.spec
    changes = {c: scaled(c, *v) for c, v in fitted.scale.items() if c in df.columns}
    for f in spec.live(df):
        method = spec.method(f, "scale")
        if method in ("l1", "l2") and dict(df.dtypes)[f.name] in NUMERIC:
            changes[f.name] = row_norm([f.name], method)[0]
    return df.withColumns(changes) if changes else df


def apply(df: DataFrame, fitted: FittedSpec) -> DataFrame:
    """Clean scoring rows (batch or stream) with learned constants: every row stays, columns that training dropped go.

    Nulls of ``prev`` and ``next`` fields stay null: a single row has no neighbours.
    """
    out = convert(df.drop(*fitted.spec.omitted(), *fitted.dropped), fitted.spec)
    return _scale(_encode(_fill_known(out, fitted), fitted), fitted)


def clean(df: DataFrame, spec: DatasetSpec, order: str | None = None) -> DataFrame:
    return fit(df, spec, order)[1]


# --- splits and windows -----------------------------------------------------------------------------

def split(df: DataFrame, ratio: float, key: Sequence[str], shuffle: bool = True, order: str | None = None,
          seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: by a hash of the key (repeatable), or the last rows in order."""
    if shuffle:
        draw = F.conv(F.substring(_mixed(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        return df.where(draw >= ratio), df.where(draw < ratio)
    if order is None:
        raise ValueError("an ordered split needs an order column")
    placed = running(df, [], order, {"_rank": F.lit(1)}, {"_size": F.lit(1)})
    late = F.col("_rank") > F.col("_size") - F.floor(F.col("_size") * ratio)
    return placed.where(~late).drop("_rank", "_size"), placed.where(late).drop("_rank", "_size")


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(_mixed(key, seed), *key)


def _mixed(key: Sequence[str], seed: int) -> Column:
    """A hash of key and seed that any engine gives alike."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def sliding_windows(df: DataFrame, order: str, value: str, inputs: int, outputs: int, stride: int = 1,
                    key: str | None = None, period: str | None = None) -> DataFrame:
    """Supervised windows: ``inputs`` values and the ``outputs`` values that follow, every ``stride`` rows.

    Windows are aligned to the end of the series, so the last one ends at the last row.
    """
    keys = [key] if key else []
    span = inputs + outputs
    by = keys or ["_one"]
    keyed = df if keys else df.withColumn("_one", F.lit(0))
    hot = hot_keys(keyed, by)
    ranked = running(keyed, by, order, {"_rank": F.lit(1)}, {"_size": F.lit(1)}, hot)

    def build(w):
        return {"_all": F.collect_list(F.col(value)).over(w.rowsBetween(-(span - 1), 0))}

    rows = over_series(ranked, by, order, build, before=span - 1, period=period, hot=hot)
    kept = rows.where((F.col("_rank") >= span) & (F.pmod(F.col("_size") - F.col("_rank"), F.lit(stride)) == 0))
    return kept.select(*keys, F.col(order), F.slice("_all", 1, inputs).alias("x"),
                       F.slice("_all", inputs + 1, outputs).alias("y"))
