"""Order-dependent work without ever placing one unbounded group in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  These helpers use the plain
window only after the row count proves it small enough; otherwise hot keys are cut into ordered chunks,
chunk totals (or halo rows) carry what one chunk must know of its neighbours, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.calendar import bin_index
from plumbline.functions.settings import BROADCAST_BYTES, BROADCAST_ROWS, CHUNK_ROWS, GROUP_ROWS, bound, cut_lineage

SAMPLED = 64          # order values per chunk of a hot key that are looked at to place its boundaries


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which a null key matches a null key; the key columns of the left side remain."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, condition, how).drop(*[f"_r_{k}" for k in keys])


def lookup_join(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Attach one-row-per-key ``side`` (a null key finds the null key's row): broadcast once its rows and bytes
    are known to be few, salted join beyond.

    The size check fetches at most one row more than the bound, and a small side is kept as fetched, so the
    work behind it runs once.
    """
    limit = bound(df.sparkSession, BROADCAST_ROWS)
    head = side.limit(limit + 1).toArrow()
    if head.num_rows <= limit and head.nbytes <= BROADCAST_BYTES:
        return null_safe_join(df, F.broadcast(df.sparkSession.createDataFrame(head, side.schema)), keys, how)
    return salted_join(df, side, keys, how, null_safe=True)


def parts_of(rows: Column, spark) -> Column:
    """Parts that a key with so many rows is cut into, so that none holds much over ``plumbline.groupRows``."""
    return F.ceil(rows / bound(spark, GROUP_ROWS)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi join (inner, left) that spreads the rows of hot left keys, each over as many tasks as its rows need.

    The salt mixes the row's content with its input partition: copies of one row spread too, and a task that
    is run again gives the same salts.  Left rows without a key match nothing in the plain form and are spread.
    """
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot = hot_keys(left if null_safe else left.where(~blank), keys)
    if hot is None and (null_safe or how == "inner"):
        return null_safe_join(left, right, keys, how) if null_safe else left.join(right, list(keys), how)
    content = F.xxhash64(*[F.col(c) for c, t in left.dtypes if "map<" not in t], F.spark_partition_id())
    copies, salted = right.withColumn("_salt", F.lit(0).cast("long")), left.withColumn("_parts", F.lit(1))
    if hot is not None:
        flags = F.broadcast(hot.select(*keys, parts_of(F.col("_n"), left.sparkSession).alias("_parts")))
        salted = null_safe_join(left, flags, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1).cast("array<long>")
        copies = null_safe_join(right, flags, keys, "left").withColumn("_salt", F.explode(every)).drop("_parts")
    salt = F.pmod(content, F.col("_parts"))
    if not null_safe:
        salt = F.when(blank, content).otherwise(salt)
    salted = salted.withColumn("_salt", salt).drop("_parts")
    on = [*keys, "_salt"]
    joined = null_safe_join(salted, copies, on, how) if null_safe else salted.join(copies, on, how)
    return joined.drop("_salt")


LOOK = "look"    # find the hot keys here; callers that know them pass them on


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than a task should hold, with their counts.

    There are fewer than the table's rows divided by ``plumbline.groupRows``; that bounds what joins with them broadcast.
    """
    limit = bound(df.sparkSession, GROUP_ROWS)
    if df.count() <= limit:
        return None
    found = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit))
    return None if found.isEmpty() else found


def with_chunks(df: DataFrame, keys: Sequence[str], order: str, hot: DataFrame) -> DataFrame:
    """Add ``_o_chunk``: an order-preserving cut of each hot key; other keys stay whole in chunk 0.

    A key is cut into a power of two of chunks, at least as many as its rows need.  Boundaries come from a content
    hash, so a recomputed task always sees the same cut.  Any boundaries give exact results; they only balance the work.
    """
    needed = F.log2(parts_of(F.col("_n"), df.sparkSession)) + 1
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_n",
                                 F.pow(F.lit(2.0), F.ceil(needed)).cast("int").alias("_chunks")))
    on_hot = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True))
    picked = (df.select(*keys, order).join(hot, on_hot)
              .where(F.pmod(F.xxhash64(*keys, order), F.col("_n")) < F.col("_chunks") * SAMPLED))
    lists = (picked.groupBy(*[f"_h_{k}" for k in keys], "_chunks")
             .agg(F.array_sort(F.collect_set(order)).alias("_values")))
    place = F.transform(F.sequence(F.lit(1), F.col("_chunks") - 1),
                        lambda i: F.element_at("_values", (F.floor((F.size("_values") - 1) * i / F.col("_chunks")) + 1).cast("int")))
    halves = F.transform(F.sequence(F.lit(1), F.round(F.log2("_chunks")).cast("int")),
                         lambda i: (F.col("_chunks") / F.pow(F.lit(2.0), i)).cast("int"))
    bounds = F.broadcast(lists.where(F.size("_values") > 0).select(*[F.col(f"_h_{k}") for k in keys], place.alias("_bounds"), halves.alias("_halves")))
    search = F.aggregate("_halves", F.lit(0), lambda at, step: at + F.when(
        F.element_at("_bounds", at + step) <= F.col(order), step).otherwise(F.lit(0)))
    return (df.join(bounds, on_hot, "left")
            .withColumn("_o_chunk", F.when(F.col("_bounds").isNull() | F.col(order).isNull(), F.lit(0)).otherwise(search))
            .drop("_bounds", "_halves", *[f"_h_{k}" for k in keys]))


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column],
            totals: dict[str, Column] | None = None, hot: DataFrame | None | str = LOOK) -> DataFrame:
    """Running sums up to and including each row (``order`` unique per key) and key totals."""
    totals = totals or {}
    keyed = df if keys else df.withColumn("_o_all", F.lit(0))
    by = list(keys) or ["_o_all"]
    hot = hot_keys(keyed, by) if hot is LOOK else hot
    if hot is None:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        out = keyed.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()],
                           *[F.sum(c).over(whole).alias(n) for n, c in totals.items()])
        return out.drop("_o_all")
    cut = with_chunks(keyed, by, order, hot)
    parts = cut.groupBy(*by, "_o_chunk").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
                                           *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    before = Window.partitionBy(*by).orderBy("_o_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_o_chunk",
                           *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
                           *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(n) for n in totals])
    inside = Window.partitionBy(*by, "_o_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_w_{n}") for n, c in sums.items()])
    offsets = offsets.select(*[F.col(k).alias(f"_p_{k}") for k in [*by, "_o_chunk"]],
                             *[f"_o_{n}" for n in sums], *totals)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in [*by, "_o_chunk"]])
    joined = local.join(offsets, condition)
    return joined.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums], *totals)


def over_series(df: DataFrame, keys: Sequence[str], order: str, build: Callable[[WindowSpec], dict[str, Column]],
                before: int = 0, after: int = 0, period: str | None = None, hot: DataFrame | None | str = LOOK) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    With ``period`` the rows are the full calendar of that period, so a row's place follows from its time
    and long series are cut into chunks with halo rows in one shuffle.  Without it, places are running
    counts, computed only when some series is too long for one task.
    """
    if period is None:
        keyed = df if keys else df.withColumn("_o_all", F.lit(0))
        by = list(keys) or ["_o_all"]
        hot = hot_keys(keyed, by) if hot is LOOK else hot
        if hot is None:
            w = Window.partitionBy(*by).orderBy(order)
            return keyed.select("*", *[c.alias(n) for n, c in build(w).items()]).drop("_o_all")
        placed = running(df, keys, order, {"_o_place": F.lit(1)}, hot=hot)
    else:
        placed = df.withColumn("_o_place", bin_index(F.col(order), period))
    size = max(bound(df.sparkSession, CHUNK_ROWS), 4 * (before + after), 1)
    own = F.floor(F.col("_o_place") / size)
    at = F.pmod(F.col("_o_place"), F.lit(size))
    parts = F.array_compact(F.array(own, F.when(at >= size - before, own + 1), F.when(at < after, own - 1)))
    halo = placed.withColumn("_o_own", own).withColumn("_o_part", F.explode(parts))
    w = Window.partitionBy(*keys, "_o_part").orderBy(order)
    out = halo.select("*", *[c.alias(n) for n, c in build(w).items()])
    return out.where(F.col("_o_own") == F.col("_o_part")).drop("_o_place", "_o_own", "_o_part")


def carry(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], backward: bool = False,
          hot: DataFrame | None | str = LOOK) -> DataFrame:
    """Fill nulls from the nearest earlier (or later) non-null value of the series, over any distance.

    Looking ahead is looking back in descending order: a growing frame costs one step per row, a frame that
    ends at the last row would be read again for every row.
    """
    keyed = df if keys else df.withColumn("_o_all", F.lit(0))
    by = list(keys) or ["_o_all"]
    hot = hot_keys(keyed, by) if hot is LOOK else hot
    turned = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    if hot is None:
        w = Window.partitionBy(*by).orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, 0)
        return keyed.withColumns({c: F.last(c, True).over(w) for c in columns}).drop("_o_all")
    cut = with_chunks(keyed, by, order, hot)
    pick = F.max_by if not backward else F.min_by
    edge = cut.groupBy(*by, "_o_chunk").agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_e_{c}")
                                              for c in columns])
    across = Window.partitionBy(*by).orderBy(turned("_o_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*[F.col(k).alias(f"_p_{k}") for k in [*by, "_o_chunk"]],
                       *[F.last(f"_e_{c}", True).over(across).alias(f"_c_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_o_chunk").orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({c: F.last(c, True).over(inside) for c in columns})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in [*by, "_o_chunk"]])
    joined = local.join(edge, condition)
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in columns else F.col(c)
                           for c in df.columns])


def carry_both(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], backward: bool = False) -> DataFrame:
    """``carry`` and then the other way round for the open end; the size is looked at once."""
    hot = hot_keys(df if keys else df.withColumn("_o_all", F.lit(0)), list(keys) or ["_o_all"])
    return carry(carry(df, keys, order, columns, backward, hot), keys, order, columns, not backward, hot)


VALUES = 1 << 18      # rows of a bin from which it is divided further; below, its values are counted
PARTS = 1 << 16       # parts that a bin is divided into


def coarse_bin(x: Column) -> Column:
    """A long that never falls as ``x`` rises: 32 bins for each power of two, one each for 0, the infinities and NaN."""
    size = F.abs(x)
    place = F.when(size == float("inf"), F.lit(1 << 18)).otherwise(F.floor(F.log2(size) * 32) + (1 << 16))
    return F.when(F.isnan(x), F.lit(1 << 19)).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * place).cast("long")


def _quantiles(rows: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles ``q`` of the doubles ``_q_v``, one row per key.

    A histogram by magnitude, under 2^18 bins per key, narrows each wanted rank to one bin, with its least and greatest
    value.  A bin of one value is settled; of a bin of few rows the values are counted; any other is divided evenly
    into 2^16 parts, which are bins again.  A bin spans a 32nd of a power of two, so after three divisions its doubles
    are told apart: there are at most five passes, for any number of columns and keys.  Histograms combine before they are
    shuffled, so a hot key costs no more than its bins, and no task holds more than a key's bins or a bin's values.
    """
    by = list(keys) or ["_q_all"]
    rows = rows.where(F.col("_q_v").isNotNull()).withColumns({} if keys else {"_q_all": F.lit(0)}).withColumn("_q_bin", coarse_bin(F.col("_q_v")))
    counts = [F.count(F.lit(1)).alias("_q_n"), F.min("_q_v").alias("_q_lo"), F.max("_q_v").alias("_q_hi")]
    spots = [(F.col("_q_total") - 1) * F.lit(float(p)) for p in probs]
    ranks = [f(s).cast("long") for s in spots for f in (F.floor, F.ceil)]
    held = [(F.col("_q_below") <= r) & (r < F.col("_q_below") + F.col("_q_n")) for r in ranks]
    wanted = reduce(lambda a, b: a | b, held, F.lit(False))
    one, few = F.col("_q_lo") == F.col("_q_hi"), F.col("_q_n") <= VALUES

    def inside(bins: DataFrame, many: int) -> DataFrame:
        """The rows in the bins; the bins of one key that share a coarse bin are few and do not overlap."""
        named = bins.select(*[F.col(c).alias(f"_b_{c}") for c in [*by, "_q_bin"]], "_q_lo", "_q_hi", F.col("_q_below").alias("_q_ahead"), "_q_total")
        match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.col("_q_bin") == F.col("_b__q_bin"))
        named = F.broadcast(named) if many <= bound(rows.sparkSession, BROADCAST_ROWS) else named
        return rows.join(named, match & F.col("_q_v").between(F.col("_q_lo"), F.col("_q_hi")))

    def upto(counted: DataFrame, part: str, *more: str) -> DataFrame:
        order = Window.partitionBy(*by, "_q_bin", "_q_lo").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
        return counted.withColumn("_q_below", F.sum("_q_n").over(order) - F.col("_q_n") + F.col("_q_ahead")).select(*by, "_q_bin", "_q_n", "_q_below", "_q_total", *more)

    def settled(frame: DataFrame) -> tuple[DataFrame, int, int]:
        """Bins, kept on the driver where few, and how many of them are to be counted and to be divided."""
        limit = bound(rows.sparkSession, BROADCAST_ROWS)
        head = frame.limit(limit + 1).toArrow()
        if head.num_rows > limit:
            frame = cut_lineage(frame)
            return frame, *frame.agg(F.count_if(~one & few), F.count_if(~one & ~few)).first()
        wide = [n for n, lo, hi in zip(*(head[c].to_pylist() for c in ("_q_n", "_q_lo", "_q_hi"))) if lo < hi]
        return rows.sparkSession.createDataFrame(head, frame.schema), sum(n <= VALUES for n in wide), sum(n > VALUES for n in wide)

    whole = Window.partitionBy(*by)
    first = rows.groupBy(*by, "_q_bin").agg(*counts)
    before = F.sum("_q_n").over(whole.orderBy("_q_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_q_n")
    bins, small, large = settled(first.select("*", before.alias("_q_below"), F.sum("_q_n").over(whole).alias("_q_total")).where(wanted))
    found = []
    while True:
        found.append(bins.where(one).select(*by, F.col("_q_lo").alias("_q_v"), "_q_n", "_q_below", "_q_total"))
        if small:
            counted = inside(bins.where(~one & few), small).groupBy(*by, "_q_bin", "_q_lo", "_q_ahead", "_q_total", "_q_v").agg(counts[0])
            found.append(upto(counted, "_q_v", "_q_v").select(*by, "_q_v", "_q_n", "_q_below", "_q_total"))
        if not large:
            break
        part = F.floor((F.col("_q_v") - F.col("_q_lo")) / (F.col("_q_hi") - F.col("_q_lo")) * PARTS)
        divided = inside(bins.where(~one & ~few), large).withColumn("_q_part", part) \
            .groupBy(*by, "_q_bin", "_q_lo", "_q_ahead", "_q_total", "_q_part").agg(counts[0], F.min("_q_v").alias("_q_least"), F.max("_q_v").alias("_q_most"))
        divided = upto(divided, "_q_part", F.col("_q_least").alias("_q_lo"), F.col("_q_most").alias("_q_hi"))
        bins, small, large = settled(divided.where(wanted))
    values = reduce(DataFrame.unionByName, found)
    picked = values.groupBy(*by).agg(F.max("_q_total").alias("_q_total"), *[F.max(F.when(h, F.col("_q_v"))).alias(f"_r{i}") for i, h in enumerate(held)])
    q = [F.when(F.col(f"_r{2 * i}") == F.col(f"_r{2 * i + 1}"), F.col(f"_r{2 * i}"))
         .otherwise(F.col(f"_r{2 * i}") + (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}")) * (s - F.floor(s))) for i, s in enumerate(spots)]
    return picked.select(*keys, F.array(*q).alias("q"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key as ``q`` (array), one row per key that has values."""
    return _quantiles(df.select(*keys, F.col(value).cast("double").alias("_q_v")), keys, probs)


def _unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("_q_v")) for c in columns]
    return df.select(*keys, F.inline(F.array(*pairs)))


def quantile_values(df: DataFrame, value: str | Column, probs: Sequence[float]) -> list[float | None]:
    """Quantiles of a whole column as driver numbers (one row)."""
    column = F.col(value) if isinstance(value, str) else value
    row = quantiles(df.select(column.cast("double").alias("_v")), [], "_v", probs).first()
    return list(row["q"]) if row is not None and row["q"] is not None else [None] * len(probs)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their tie-averaged rank: (value, rank, n)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, [], value, {"_upto": F.col("n")})
    return ranked.select(value, (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"), "n")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Exact quantiles of several whole columns as driver numbers, in as many passes as one column takes."""
    found = {r["name"]: list(r["q"]) for r in _quantiles(_unpivoted(df, [], columns), ["name"], probs).collect()} if columns else {}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per key and numeric column: count, mean, std, min, max, variance and quantiles ``q``."""
    def summary(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("name"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                        F.min(v).alias("min"), F.max(v).alias("max"), F.var_samp(v).alias("variance"))

    moments = (df.groupBy(*keys).agg(F.array(*[summary(c) for c in columns]).alias("_all"))
               .select(*keys, F.inline("_all")))
    return lookup_join(moments, _quantiles(_unpivoted(df, keys, columns), [*keys, "name"], probs), [*keys, "name"])
