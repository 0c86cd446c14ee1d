"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage
from plumbline.llm.common import same, word_count

WEIGHTS = (3, 1, 2)    # of the sources in code point order, repeating
SHARE = 1.5            # of all words, the mix takes
MOST = 2.0             # copies of one document at most
LINE = 128             # documents of one counting line, about
GROUP = 1024           # lines that are added up before the lines of a source are


def fraction(text: Column) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source_size and target.

    The sources share ``share`` of all sizes by weight; none gets over ``most`` times its size, and the excess is
    shared among the others by weight.  Sources fill up in the order of most * size / weight, so the level at which
    the rest is shared follows from running sums over the table of sources (one row each).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weigh)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(everything) * F.lit(share) \
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the right level fills exactly the sources that it fills; counting others as full, or not, only lowers it
    level = F.max("level").over(everything)
    return ranked.withColumn("level", rest / open_weight).select(
        "source", "source_size", F.least(F.col("source_size") * F.lit(most), level * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies; one row per row.

    Method: a document of a source expects target / source_size copies.  The documents of a source stand in order of
    their size class and then of a hash of doc_id and text; expected copies are summed up along that order, one offset per
    source is added, and a document is taken once per integer that its stretch of the sum crosses.  Order by size
    keeps the words taken near the target: the classes are hit evenly, so the error is about one large document.

    The running sum needs the place of a document in its source.  It is the sum of three counts: lines before it in
    its group of lines, groups before it in its source, documents before it in its line.  Lines are stretches of the
    hash of about ``LINE`` documents, so no task ever holds a whole source.

    Null texts have size 0; documents of size 0 are taken like others.  A null source is one source, last in order.
    Rows without a doc_id, or that repeat one, are told apart by their texts, so they spread over lines like others;
    rows equal in both are interchangeable, and only these share a line of any length.  Empty input gives no rows.
    Only doc_id, text and source are read; further columns are ignored.
    """
    return _copies(docs, weights, share, most, seed).drop("digest")


def _copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """``copies`` with the digest of each row's text."""
    keyed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    shift = F.greatest(F.length(F.bin("size")) - 5, F.lit(0))
    keyed = keyed.withColumn("unit", F.pow(F.lit(2.0), shift).cast("long")) \
        .withColumn("class", (F.floor(F.col("size") / F.col("unit")) * F.col("unit")).cast("long")).drop("unit") \
        .withColumn("hash", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest"))))
    keyed = cut_lineage(keyed)
    per_class = keyed.groupBy("source", "class").agg(F.count("*").alias("class_rows")) \
        .select(F.col("source").alias("c_source"), F.col("class").alias("c_class"),
                F.ceil(F.col("class_rows") / LINE).alias("lines"))
    lined = keyed.join(per_class, same("source", "c_source") & same("class", "c_class")) \
        .withColumn("line", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.col("lines") / (1 << 32)).cast("long")) \
        .drop("c_source", "c_class", "lines")
    line = lined.groupBy("source", "class", "line").agg(F.count("*").alias("n")) \
        .withColumn("group", F.floor(F.col("line") / GROUP))
    group = line.groupBy("source", "class", "group").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    starts = group.withColumn("start", F.sum("n").over(Window.partitionBy("source").orderBy("class", "group").rowsBetween(*before)))
    inner = line.withColumn("inside", F.sum("n").over(Window.partitionBy("source", "class", "group").orderBy("line").rowsBetween(*before)))
    offsets = inner.alias("l").join(starts.alias("s"), F.expr("l.source <=> s.source AND l.class = s.class AND l.group = s.group")) \
        .selectExpr("l.source AS o_source", "l.class AS o_class", "l.line AS o_line",
                    "coalesce(l.inside, 0) + coalesce(s.start, 0) AS offset")
    placed = lined.withColumn("rank", F.row_number().over(Window.partitionBy("source", "class", "line").orderBy("hash", "doc_id", "size"))) \
        .join(offsets, same("source", "o_source") & same("class", "o_class") & same("line", "o_line"))
    goal = targets(keyed, weights, share, most).withColumnRenamed("source", "t_source")
    end = F.col("offset") + F.col("rank")
    start = fraction(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("source"), F.lit("\0null"))))
    out = placed.join(goal, same("source", "t_source")) \
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))) \
        .withColumn("copies", (F.floor(end * F.col("rate") + start) - F.floor((end - 1) * F.col("rate") + start)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "digest")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Documents are matched by doc_id, source and text.  Rows that are equal in these share the copies that ``copies``
    gave them, one by one, so that each still stands as often as it was taken.
    """
    names = docs.columns
    taken = _copies(docs, **options).groupBy("doc_id", "source", "digest") \
        .agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows")).where("__mix_copies > 0") \
        .selectExpr("doc_id AS __mix_doc", "source AS __mix_source", "digest AS __mix_text", "__mix_copies", "__mix_rows")
    taken = cut_lineage(taken)
    sized = docs.withColumn("__mix_n", F.md5(F.coalesce("text", F.lit(""))))
    match = same("doc_id", "__mix_doc") & same("source", "__mix_source") & (F.col("__mix_n") == F.col("__mix_text"))
    alone = sized.join(taken.where("__mix_rows = 1"), match).withColumn("__mix_times", F.col("__mix_copies"))
    order = Window.partitionBy("__mix_doc", "__mix_source", "__mix_text").orderBy("__mix_n")
    several = sized.join(taken.where("__mix_rows > 1"), match).withColumn("__mix_row", F.row_number().over(order)) \
        .withColumn("__mix_times", F.expr("__mix_copies div __mix_rows + CAST(__mix_row <= __mix_copies % __mix_rows AS long)")) \
        .where("__mix_times > 0").drop("__mix_row")
    joined = alone.union(several)
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*names)


def op10_mix_sources(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = """
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2.0::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
classed AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE (size >> (length(bin(size)) - 5)) << (length(bin(size)) - 5) END AS class,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || digest) AS hash FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, hash, doc_id, size) AS place FROM classed),
rated AS (
  SELECT p.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(p.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (floor(place * rate + start) - floor((place - 1) * rate + start))::BIGINT * size AS taken FROM rated
"""
