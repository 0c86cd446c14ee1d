"""URL filters: host suffixes and path prefixes looked up by short hash prefixes."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import same

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
PREFIX = 8    # hex digits of the digest that the join looks at


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url):
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def judge(urls: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict appended; their columns of these names are replaced.

    ``rules`` has host, path and verdict.  A rule fits its host and all hosts below it where the path of the url
    starts with the rule's path.  The longest rule (host and path together) wins, then the longer host, then the
    verdict first in order of letters, so a rule that is given with both verdicts allows.  No rule: ``default``.

    Method: every distinct url is expanded into (host suffix, path prefix) expressions, with as many labels and
    characters as some rule has, so that nothing is emitted that cannot match.  Expressions meet rules in an equi join
    on the first digits of their SHA-256; the whole digest then decides.  Repeated urls, a host's or a page's, are
    merged before the join; the joins are plain equi joins, which adaptive execution splits where a key is hot.
    Rules are broadcast only where Spark's own size estimate allows it.

    Null urls and urls without ``://`` have no expressions.  Rules with a null part fit nothing; an empty rule host
    fits no url.  The lengths of the rules reach the plan as literals: one number per distinct length.
    """
    kept = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
    shape = kept.select(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    digest = F.sha2(F.concat(F.col("e_host"), F.lit("\n"), F.col("e_path")), 256)
    listed = kept.groupBy("host", "path").agg(F.min("verdict").alias("r_verdict")) \
        .select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "r_verdict") \
        .select(F.substring(digest, 1, PREFIX).alias("r_prefix"), digest.alias("r_digest"), "r_verdict")
    host, path = split_url(F.col("__url"))
    known = urls.select(F.col(column).alias("__url")).where(F.col("__url").isNotNull()).distinct() \
        .withColumn("host", host).withColumn("path", path).where("host <> ''")
    numbers = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<int>")
    labels = known.withColumn("parts", F.split("host", r"\.")) \
        .withColumn("label", F.explode(F.filter(numbers(shape.labels), lambda n: n <= F.size("parts")))) \
        .withColumn("e_host", F.array_join(F.slice("parts", F.size("parts") - F.col("label") + 1, F.col("label")), "."))
    spelled = labels.withColumn("long", F.explode(F.filter(numbers(shape.lengths), lambda n: n <= F.length("path")))) \
        .withColumn("e_path", F.substring("path", F.lit(1), F.col("long"))).withColumn("digest", digest)
    hits = spelled.join(listed, F.substring("digest", 1, PREFIX) == F.col("r_prefix")).where("digest = r_digest")
    best = hits.groupBy("__url").agg(F.min(F.struct(
        (-(F.length("e_host") + F.length("e_path"))).alias("a"), (-F.length("e_host")).alias("b"), F.col("r_verdict").alias("v"),
        F.concat("e_host", "e_path").alias("r"))).alias("__best"))
    host, path = split_url(F.col(column))
    rest = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict") or c == column]
    return urls.select(*rest).join(best, F.col(column) == F.col("__url"), "left") \
        .withColumns({"__host": host, "__path": path}) \
        .select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.r").alias("rule"),
                F.coalesce("__best.v", F.lit(default)).alias("verdict"))


def op6_url_filters(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rule_table(pages.sparkSession)).drop("url")


OP6_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(strpos(url, '://'), 0) AS found, url FROM pages),
cut AS (SELECT page_id, CASE WHEN found > 0 THEN substr(url, found + 3) ELSE '' END AS rest FROM parts),
named AS (
  SELECT row_number() OVER () AS row_no, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(r_host, r_path, r_verdict)),
fitting AS (
  SELECT n.*, r.*, row_number() OVER (PARTITION BY row_no ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC, r_verdict) AS place
  FROM named n LEFT JOIN rules r ON (n.host = r_host OR ends_with(n.host, '.' || r_host)) AND starts_with(n.path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""
