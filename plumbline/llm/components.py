"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settings import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node reachable.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest node that it
    sees.  Links only ever move towards smaller nodes, so the rounds needed grow with the logarithm of the longest
    chain.  The minimum per node is combined before the shuffle and joined back by node, a plain equi join whose hot
    nodes adaptive execution splits.  Each round ends in the shared checkpoint folder; nothing but two sums per round
    reaches the driver.
    """
    def state(frame: DataFrame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = cut_lineage(links)
    last = state(links)
    while last[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = larger.where("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = cut_lineage(smaller.where("a <> b").distinct())
        now = state(links)
        if now == last:
            break
        last = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
