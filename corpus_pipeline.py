"""A corpus through quality, line, near-duplicate, mixing and token stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame, which is
written as Parquet in the shared scratch folder and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``.  Documents may have further columns; those stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import lines
from plumbline.llm.byte_bpe import tokenise
from plumbline.llm.common import table, written
from plumbline.llm.mixing import mix
from plumbline.llm.quality import accepted
from plumbline.llm.simhash import drop_near_copies


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on their labels, does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier line matches; n_chars follows the text."""
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints.  Texts left without words are one group."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (32-bit little-endian) of every document."""
    return tokenise(docs, keep=("doc_id", "lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality", keep_good), ("lines", drop_repeated_lines), ("near copies", drop_copies), ("mixing", mix_sources), ("tokens", encode)]

ORACLE_SQL = None    # compressed sizes, SimHash components and BPE merges have no SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
