"""Registered queries of the subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import alignment, byte_bpe, hard_negatives, lines, mixing, nearest, personal, quality, simhash, substrings, token_files, urls, vector_dedup
from plumbline.llm.common import table


def _documents(operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: operator(table(spark, folder, "documents"))


def _embeddings(operator: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: operator(table(spark, folder, "embeddings"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.op4_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return urls.op6_url_filters(table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _documents(simhash.op1_simhash),
    "op2_nearest": _embeddings(nearest.op2_nearest),
    "op3_embedding_dedup": _embeddings(vector_dedup.op3_embedding_dedup),
    "op4_quality": _quality,
    "op5_substring_dedup": _documents(substrings.op5_substring_dedup),
    "op6_url_filters": _pages,
    "op7_byte_bpe": _documents(byte_bpe.op7_byte_bpe),
    "op8_token_files": _documents(token_files.op8_token_files),
    "op9_line_dedup": _documents(lines.op9_line_dedup),
    "op10_mix_sources": _documents(mixing.op10_mix_sources),
    "op11_token_alignment": _documents(alignment.op11_token_alignment),
    "op12_hard_negatives": _embeddings(hard_negatives.op12_hard_negatives),
    "op13_personal_data": _documents(personal.op13_personal_data),
}

ORACLE_SQL = {
    "op2_nearest": nearest.OP2_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_token_alignment": _documents(alignment.op11_token_alignment),
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
