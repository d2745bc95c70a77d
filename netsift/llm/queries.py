"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.session import shared_folder, ship

from . import bpe, collocations, cover_tree, html_extract, language_id, line_quality, mixing, ngram_join, secret_scan, spelling, token_counts, tool_calls, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    filters = language_id.fit(spark, documents.where(~held & F.col("lang").isNotNull()))
    return language_id.predict(spark, documents, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, _table(spark, sf_dir, "pages"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(spark, _table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, _table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.predict(spark, documents, toxicity.fit(spark, documents, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, _table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of(_table(spark, sf_dir, "conversations"))
    return tool_calls.link(spark, calls, results, tool_calls.schema_table(spark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, _table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of this query belongs to the table's folder and ends with the application."""
    cache = f"{shared_folder(spark)}/token-counts-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts.count(spark, _table(spark, sf_dir, "documents"), WORD_VOCABULARY, cache)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_cover_tree": op4_cover_tree,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_tool_calls": op10_tool_calls,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_token_counts": op13_token_counts,
}

ORACLE: dict[str, str] = {"op6_quality": line_quality.ORACLE, "op11_collocations": collocations.ORACLE}
