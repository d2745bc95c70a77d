"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens; each stage works on what the one before kept.

Stages take documents and return documents (the last one: token digests). What decides inside them is in netsift.llm.
Nulls, empty texts, ties, repeated rows, empty tables and further columns are handled as each operator states; of a group
of near duplicates the row with the group's smallest id stays (of several rows with that id, one with each text); rows
without an id cannot be told apart and stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import bpe, line_quality, mixing, ngram_join, secret_scan
from netsift.session import shared_folder, ship, short_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that lose too much, or fail the base rules, are rejected."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id."""
    groups = ngram_join.classes(spark, docs)
    stays = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(stays, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixture(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.digests(spark, docs, VOCABULARY, public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_short_batches(stage: Stage) -> Stage:
    """The stage, with whole texts going to Python and back in batches that are small in bytes as well as in rows."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [(name, _in_short_batches(stage)) for name, stage in (
    ("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("tokens", tokens))]
ORACLE_SQL = None  # the network, the transducer and the knapsack have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
