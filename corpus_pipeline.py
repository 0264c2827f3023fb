"""Corpus preparation: quality rules, near duplicates, repeated passages, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing as pack
from lattica.llm import jaccard, quality, substring
from lattica.session import dropped, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.near_duplicate_stage(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold."""
    return substring.substring_stage(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote on its way, and its input, are deleted when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
