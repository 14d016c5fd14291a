"""Stages of the corpus pipeline; each takes and returns a documents table, the last one returns encoded rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, near_dup, sentencepiece_codec, suffix_dedup
from millrace.llm.common import held_out, read_table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op9 calls ``und`` go: those without a letter, or all if no language can be learned."""
    return language_id.keep_identified(docs, held_out(F.col("doc_id")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 or more on five words stays: the one with the smallest id."""
    return near_dup.keep_one(docs, width=5)


def stage_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out; a document of which nothing is left goes."""
    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted rates do not draw go."""
    return mixing.keep_drawn(docs, read_table(spark, sf_dir, "labels"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
