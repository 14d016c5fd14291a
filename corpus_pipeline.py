"""Corpus preparation: language ID, near-duplicates, repeated passages, mixing, encoding.

``run`` applies all stages to ``documents``, each written as Parquet in the shared folder and read again by the next.
These stages cannot be stated in SQL, so there is none for the whole; tests hold it against plain
Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import materialise, read_table
from millrace.llm.pipeline_stages import stage_encode, stage_language, stage_mixing, stage_near_duplicates, stage_repeated_passages

STAGES = [
    ("language_id", stage_language),
    ("minhash_near_dedup", stage_near_duplicates),
    ("suffix_array_dedup", stage_repeated_passages),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_encode),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
