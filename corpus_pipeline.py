"""The corpus pipeline: from raw documents to packed training sequences.

Quality rules, SimHash near-duplicates, near-duplicate passages, personal data,
packing. Every stage works on all that the one before kept; between stages the
documents are written as Parquet and read again, so a stage's work is bounded by
its own plan. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import packing, pii, quality, shared, simhash, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a similarity of 0.8) the document with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut out of their texts."""
    return substring.remove_passages(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are generalised and the terms that disclose them removed."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a smaller table of chunks and no vocabulary that outlasts a task, as the
    workers of all stages share the executors."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), table_rows=60_000, keep_vocabulary=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: Medians, tokenizers, windows and components: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
