"""A training-data pipeline: rules, classifier, near-duplicates, repeated passages, packing.

Each stage takes what its predecessor kept, as written to Parquet and read back; all but the
last return the columns of ``documents``.  The stages' own docstrings say how they treat nulls,
empty texts and repeated rows; an empty table passes through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txlog.llm import jaccard_join, packing, perplexity, quality_rules, substring_dedup
from txlog.llm.common import documents, materialize, scratch_scope


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality_rules.keep_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not unusual for their language."""
    return perplexity.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return jaccard_join.keep_documents(docs, width=5, percent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover."""
    return substring_dedup.dedup_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_join_stage),
    ("substring_dedup", substring_dedup_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier's model or the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch_scope():  # what the stage leaves behind goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
