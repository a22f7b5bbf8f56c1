"""A training corpus from ``documents``: stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracesift.llm import decontaminate, neardup, packing, paragraphs, quality
from tracesift.llm.common import table
from tracesift.llm.queries import tokenizer_path
from tracesift.session import written_once


def quality_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops what the classifier rejects; it learns from the labelled documents among ``docs``."""
    return quality.accepted(docs, quality.train(docs, table(spark, folder, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return paragraphs.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", pack),
]

#: The stages hold models and components, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
