"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import (
    covertree, decontaminate, htmltext, langid, merkle, neardup, packing, paragraphs, periodic, preference, quality,
    tokencount, toxicity,
)
from tracesift.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return covertree.top_products(vectors.select("vec_id", covertree.floored(F.col("embedding")).alias("v")))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_texts(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identified(docs, langid.learn(docs))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extracted(table(spark, folder, "pages"))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path())


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return preference.formatted(preference.exchanged_replies(table(spark, folder, "conversations")), "conv_id")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(table(spark, folder, "documents"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.counted_documents(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_documents(table(spark, folder, "documents"))


QUERIES = {
    "op1_quality_classifier": quality.score_documents,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": toxicity.score_documents,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB SQL for the rows of a query, where SQL can express it in reasonable time.
ORACLES: dict[str, str] = {
    "op2_exact_top_k": covertree.ORACLE, "op10_chat_formatting": preference.ORACLE, "op13_merkle_manifest": merkle.ORACLE,
}
