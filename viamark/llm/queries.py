"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viamark.llm import byte_bpe, collocations, decontaminate, exact_dedup, license_scan, lm_score, negatives, ngram_join, packing, quality, sharding, substring_dedup, token_count


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the smallest doc_id of its group and its number of links."""
    found = ngram_join.resolve(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("group_id").alias("class_id"), "n_links")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_read(spark, sf_dir, "documents"), digests=True).drop("row_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents")).drop("row_id", "ids")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(_read(spark, sf_dir, "documents")).drop("row_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document: words in repeated runs, words that go, and the text that remains."""
    return substring_dedup.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), facts=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_lm_score, op3_exact_dedup, op4_ngram_join, op5_sharding, op6_byte_bpe, op7_quality_rules, op8_packing, op9_token_counts, op10_substring_dedup,
        op11_collocations, op12_decontaminate, op13_hard_negatives,
    )
}
