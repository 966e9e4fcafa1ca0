"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. An empty table gives an empty result;
further columns of any name are carried by all stages but the last; repeated rows are
settled by the exact stage, and very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viamark.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from viamark.llm.common import collecting, drop_paths, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; a null text has no words and goes, a null doc_id may stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays: the longest, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; every document stays."""
    return substring_dedup.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 ids."""
    return packing.pack(docs).drop("row_id", "ids")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("n-gram join", near), ("substring dedup", repeats), ("packing", pack)]
#: MinHash, chunking and tokenising have no SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage left between its steps goes when its rows have been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        with collecting() as between:
            out = work(spark, docs, sf_dir)
        docs = stage(out, name.replace(" ", "-"))
        drop_paths(spark, between)
    return STAGES[-1][1](spark, docs, sf_dir)
