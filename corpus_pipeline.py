"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphquarry.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from graphquarry.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the posterior calls bad go."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays."""
    return line_dedup.without_repeated_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays; rows without words all stay."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; smaller benchmark passages are cut from the others."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: shard, slot, source, block, doc_ids, n_words, text."""
    return mixing.Mix(docs, texts=True).blocks()


STAGES = [("quality", quality_rules), ("line_dedup", line_deduplication), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mix)]

#: EM and fuzzy groups can't be said in SQL; tests/llm/test_pipeline.py holds ngram_jaccard and run() against brute force on null and repeated ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
