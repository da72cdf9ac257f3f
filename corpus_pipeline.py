"""The corpus pipeline: rate, deduplicate, decontaminate, mix, write token records.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again for the next one. All
but the last return the columns of ``documents``, whatever these are called.
Empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import decontam, mixing, neardup, quality, queries, records
from strandwise.llm.common import cut, shared_dir, table

#: SQL expresses neither the classifier nor the tokenizer; tests/llm has plain versions.
ORACLE_SQL = None
#: Percent of Jaccard similarity at which near_dedup links; op5's 85 is of its query alone.
SIMILAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is quality.KEEP or
    more. Nulls and empty texts are rated as texts without words."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity 0.8 or
    more): that of the smallest id. Documents without words are no group and stay;
    rows that repeat an id go by their texts; null ids come last."""
    return neardup.representatives(docs, percent=SIMILAR)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows of null ids stay, and rows
    that share an id go together."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes most of their words: once for every
    turn of their source's stream in which half of them or more is scheduled.
    Documents without words are never scheduled."""
    return mixing.repeated(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Record files of the documents' ids, read back: a row for each record."""
    folder = shared_dir(spark)
    records.write_records(docs, folder, queries.vocabulary(), queries.END_ID)
    return records.read_records(spark, folder)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontaminate", without_benchmarks), ("mix", mixed), ("records", token_records)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"{work}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
