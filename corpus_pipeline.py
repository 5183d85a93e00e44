"""The training-data pipeline over ``documents``: quality rules, near-duplicates, decontamination, mixing, records.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maieutic.llm.binary_records import write_index, write_records
from maieutic.llm.common import free_name, fresh_path, written
from maieutic.llm.cutting import row_key
from maieutic.llm.decontaminate import drop_contaminated
from maieutic.llm.mixing import mixed_documents
from maieutic.llm.near_dup import near_duplicates
from maieutic.llm.quality_rules import judge_quality
from maieutic.llm.queries import VOCABULARY, table, tokenizer_path


def own_columns(docs: DataFrame) -> list:
    """The input's columns, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdict = free_name(docs.columns, "verdict")
    judged = judge_quality(docs, keep_columns=True, verdict_col=verdict)
    return judged.where(F.col(verdict)).select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    found = near_duplicates(docs, shingle=5, threshold_pct=80)
    key, stays = free_name(docs.columns, "key"), free_name(docs.columns, "stays")
    staying = found.where("stays").select(F.col("row_key").alias(stays))
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    # Rows that repeat id and text share a key; one of them is enough.
    left = keyed.join(staying, F.col(key) == F.col(stays), "left_semi").dropDuplicates([key])
    return left.select(*own_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item, with an id or without."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10, unnamed=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights, at most three epochs each."""
    return mixed_documents(docs, max_epochs=3, seed=17)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id records on disk; returns their index."""
    path = fresh_path(spark, "pipeline-records")
    write_records(docs, path, tokenizer_path(VOCABULARY), end_id=2)
    return write_index(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", records),
]

# The encoded ids of the last stage cannot be stated in SQL; tests/llm compares a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the record index."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
