"""Inputs of the catalogue queries, read from (or derived by Spark from) the driver tables.

No text of the driver tables contains a ``?``, so the behaviour rules would
never fire on them.  ``responses`` derives one response per order with a plain
SQL ``CASE`` over templates; the expression is valid Spark SQL and DuckDB SQL,
so the query and its oracle see identical text.  Every order yields a
response: the work grows with ``orders``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """A driver table; ``spread`` names the id column to deal CPU-heavy row work by (see ``spread_rows``)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread_rows(df, spread) if spread else df


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by the hash of their id over the shuffle partitions, at every size.

    For CPU-bound row work (regex rules, tokenising, span decoding: about 1 MB/s
    per core) an exchange of the rows costs little, evens out files of any size, and
    gives the partitioning by id that the token plans need anyway.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def spread_if_few(df: DataFrame, key: str) -> DataFrame:
    """``spread_rows`` where the files come in fewer pieces than there are cores; otherwise the rows stay, as the exchange takes disk."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return spread_rows(df, key) if few else df


_K = "CAST(o_custkey % 50 + 1 AS STRING)"
_K2 = "CAST(o_custkey % 50 + 6 AS STRING)"

RESPONSE_TEXT_SQL = f"""CASE o_orderkey % 12
  WHEN 0 THEN 'Where do you expect the ripple to peak once the load draws ' || {_K} || ' mA?'
  WHEN 1 THEN 'Conclusion: try ' || {_K} || 'k ohm and leave the rail at 5V.'
  WHEN 2 THEN 'Why does the ' || lower(o_orderpriority) || ' path ring? Which node would you probe first?'
  WHEN 3 THEN '1. Measure the rail.' || chr(10) || '2. Compare it with ' || {_K} || ' V.' || chr(10) || '3. Report back.'
  WHEN 4 THEN 'How would you check the ' || o_orderstatus || ' state? Could the clock be at ' || {_K} || '-' || {_K2} || ' kHz?'
  WHEN 5 THEN ''
  WHEN 6 THEN {_K} || ' to ' || {_K2}
  WHEN 7 THEN '   '
  WHEN 8 THEN 'The answer is ' || o_orderstatus || '. Therefore, pick ' || {_K} || ' ohm.'
  WHEN 9 THEN '- Is it the load?' || chr(10) || '- Is it the source?' || chr(10) || '- Is it the wire?'
  WHEN 10 THEN 'Consider the ripple. Remove the cap and add ' || {_K} || ' pF? ' || o_orderpriority
  ELSE 'Keep the ratio < ' || {_K} || ' and think about why.'
END"""

# Training step of a response (multiples of 50 from 0 to 450) and its run.
RESPONSE_STEP_SQL = "CAST((o_orderkey % 10) * 50 AS INT)"
RESPONSE_RUN_SQL = "'run-' || CAST(o_custkey % 3 AS STRING)"

RESPONSES_SELECT_SQL = f"""SELECT o_orderkey AS response_id, o_custkey AS prompt_id, o_orderpriority AS priority,
  o_orderstatus AS status, {RESPONSE_RUN_SQL} AS run_id, {RESPONSE_STEP_SQL} AS step,
  {RESPONSE_TEXT_SQL} AS text
FROM orders"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(response_id, prompt_id, priority, status, run_id, step, text)``, one row per order."""
    return table(spark, sf_dir, "orders", spread="o_orderkey").select(
        F.col("o_orderkey").alias("response_id"),
        F.col("o_custkey").alias("prompt_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.expr(RESPONSE_RUN_SQL).alias("run_id"),
        F.expr(RESPONSE_STEP_SQL).alias("step"),
        F.expr(RESPONSE_TEXT_SQL).alias("text"),
    )
