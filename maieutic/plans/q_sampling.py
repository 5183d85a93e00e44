"""Catalogue: sampling, splits and batches over whole ``orders`` / ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from maieutic.operators import sampling as sp
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table
from maieutic.session import scratch_path


def _h(key: str) -> str:
    return f"md5(concat_ws(':', '{sp.DEFAULT_SEED}', CAST({key} AS VARCHAR)))"


_ORDERS_RANK_SQL = f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) AS rk,
  count(*) OVER () AS n FROM orders"""
_SPLIT_SQL = f"""SELECT o_orderkey, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split, rk
FROM ({_ORDERS_RANK_SQL}) r"""


@register(
    "k1_seeded_shuffle",
    f"SELECT o_orderkey, rk AS shuffle_rank FROM ({_ORDERS_RANK_SQL}) r",
)
def q_shuffle_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return sp.hash_rank(o, ["o_orderkey"], rank_col="shuffle_rank").select("o_orderkey", "shuffle_rank")


@register("k1_shuffled_rows", f"SELECT o_orderkey, rk AS shuffle_rank FROM ({_ORDERS_RANK_SQL}) r")
def q_seeded_shuffle(spark, sf_dir):
    """The shuffled rows written in order, and their places read back from the files' order."""
    o = sp.seeded_shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    path = scratch_path(spark, "shuffled")
    o.select("o_orderkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).write.parquet(path)
    back = spark.read.parquet(path)
    sizes = back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = back.join(sizes.select("part", "first", before.alias("before")), "part")
    return placed.select("o_orderkey", (F.col("before") + F.col("at") - F.col("first") + 1).alias("shuffle_rank"))


@register("k3_exact_split", f"SELECT o_orderkey, split FROM ({_SPLIT_SQL}) s")
def q_exact_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return sp.exact_split(o, ["o_orderkey"], test_size=0.2).select("o_orderkey", "split")


@register(
    "k2_per_split_limits",
    f"""WITH s AS ({_SPLIT_SQL}),
p AS (SELECT o_orderkey, split, row_number() OVER (PARTITION BY split ORDER BY
        CASE WHEN split = 'train' THEN {_h('o_orderkey')} ELSE NULL END, o_orderkey) AS pos FROM s)
SELECT o_orderkey, split FROM p WHERE (split = 'train' AND pos <= 1000) OR (split = 'test' AND pos <= 100)""",
)
def q_per_split_limits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    split = sp.exact_split(o, ["o_orderkey"], test_size=0.2)
    out = sp.per_split_limits(split, {"train": 1000, "test": 100, "validation": 50}, ["o_orderkey"])
    return out.select("o_orderkey", "split")


@register(
    "k4_sample_documents",
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) AS rk FROM documents) r
WHERE rk <= 200""",
)
def q_sample_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sp.sample_n(d, 200, ["doc_id"]).select("doc_id")


@register(
    "k9_batches",
    f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) - 1) // 4 AS BIGINT) AS batch
FROM documents""",
)
def q_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sp.assign_batches(d, 4, ["doc_id"]).select("doc_id", "batch")


@register(
    "k9_batches_per_lang",
    f"""SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) - 1) // 8
  AS BIGINT) AS batch FROM documents""",
)
def q_batches_per_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sp.assign_batches(d, 8, ["doc_id"], partition_cols=["lang"]).select("doc_id", "lang", "batch")

