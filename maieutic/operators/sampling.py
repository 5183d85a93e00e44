"""Deterministic sampling, exact-size splits and batching (K1-K4, K9).

Random choices are replaced by **key-hash order**: rows are ordered by
``md5('<seed>:<key>')`` (ties, which need an md5 collision, by the key).  The
order does not depend on partitioning or file order and is reproducible in any
SQL engine.

Exact positions without a global sort: rows are counted per hash bucket (the first
``bucket_hex`` hex digits of the hash, at most 16**4 = 65,536 buckets per
group), and prefix sums over that bounded histogram tell in which bucket the
``k``-th row lies and how many rows come before it.  The k-th row's order key is then the
threshold (one row per group), found among the rows of that one bucket; the
selection itself is a comparison with the threshold, so the data is not shuffled.
A full rank needs a ``row_number`` per bucket, which spreads evenly.

Rows with equal keys are ordered by the hash of all their columns; rows equal in every
column cannot be told apart and are taken or left together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
BUCKET_HEX = 4
#: Samples of at most so many rows (of a group) are kept by every task while it scans, so one scan does.
BOTTOM_K = 100_000


def hash_order_key(key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """``md5('<seed>:<k1>:<k2>...')`` as lowercase hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def order_key(df: DataFrame, key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """What rows are ordered by: key hash, keys, then the hash of the whole row for repeated keys."""
    return F.struct(
        hash_order_key(key_cols, seed).alias("h"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)],
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )


def _bucket(hex_hash: Column, bucket_hex: int) -> Column:
    return F.conv(F.substring(hex_hash, 1, bucket_hex), 16, 10).cast("int")


def _histogram(df: DataFrame, key_cols, seed, partition_cols, bucket_hex) -> DataFrame:
    """``(groups, _b, _n, _before, _total)``: at most 16**bucket_hex rows per group, from a scan of the keys."""
    b = _bucket(hash_order_key(key_cols, seed), bucket_hex).alias("_b")
    hist = df.select(*partition_cols, b).groupBy(*partition_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*partition_cols)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint"),
        "_total": F.sum("_n").over(group).cast("bigint"),
    })


def hash_rank(
    df: DataFrame,
    key_cols: Sequence[str],
    seed: int = DEFAULT_SEED,
    partition_cols: Sequence[str] = (),
    rank_col: str = "rank",
    bucket_hex: int = BUCKET_HEX,
) -> DataFrame:
    """Add the 1-based position of each row in hash order (per ``partition_cols`` group)."""
    hist = _histogram(df, key_cols, seed, partition_cols, bucket_hex)
    x = df.withColumn("_o", order_key(df, key_cols, seed)).withColumn("_b", _bucket(F.col("_o.h"), bucket_hex))
    hist = hist.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)], F.col("_b").alias("_at"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(partition_cols)]  # a null group is a group
    x = x.join(hist, _all([F.col("_b") == F.col("_at"), *same]))
    place = F.row_number().over(Window.partitionBy(*partition_cols, "_b").orderBy("_o"))
    return x.withColumn(rank_col, F.col("_before") + place).select(*df.columns, rank_col)


def seeded_shuffle(df: DataFrame, key_cols: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows in hash order (K1): a range-partitioned sort, only when order is needed."""
    return df.orderBy(hash_order_key(key_cols, seed), *key_cols)


def first_k_threshold(
    df: DataFrame,
    k: Column,
    key_cols: Sequence[str],
    seed: int = DEFAULT_SEED,
    partition_cols: Sequence[str] = (),
    bucket_hex: int = BUCKET_HEX,
) -> DataFrame:
    """``(groups, limit)``: the order key of each group's ``k``-th row (``k`` may use ``_total``).

    A group with fewer rows has the order key of its last one, a group with ``k <= 0`` has no row.
    """
    hist = _histogram(df, key_cols, seed, partition_cols, bucket_hex)
    hist = hist.withColumn("_k", F.least(k.cast("bigint"), F.col("_total")))
    at = hist.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_n")))
    keys = df.select(*partition_cols, order_key(df, key_cols, seed).alias("limit"))
    keys = keys.withColumn("_b", _bucket(F.col("limit.h"), bucket_hex))
    at = at.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)], F.col("_b").alias("_at"), "_before", "_k")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(partition_cols)]  # a null group is a group
    inside = keys.join(at, _all([F.col("_b") == F.col("_at"), *same]))
    place = F.row_number().over(Window.partitionBy(*partition_cols).orderBy("limit"))
    return inside.withColumn("_p", F.col("_before") + place).where("_p = _k").select(*partition_cols, "limit")


def sample_n(
    df: DataFrame,
    n: int,
    key_cols: Sequence[str],
    seed: int = DEFAULT_SEED,
    partition_cols: Sequence[str] = (),
    bucket_hex: int = BUCKET_HEX,
) -> DataFrame:
    """Exactly ``min(n, count)`` rows per group, chosen by hash order (K2 shuffled, K4).

    Up to ``BOTTOM_K`` rows every task keeps its first ``n`` of each group and only these are merged: one scan, nothing else is
    moved.  A larger sample is a comparison with the ``n``-th order key (rows equal in every column are then taken or left together).
    """
    if n <= BOTTOM_K:
        ordered = df.withColumn("_own", order_key(df, key_cols, seed))
        if not partition_cols:
            return ordered.orderBy("_own").limit(max(n, 0)).select(*[F.col(f"`{c}`") for c in df.columns])
        place = F.row_number().over(Window.partitionBy(*partition_cols).orderBy("_own"))
        return ordered.withColumn("_place", place).where(F.col("_place") <= n).select(*[F.col(f"`{c}`") for c in df.columns])
    limit = first_k_threshold(df, F.lit(n), key_cols, seed, partition_cols, bucket_hex)
    own = order_key(df, key_cols, seed)
    if not partition_cols:
        return df.where(own <= limit.scalar())
    held = limit.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(partition_cols)], "limit")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(partition_cols)]
    kept = df.withColumn("_own", own).join(held, _all(same))
    return kept.where(F.col("_own") <= F.col("limit")).select(*df.columns)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def exact_split(
    df: DataFrame,
    key_cols: Sequence[str],
    test_size: float = 0.2,
    seed: int = DEFAULT_SEED,
    split_col: str = "split",
    bucket_hex: int = BUCKET_HEX,
) -> DataFrame:
    """Label every row ``test`` or ``train``; exactly ``ceil(test_size * n)`` test rows (K3)."""
    k = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    limit = first_k_threshold(df, k, key_cols, seed, (), bucket_hex)
    is_test = F.coalesce(order_key(df, key_cols, seed) <= limit.scalar(), F.lit(False))
    return df.withColumn(split_col, F.when(is_test, "test").otherwise("train"))


def take_first(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order (K2 for unshuffled splits).

    Only the keys are ordered (each task keeps its own first ``n``); the rows are then
    compared with the ``n``-th key.  Rows that repeat that key are all taken.
    """
    keys = df.select(F.struct(*order_cols).alias("limit"))
    last = keys.orderBy("limit").limit(n).agg(F.max("limit"))
    return df.where(F.struct(*order_cols) <= last.scalar())


def per_split_limits(
    df: DataFrame,
    limits: dict[str, int | None],
    key_cols: Sequence[str],
    shuffle_splits: Sequence[str] = ("train",),
    seed: int = DEFAULT_SEED,
    split_col: str = "split",
) -> DataFrame:
    """Keep the configured splits with their caps.

    Splits in ``shuffle_splits`` are sampled in hash order, the others keep
    their first rows in key order; a cap of ``None`` keeps the whole split.
    A split that is not configured, or not present, yields nothing.  All splits are kept in one
    pass over the data; each cap costs a narrow scan of its split's keys.
    """
    own, first = order_key(df, key_cols, seed), F.struct(*key_cols)
    keep = F.lit(False)
    for split, cap in limits.items():
        here = F.col(split_col) == split
        rows = df.where(here)
        if cap is None:
            keep = keep | here
        elif split in shuffle_splits:
            keep = keep | (here & (own <= first_k_threshold(rows, F.lit(cap), key_cols, seed).scalar()))
        else:
            last = rows.select(first.alias("limit")).orderBy("limit").limit(cap).agg(F.max("limit"))
            keep = keep | (here & (first <= last.scalar()))
    return df.where(F.coalesce(keep, F.lit(False)))


def assign_batches(
    df: DataFrame,
    batch_size: int,
    key_cols: Sequence[str],
    seed: int = DEFAULT_SEED,
    partition_cols: Sequence[str] = (),
    batch_col: str = "batch",
) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in hash order (K9)."""
    ranked = hash_rank(df, key_cols, seed, partition_cols, "_rank")
    return ranked.withColumn(batch_col, F.floor((F.col("_rank") - 1) / batch_size).cast("bigint")).drop("_rank")

