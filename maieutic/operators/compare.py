"""Pairwise comparison of two models' outputs.

The outputs of the two models are two tables keyed by prompt id.  Pairing is
an equi-join on that id (Catalyst picks broadcast or sort-merge from the
sizes; AQE splits a skewed id partition).  Ids present on one side only are
counted by a full outer join instead of being dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.functions import text_rules as tr


def pair_outputs(
    trained: DataFrame,
    baseline: DataFrame,
    id_col: str = "id",
    output_col: str = "output",
    prompt_col: str | None = "prompt",
) -> DataFrame:
    """``(id, [prompt], trained_output, baseline_output)`` for ids on both sides."""
    left_cols = [F.col(id_col), F.col(output_col).alias("trained_output")]
    if prompt_col and prompt_col in trained.columns:
        left_cols.insert(1, F.col(prompt_col))
    left = trained.select(*left_cols)
    right = baseline.select(F.col(id_col), F.col(output_col).alias("baseline_output"))
    return left.join(right, id_col, "inner")


def unpaired_counts(trained: DataFrame, baseline: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: how many ids only one side has (``zip`` would drop them silently)."""
    t = trained.select(F.col(id_col).alias("_t"))
    b = baseline.select(F.col(id_col).alias("_b"))
    both = t.join(b, F.col("_t") == F.col("_b"), "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("trained_only"), F.count_if(F.col("_t").isNull()).alias("baseline_only")
    )


def _once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used.

    The optimizer merges neighbouring projections and so repeats an expression at each use; it does
    not merge them with a generated row.  Generating exactly one row is what keeps them apart.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def pairwise_f1(pairs: DataFrame, pred_col: str = "trained_output", ref_col: str = "baseline_output") -> DataFrame:
    """Add word-set precision / recall / F1 of each pair, rounded to 4 decimals and raw.

    Each text is cut into words once, and the three sizes are taken once; all results are arithmetic on them.
    """
    words = [tr.word_set(F.coalesce(F.col(c), F.lit(""))) for c in (pred_col, ref_col)]
    sets = _once(pairs, _pred_words=words[0], _ref_words=words[1])
    p, r, c = tr.set_sizes(F.col("_pred_words"), F.col("_ref_words"))
    sizes = _once(sets, _p=p, _r=r, _c=c).drop("_pred_words", "_ref_words")
    scored = _once(sizes, f1_metrics=tr.f1_of_sizes(F.col("_p"), F.col("_r"), F.col("_c"))).drop("_p", "_r", "_c")
    fields = ("precision", "recall", "f1", "raw_precision", "raw_recall", "raw_f1")
    return scored.select("*", *(F.col("f1_metrics").getField(f).alias(f) for f in fields))


def f1_summary(scored: DataFrame, f1_col: str = "f1", group_cols=()) -> DataFrame:
    """Mean / min / max of the already rounded per-pair F1.

    The mean of values ``q/10000`` is ``sum(q) / (10000 n)``: summed as
    integers and rounded exactly, so it does not depend on partitioning.
    No pair -> no row.
    """
    q = F.round(F.col(f1_col) * 10000).cast("bigint")
    agg = scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(q).alias("_sum_q"),
        F.min(f1_col).alias("min_f1"),
        F.max(f1_col).alias("max_f1"),
    )
    mean = tr.round_ratio_half_even(F.col("_sum_q"), F.col("n_pairs"), 0) / F.lit(10000.0)
    out = agg.where(F.col("n_pairs") > 0).withColumn("mean_f1", mean).drop("_sum_q")
    return out.select(*group_cols, "n_pairs", "mean_f1", "min_f1", "max_f1")
