"""Token-weighted evaluation loss and perplexity.

Input is a table of per-batch losses ``(..., loss, n_tokens)`` as a trainer
reports them; the mean is weighted by target tokens, which makes it a plain
two-sum aggregate (partial aggregation, any grouping).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: loss cap before exponentiation.
PERPLEXITY_LOSS_CAP = 20.0


def perplexity(loss: Column) -> Column:
    """``exp(min(loss, 20))``; NaN stays NaN (tested first: Spark orders NaN above numbers)."""
    return F.when(F.isnan(loss), F.lit(float("nan"))).otherwise(F.exp(F.least(loss, F.lit(PERPLEXITY_LOSS_CAP))))


def weighted_loss(df: DataFrame, loss_col: str = "loss", tokens_col: str = "n_tokens", group_cols=(),
                  round_digits: int | None = 9) -> DataFrame:
    """``eval_loss = sum(loss * n) / sum(n)`` (NaN without tokens) and its perplexity.

    A batch without a loss or a token count is left out, weight and all.
    """
    known = df.where(F.col(loss_col).isNotNull() & F.col(tokens_col).isNotNull())
    n = F.sum(F.col(tokens_col).cast("bigint"))
    num = F.sum(F.col(loss_col) * F.col(tokens_col).cast("bigint"))
    agg = known.groupBy(*group_cols).agg(n.alias("n_tokens"), num.alias("_num"))
    loss = F.when(F.coalesce(F.col("n_tokens"), F.lit(0)) == 0, F.lit(float("nan"))).otherwise(
        F.col("_num") / F.col("n_tokens"))
    out = agg.withColumn("eval_loss", loss).withColumn("perplexity", perplexity(F.col("eval_loss")))
    if round_digits is not None:
        out = out.withColumn("eval_loss", F.round("eval_loss", round_digits)).withColumn(
            "perplexity", F.round("perplexity", round_digits))
    return out.select(*group_cols, "n_tokens", "eval_loss", "perplexity")
