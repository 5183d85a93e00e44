"""Catalogue: token-weighted loss and perplexity (A12, A13) over whole ``lineitem``.

A batch loss is ``l_discount * 10`` over ``l_quantity`` target tokens; an
order is one evaluation (its line items are its batches).  Orders divisible by 13
have no target tokens, those divisible by 7 large losses (beyond the cap of the
perplexity), and the first line of those divisible by 5 has no loss.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators.loss import PERPLEXITY_LOSS_CAP, weighted_loss
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table


_LOSS = "CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN NULL WHEN l_orderkey % 7 = 0 THEN l_discount * 10 + 30 ELSE l_discount * 10 END"
_TOKENS = "CASE WHEN l_orderkey % 13 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END"


def _batches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_returnflag", F.expr(_LOSS).alias("loss"), F.expr(_TOKENS).alias("n_tokens"))


def _loss_sql(group: str) -> str:
    lead = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""WITH b AS (SELECT {lead}CAST(sum({_TOKENS}) AS BIGINT) AS n_tokens,
  sum(({_LOSS}) * ({_TOKENS})) AS num FROM lineitem WHERE ({_LOSS}) IS NOT NULL {gb}),
l AS (SELECT *, CASE WHEN coalesce(n_tokens, 0) = 0 THEN CAST('NaN' AS DOUBLE) ELSE num / n_tokens END AS el FROM b)
SELECT {lead}n_tokens, round(el, 9) AS eval_loss,
  round(CASE WHEN isnan(el) THEN CAST('NaN' AS DOUBLE) ELSE exp(least(el, {PERPLEXITY_LOSS_CAP})) END, 9) AS perplexity
FROM l"""


@register("a12_a13_loss_per_order", _loss_sql("l_orderkey"))
def q_loss_per_order(spark, sf_dir):
    return weighted_loss(_batches(spark, sf_dir), group_cols=["l_orderkey"])


@register("a12_a13_loss_by_returnflag", _loss_sql("l_returnflag"))
def q_loss_by_flag(spark, sf_dir):
    return weighted_loss(_batches(spark, sf_dir), group_cols=["l_returnflag"])


@register("a12_a13_loss_overall", _loss_sql(""))
def q_loss_overall(spark, sf_dir):
    return weighted_loss(_batches(spark, sf_dir))
