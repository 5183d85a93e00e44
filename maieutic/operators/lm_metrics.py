"""Texts that a causal language model predicts at supervised positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.functions.text_rules import strip_text
from maieutic.operators.dialogue import ordered_concat
from maieutic.operators.span_qa import argmax
from maieutic.operators.tokens import IGNORE_INDEX


def supervised_predictions(lm: DataFrame, id_col: str = "example_id", pos_col: str = "pos") -> DataFrame:
    """``(id, pos, pred)``: the likeliest id at each position whose next label is supervised.

    ``lm``: ``(id, pos, logits, label)``.  The prediction at ``t`` stands against the label at ``t + 1``;
    examples without any supervised position have no row (P15).
    """
    following = lm.select(id_col, (F.col(pos_col) - 1).alias(pos_col), F.col("label").alias("_next"))
    scored = lm.join(following, [id_col, pos_col]).where(F.col("_next") != IGNORE_INDEX)
    return scored.select(id_col, pos_col, argmax(F.col("logits")).alias("pred"))


def prediction_texts(lm: DataFrame, vocab: DataFrame, id_col: str = "example_id", pos_col: str = "pos") -> DataFrame:
    """``(id, text)``: the predicted tokens of each supervised example, special tokens left out, joined and stripped."""
    preds = supervised_predictions(lm, id_col, pos_col)
    known = vocab.where(~F.col("is_special")).select(F.col("id").alias("pred"), "token")
    texts = ordered_concat(preds.join(known, "pred"), [id_col], pos_col, "token", " ", "text")
    examples = preds.select(id_col).distinct().join(texts, id_col, "left")
    return examples.select(id_col, strip_text(F.coalesce("text", F.lit(""))).alias("text"))
