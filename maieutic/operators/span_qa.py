"""Extractive (span) QA: answer-token labels, best-span decoding and metrics.

Decoding works in-row on the logit arrays: the top ``n_best`` start and end
positions (``sort_array`` of ``(-logit, -position)``), the at most
``n_best x n_best`` candidate pairs, the valid ones and the best by score.
No explode, no shuffle; the work per row is bounded by ``n_best**2``.

Tie rules (the reference leaves them to an unstable sort): higher logit, then
higher position, for the top positions; for equal candidate scores, the
earlier candidate in (start rank, end rank) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decoding defaults.
N_BEST_SIZE = 20
MAX_ANSWER_LENGTH = 30


def has_answers(answers: Column) -> Column:
    """Struct present and both arrays non-empty."""
    return F.coalesce((F.size(answers["text"]) > 0) & (F.size(answers["answer_start"]) > 0), F.lit(False))


def first_answer(answers: Column) -> Column:
    """``struct(text, start)`` of the first answer (P7); NULL-safe under ANSI mode."""
    return F.struct(F.get(answers["text"], 0).alias("text"), F.get(answers["answer_start"], 0).alias("start"))


def top_positions(logits: Column, n: int) -> Column:
    """Positions of the ``n`` largest logits, largest first (K5)."""
    ranked = F.sort_array(F.transform(logits, lambda v, i: F.struct((-v).alias("nv"), (-i).alias("ni"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: -x["ni"])


def argmax(logits: Column) -> Column:
    """First position of the maximum (K6), as NumPy's ``argmax``."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def best_span(
    start_logits: Column,
    end_logits: Column,
    offsets: Column,
    n_best: int = N_BEST_SIZE,
    max_answer_length: int = MAX_ANSWER_LENGTH,
) -> Column:
    """Best valid ``(start, end)`` by ``start + end`` logit; fallback to the two argmaxes.

    Valid: both positions inside ``offsets`` with a non-NULL offset,
    ``end >= start`` and at most ``max_answer_length`` tokens.  Returns
    ``struct(start, end, score, from_candidates)``; ``score`` is NULL on fallback.
    """
    n_off = F.size(offsets)

    def valid_pairs(top):
        pairs = F.flatten(
            F.transform(
                top["starts"],
                lambda s, si: F.transform(
                    top["ends"],
                    lambda e, ei: F.struct(
                        (-(F.get(start_logits, s) + F.get(end_logits, e))).alias("nscore"),
                        si.alias("si"), ei.alias("ei"), s.alias("s"), e.alias("e"),
                    ),
                ),
            )
        )
        return F.filter(
            pairs,
            lambda c: (c["e"] >= c["s"]) & (c["e"] - c["s"] + 1 <= max_answer_length) & (c["s"] < n_off) & (c["e"] < n_off)
            & F.get(offsets, c["s"]).isNotNull() & F.get(offsets, c["e"]).isNotNull(),
        )

    top = F.struct(top_positions(start_logits, n_best).alias("starts"), top_positions(end_logits, n_best).alias("ends"))
    best = _bound(top, lambda t: F.array_min(valid_pairs(t)))
    return _bound(best, lambda b: F.when(
        b.isNotNull(),
        F.struct(b["s"].cast("int").alias("start"), b["e"].cast("int").alias("end"),
                 (-b["nscore"]).alias("score"), F.lit(True).alias("from_candidates")),
    ).otherwise(
        F.struct(argmax(start_logits).alias("start"), argmax(end_logits).alias("end"),
                 F.lit(None).cast("double").alias("score"), F.lit(False).alias("from_candidates"))
    ))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used (an expression inside of a lambda is computed at every call)."""
    return F.get(F.transform(F.array(value), use), 0)


def span_f1(ps: Column, pe: Column, ts: Column, te: Column) -> Column:
    """Token F1 of two closed spans (R9, J8); an empty span scores 1 only against another empty one."""
    pl = F.greatest(pe - ps + 1, F.lit(0))
    tl = F.greatest(te - ts + 1, F.lit(0))
    common = F.greatest(F.least(pe, te) - F.greatest(ps, ts) + 1, F.lit(0))
    p = common / pl
    r = common / tl
    return (
        F.when((pl == 0) | (tl == 0), F.when((pl == 0) & (tl == 0), 1.0).otherwise(0.0))
        .when(common == 0, 0.0)
        .otherwise(2 * p * r / (p + r))
    ).cast("double")


def decode_spans(logits: DataFrame, offsets: DataFrame | None, id_col: str = "example_id",
                 n_best: int = N_BEST_SIZE, max_answer_length: int = MAX_ANSWER_LENGTH) -> DataFrame:
    """Attach offsets by example id (J3) and decode the best span of every example (K7).

    Without ``offsets`` the logits bring their ``offset_mapping`` along, and nothing is joined.
    """
    x = logits if offsets is None else logits.join(offsets, id_col, "inner")
    b = best_span(F.col("start_logits"), F.col("end_logits"), F.col("offset_mapping"), n_best, max_answer_length)
    return x.select("*", b.alias("_b")).select(
        "*", F.col("_b.start").alias("pred_start"), F.col("_b.end").alias("pred_end"),
        F.col("_b.score").alias("score"), F.col("_b.from_candidates").alias("from_candidates"),
    ).drop("_b")


def span_qa_report(decoded: DataFrame, group_cols=(), round_digits: int = 9) -> DataFrame:
    """``start_accuracy, end_accuracy, exact_match, valid_span_ratio, f1``."""
    ps, pe, ts, te = (F.col(c) for c in ("pred_start", "pred_end", "start_label", "end_label"))
    n = F.count(F.lit(1))

    def mean_flag(c):
        return F.sum(c.cast("bigint")).cast("double") / n

    return decoded.groupBy(*group_cols).agg(
        n.alias("n_examples"),
        mean_flag(ps == ts).alias("start_accuracy"),
        mean_flag(pe == te).alias("end_accuracy"),
        mean_flag((ps == ts) & (pe == te)).alias("exact_match"),
        mean_flag(ps <= pe).alias("valid_span_ratio"),
        F.round(F.sum(span_f1(ps, pe, ts, te)) / n, round_digits).alias("f1"),
    ).where(F.col("n_examples") > 0)


def answer_labels(kept: Column, start: Column, stop: Column, offset: Column) -> tuple[Column, Column]:
    """Start and end token labels of an answer among the kept context tokens, in-row.

    ``kept``: array of structs with ``start`` and ``end`` in characters, in text order; ``start`` and ``stop``: the answer's
    characters; ``offset``: position of the first context token.  The start is the last token that starts at or before the answer, the end
    the first one that ends at or behind it.  Both ends ascend with the position, so these are counts.  If either is
    missing the answer was cut off and both labels are 0, the CLS position; without an answer both are NULL.
    """
    first = F.size(F.filter(kept, lambda o: o["start"] <= start)) - 1
    last = F.size(kept) - F.size(F.filter(kept, lambda o: o["end"] >= stop))
    inside = (first >= 0) & (last < F.size(kept))
    label = lambda p: F.when(start.isNotNull(), F.when(inside, p + offset).otherwise(F.lit(0))).cast("int")
    return label(first), label(last)


def answer_positions(
    tokens: DataFrame,
    examples: DataFrame,
    id_col: str,
    kept_col: str = "context_len",
    offset_col: str = "context_start",
) -> DataFrame:
    """``answer_labels`` for tokens that come as rows.

    ``tokens``: ``(id, pos, start, end)`` character offsets of the context
    tokens; ``examples``: ``(id, answer_start, answer_text, context_start,
    context_len)``.  Only context tokens kept after truncation are searched.  The tokens of an example are gathered
    (``token_offsets`` leaves them together) and joined once, as an array.
    """
    spans = tokens.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("_o"))
    x = examples.join(spans, id_col, "left").withColumn("_kept", F.slice(F.coalesce("_o", F.array()), F.lit(1), F.col(kept_col)))
    stop = F.col("answer_start") + F.length("answer_text")
    start, end = answer_labels(F.col("_kept"), F.col("answer_start"), stop, F.col(offset_col))
    return x.select(id_col, start.alias("start_positions"), end.alias("end_positions"))
