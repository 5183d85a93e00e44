"""Catalogue: behaviour rules and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.functions import text_rules as tr
from maieutic.operators.behavior import behavior_features, behavior_metrics
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import RESPONSES_SELECT_SQL, responses, table


def _rule_frame(df, id_col, t):
    """All rules per row.  Sub-rules are projected once; the two combined rules
    are derived from those columns in a second projection (each regex runs
    once per row).  Phrase and ``Final:`` tests give the same truth value on
    the stripped and the raw text, so only the step count needs the strip."""
    base = df.select(
        id_col,
        tr.count_questions(t).alias("n_questions"),
        tr.count_step_lines(t).alias("n_step_lines"),
        tr.count_sentence_marks(t).alias("n_sentence_marks"),
        tr.is_mostly_questions(t).alias("mostly_questions"),
        tr.has_answer_phrase(t).alias("answer_phrase"),
        tr.has_final_format(t).alias("final_format"),
        tr.count_step_lines(tr.strip_text(t)).alias("_stripped_steps"),
        tr.has_number_with_unit(t).alias("number_with_unit"),
        tr.has_numeric_range(t).alias("numeric_range"),
        tr.has_comparison(t).alias("comparison"),
        tr.has_prescription(t).alias("prescription"),
        tr.interrogative_ratio(t).alias("interrogative_ratio"),
        tr.contains_imperative(t).alias("contains_imperative"),
        tr.char_length(t).alias("n_chars"),
        tr.whitespace_token_count(t).alias("n_tokens"),
        tr.strip_text(t).alias("stripped"),
        tr.is_blank(t).alias("blank"),
    )
    c = F.col
    withhold = ~c("blank") & (c("answer_phrase") | c("final_format")
                              | ((c("_stripped_steps") >= tr.STEP_LIST_MIN_LINES) & ~c("mostly_questions")))
    numeric = ~c("blank") & (c("number_with_unit") | c("numeric_range") | c("comparison") | c("prescription"))
    return base.select("*", withhold.alias("withhold_violation"), numeric.alias("numeric_violation")).drop(
        "_stripped_steps")


def _rule_columns_sql(unicode: bool) -> str:
    p = o.unicode_patterns() if unicode else o.ascii_patterns()
    cues = " + ".join(f"CASE WHEN contains(_joined, '{c}') THEN 1 ELSE 0 END" for c in tr.INTERROGATIVES)
    return f"""
  n_questions, n_step_lines, n_sentence_marks,
  CASE WHEN n_sentence_marks = 0 THEN n_questions > 0 ELSE n_questions >= greatest(1, n_sentence_marks // 2) END
    AS mostly_questions,
  regexp_matches(_t, '{p['phrases']}') AS answer_phrase,
  regexp_matches(_t, '{p['final']}') AS final_format,
  withhold_violation,
  regexp_matches(_t, '{p['num_unit']}') AS number_with_unit,
  regexp_matches(_t, '{p['range']}') AS numeric_range,
  regexp_matches(_t, '{p['comparison']}') AND regexp_matches(_t, '{p['unit_any']}') AS comparison,
  regexp_matches(_t, '{p['prescription']}') AS prescription,
  numeric_violation,
  CASE WHEN _nwords > 0 THEN ({cues}) / _nwords END AS interrogative_ratio,
  contains_imperative, n_chars, n_tokens, _s AS stripped, _blank AS blank""", p


def _features_sql(src: str, id_col: str, unicode: bool) -> str:
    cols, p = _rule_columns_sql(unicode)
    ctes = o.behavior_features_ctes(src, "text", unicode=unicode)
    return f"""WITH {ctes},
g AS (SELECT *, CAST(len(regexp_extract_all(_t, '{p['step']}')) AS BIGINT) AS n_step_lines,
  CAST(length(_t) - length(translate(_t, '.!?', '')) AS BIGINT) AS n_sentence_marks FROM f)
SELECT {id_col}, {cols} FROM g"""


# --- per-row rules on derived responses (ASCII) ------------------------------
@register(
    "t1_t17_response_rules",
    _features_sql(RESPONSES_SELECT_SQL, "response_id", unicode=False),
)
def q_response_rules(spark, sf_dir):
    return _rule_frame(responses(spark, sf_dir), "response_id", F.col("text"))


# --- per-row rules on whole documents (Unicode prose in four languages) ------
@register(
    "t1_t17_document_rules",
    _features_sql("SELECT doc_id, text FROM documents", "doc_id", unicode=True),
)
def q_document_rules(spark, sf_dir):
    return _rule_frame(table(spark, sf_dir, "documents", spread="doc_id"), "doc_id", F.col("text"))


# --- A11: the flagship metric set ---------------------------------------------
@register(
    "a11_behavior_metrics",
    f"WITH {o.behavior_features_ctes(RESPONSES_SELECT_SQL)}\n{o.behavior_metric_select()} FROM f HAVING count(*) > 0",
)
def q_behavior_metrics(spark, sf_dir):
    return behavior_metrics(responses(spark, sf_dir), "text")


@register(
    "a11_behavior_metrics_by_priority",
    f"WITH {o.behavior_features_ctes(RESPONSES_SELECT_SQL)}\n"
    f"{o.behavior_metric_select(('priority',))} FROM f GROUP BY priority",
)
def q_behavior_metrics_by_priority(spark, sf_dir):
    return behavior_metrics(responses(spark, sf_dir), "text", group_cols=["priority"])


@register(
    "a11_behavior_metrics_documents_by_lang",
    f"WITH {o.behavior_features_ctes('SELECT lang, text FROM documents', unicode=True)}\n"
    f"{o.behavior_metric_select(('lang',))} FROM f GROUP BY lang",
)
def q_behavior_metrics_documents(spark, sf_dir):
    return behavior_metrics(table(spark, sf_dir, "documents", spread="doc_id"), "text", group_cols=["lang"])


@register(
    "a11_behavior_metrics_conversations_by_role",
    f"WITH {o.behavior_features_ctes('SELECT role, text FROM conversations', unicode=True)}\n"
    f"{o.behavior_metric_select(('role',))} FROM f GROUP BY role",
)
def q_behavior_metrics_conversations(spark, sf_dir):
    return behavior_metrics(table(spark, sf_dir, "conversations", spread="conv_id"), "text", group_cols=["role"])


__all__ = ["behavior_features"]
