"""Catalogue: span QA and LM-prediction metrics.

Logits come from ``embeddings``: the 64-long vector is the start logits, the
reversed vector the end logits, ``label`` the true start and ``label + 2``
the true end; position 0 stands for the CLS token (no offset), and every tenth
example has no offsets at all, so its span comes from the fallback.  LM logits for
A18 group eight consecutive vectors into one example (vocabulary = the first
64 ids of the ``documents`` vocabulary).  The answer-label fixture (W6-W8)
uses whole ``documents`` as contexts with a three-token answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators import span_qa as sq
from maieutic.operators.metrics import SPAN_QA_RESULT, RowSums, metric_report, span_qa_metric
from maieutic.operators import tokens as tk
from maieutic.operators.behavior import behavior_metrics
from maieutic.operators.lm_metrics import prediction_texts
from maieutic.functions.text_rules import BLANKS
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table
from maieutic.plans.q_tokens import _DOC_VOCAB_SQL, P, _doc_vocab

def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", spread="vec_id")
    v = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("example_id"), v.alias("start_logits"), F.reverse(v).alias("end_logits"),
        F.col("label").alias("start_label"), (F.col("label") + 2).alias("end_label"),
    )


def _offsets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    offs = F.transform(
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda i: F.when((i > 0) & (F.col("vec_id") % 10 != 0), F.struct((i * 5).alias("s"), (i * 5 + 4).alias("e"))),
    )
    return e.select(F.col("vec_id").alias("example_id"), offs.alias("offset_mapping"))


def _decoded(spark, sf_dir):
    return sq.decode_spans(_logits(spark, sf_dir), _offsets(spark, sf_dir), "example_id")


def _ranked_sql(list_expr: str, name: str) -> str:
    return f"""{name}0 AS (SELECT vec_id, unnest({list_expr}) AS v, unnest(range(len({list_expr}))) AS pos FROM e),
{name} AS (SELECT vec_id, pos, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos DESC) AS rk FROM {name}0)"""


_DECODE_SQL = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS st, list_reverse(CAST(embedding AS DOUBLE[])) AS en,
    label FROM embeddings),
{_ranked_sql('st', 'sr')},
{_ranked_sql('en', 'er')},
c AS (SELECT a.vec_id, a.pos AS ps, b.pos AS pe, a.v + b.v AS score, a.rk AS sk, b.rk AS ek FROM sr a JOIN er b
  ON a.vec_id = b.vec_id WHERE a.rk <= {sq.N_BEST_SIZE} AND b.rk <= {sq.N_BEST_SIZE} AND a.pos >= 1 AND b.pos >= 1 AND a.vec_id % 10 <> 0
  AND b.pos >= a.pos AND b.pos - a.pos + 1 <= {sq.MAX_ANSWER_LENGTH}),
b AS (SELECT vec_id, ps, pe, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, sk, ek)
  AS r FROM c) x WHERE r = 1),
f AS (SELECT e.vec_id AS example_id, e.label AS start_label, e.label + 2 AS end_label,
  CAST(coalesce(b.ps, list_position(st, list_max(st)) - 1) AS INTEGER) AS pred_start,
  CAST(coalesce(b.pe, list_position(en, list_max(en)) - 1) AS INTEGER) AS pred_end,
  b.score AS score, b.ps IS NOT NULL AS from_candidates FROM e LEFT JOIN b ON e.vec_id = b.vec_id),
g AS (SELECT *, greatest(pred_end - pred_start + 1, 0) AS pl, greatest(end_label - start_label + 1, 0) AS tl,
  greatest(least(pred_end, end_label) - greatest(pred_start, start_label) + 1, 0) AS cm FROM f),
h AS (SELECT *, CAST(CASE WHEN pl = 0 OR tl = 0 THEN (CASE WHEN pl = 0 AND tl = 0 THEN 1.0 ELSE 0.0 END)
  WHEN cm = 0 THEN 0.0 ELSE 2 * (cm / pl) * (cm / tl) / ((cm / pl) + (cm / tl)) END AS DOUBLE) AS f1 FROM g)"""


@register(
    "k5_top_positions",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS st, list_reverse(CAST(embedding AS DOUBLE[])) AS en
  FROM embeddings), {_ranked_sql('st', 'sr')}, {_ranked_sql('en', 'er')}
SELECT s.vec_id AS example_id, s.top_starts, t.top_ends FROM
 (SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY rk) AS top_starts FROM sr WHERE rk <= {sq.N_BEST_SIZE}
  GROUP BY vec_id) s JOIN
 (SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY rk) AS top_ends FROM er WHERE rk <= {sq.N_BEST_SIZE}
  GROUP BY vec_id) t ON s.vec_id = t.vec_id""",
)
def q_top_positions(spark, sf_dir):
    lg = _logits(spark, sf_dir)

    def s(c):
        return F.array_join(F.transform(sq.top_positions(F.col(c), sq.N_BEST_SIZE), lambda x: x.cast("string")), " ")

    return lg.select("example_id", s("start_logits").alias("top_starts"), s("end_logits").alias("top_ends"))


@register(
    "k6_argmax",
    """SELECT vec_id AS example_id,
  CAST(list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS INTEGER) AS argmax_start,
  CAST(list_position(list_reverse(CAST(embedding AS DOUBLE[])), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS INTEGER)
  AS argmax_end FROM embeddings""",
)
def q_argmax(spark, sf_dir):
    lg = _logits(spark, sf_dir)
    return lg.select("example_id", sq.argmax(F.col("start_logits")).alias("argmax_start"),
                     sq.argmax(F.col("end_logits")).alias("argmax_end"))


@register(
    "k7_best_span",
    f"{_DECODE_SQL} SELECT example_id, pred_start, pred_end, score, from_candidates, f1 FROM h",
)
def q_best_span(spark, sf_dir):
    d = _decoded(spark, sf_dir)
    f1 = sq.span_f1(F.col("pred_start"), F.col("pred_end"), F.col("start_label"), F.col("end_label"))
    return d.select("example_id", "pred_start", "pred_end", "score", "from_candidates", f1.alias("f1"))


_REPORT_SQL = f"""{_DECODE_SQL} SELECT count(*) AS n_examples,
  CAST(sum(CAST(pred_start = start_label AS BIGINT)) AS DOUBLE) / count(*) AS start_accuracy,
  CAST(sum(CAST(pred_end = end_label AS BIGINT)) AS DOUBLE) / count(*) AS end_accuracy,
  CAST(sum(CAST(pred_start = start_label AND pred_end = end_label AS BIGINT)) AS DOUBLE) / count(*) AS exact_match,
  CAST(sum(CAST(pred_start <= pred_end AS BIGINT)) AS DOUBLE) / count(*) AS valid_span_ratio,
  round(sum(f1) / count(*), 9) AS f1 FROM h HAVING count(*) > 0"""


@register("a14_span_qa_report", _REPORT_SQL)
def q_span_report(spark, sf_dir):
    return sq.span_qa_report(_decoded(spark, sf_dir))


@register("u4_user_metric_report", _REPORT_SQL)
def q_user_metric(spark, sf_dir):
    """The same report by a metric of the user's: states per task, merged per group."""
    return metric_report(_decoded(spark, sf_dir), span_qa_metric(), SPAN_QA_RESULT, columns=["pred_start", "pred_end", "start_label", "end_label"])


def _spread(frame):
    """Per document: its length, the square of it, and whether it is long."""
    n = frame["n_chars"].astype("int64")
    return frame.assign(n=1, chars=n, long=(n > 2000).astype("int64"))[["n", "chars", "long"]]


@register(
    "u4_user_metric_by_group",
    """SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_chars,
  CAST(sum(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS long_share FROM documents GROUP BY lang, source""",
)
def q_user_metric_by_group(spark, sf_dir):
    """A user's metric per group of whole ``documents``."""
    metric = RowSums(_spread, lambda s: {"n": int(s["n"]), "mean_chars": s["chars"] / s["n"], "long_share": s["long"] / s["n"]})
    return metric_report(table(spark, sf_dir, "documents"), metric, "n bigint, mean_chars double, long_share double", ["lang", "source"], ["n_chars"])


# --- W6-W8: answer token labels on documents ---------------------------------------------------
def _doc_qa(spark, sf_dir):
    """Examples with a three-token answer, found in-row from the text's token pieces."""
    d = table(spark, sf_dir, "documents")
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(tk.WORD_TOKEN_REGEX), 0)
    question = F.concat(F.lit("What does the "), F.col("source"), F.lit(" passage say?"))
    rows = d.select("doc_id", "text", pieces.alias("_p"), F.size(tk.word_tokens(question)).alias("q_len"))
    rows = rows.withColumn("_a0", F.when(F.col("doc_id") % 2 == 1, F.size("_p") - 3).otherwise(F.lit(2)))
    upto = lambda n: F.length(F.array_join(F.slice("_p", F.lit(1), n), ""))
    has = F.size("_p") >= 5
    start = upto(F.col("_a0") + 1) - F.length(F.ltrim(F.get("_p", F.col("_a0")), F.lit(BLANKS)))
    rows = rows.withColumn("answer_start", F.when(has, start)).withColumn("_e2", F.when(has, upto(F.col("_a0") + 3)))
    return rows.select(
        "doc_id", "answer_start",
        F.substring(F.col("text"), F.col("answer_start") + 1, F.col("_e2") - F.col("answer_start")).alias("answer_text"),
        (F.col("q_len") + 2).alias("context_start"), F.size("_p").alias("context_len"),
    )


_DOC_QA_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{P}', 0) AS pieces,
    regexp_extract_all(coalesce(text, ''), '{P}', 1) AS toks FROM documents),
e AS (SELECT doc_id, unnest(pieces) AS piece, unnest(toks) AS tok, unnest(range(len(pieces))) AS pos FROM t),
r AS (SELECT doc_id, pos, tok, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM e),
tok AS (SELECT doc_id, pos, e - length(tok) AS s, e FROM r),
n AS (SELECT doc_id, count(*) AS n_tok FROM tok GROUP BY doc_id),
d AS (SELECT d.doc_id, d.text, coalesce(n.n_tok, 0) AS n_tok,
    len(regexp_extract_all(lower('What does the ' || d.source || ' passage say?'), '{P}', 1)) AS q_len
  FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id),
d2 AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN n_tok - 3 ELSE 2 END AS a0 FROM d),
sp AS (SELECT d2.doc_id, min(CASE WHEN tok.pos = d2.a0 THEN tok.s END) AS s0,
    max(CASE WHEN tok.pos = d2.a0 + 2 THEN tok.e END) AS e2 FROM tok JOIN d2 ON tok.doc_id = d2.doc_id GROUP BY d2.doc_id),
ex AS (SELECT d2.doc_id, CASE WHEN n_tok >= 5 THEN s0 END AS answer_start,
    CASE WHEN n_tok >= 5 THEN s0 + length(substring(text, CAST(s0 + 1 AS BIGINT), CAST(e2 - s0 AS BIGINT))) END AS answer_end,
    q_len + 2 AS context_start, n_tok AS context_len
  FROM d2 LEFT JOIN sp ON d2.doc_id = sp.doc_id),
fd AS (SELECT ex.doc_id, max(CASE WHEN tok.s <= ex.answer_start THEN tok.pos END) AS fs,
    min(CASE WHEN tok.e >= ex.answer_end THEN tok.pos END) AS fe
  FROM ex JOIN tok ON ex.doc_id = tok.doc_id WHERE tok.pos < ex.context_len GROUP BY ex.doc_id)
SELECT ex.doc_id,
  CAST(CASE WHEN answer_start IS NULL THEN NULL WHEN fs IS NOT NULL AND fe IS NOT NULL THEN fs + context_start ELSE 0 END
    AS INTEGER) AS start_positions,
  CAST(CASE WHEN answer_start IS NULL THEN NULL WHEN fs IS NOT NULL AND fe IS NOT NULL THEN fe + context_start ELSE 0 END
    AS INTEGER) AS end_positions
FROM ex LEFT JOIN fd ON ex.doc_id = fd.doc_id"""


@register("w6_w8_answer_positions", _DOC_QA_SQL)
def q_answer_positions(spark, sf_dir):
    toks = tk.token_offsets(table(spark, sf_dir, "documents"), "doc_id")
    return sq.answer_positions(toks, _doc_qa(spark, sf_dir), "doc_id")


# --- A18: behaviour metrics of LM predictions --------------------------------------------------
def _lm_texts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ignored = (F.col("label") < 3) | F.expr("(vec_id div 8) % 5 = 0")  # every fifth example has no supervised label
    lm = e.select(
        F.expr("vec_id div 8").alias("example_id"), F.expr("vec_id % 8").alias("pos"),
        F.col("embedding").cast("array<double>").alias("logits"),
        F.when(ignored, F.lit(tk.IGNORE_INDEX)).otherwise(F.col("label") + 8).alias("label"),
    )
    return prediction_texts(lm, _doc_vocab(spark, sf_dir))


_LM_TEXT_SQL = f"""WITH vocab AS ({_DOC_VOCAB_SQL}),
lm AS (SELECT vec_id // 8 AS example_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS logits,
  CASE WHEN label < 3 OR (vec_id // 8) % 5 = 0 THEN -100 ELSE label + 8 END AS label FROM embeddings),
p AS (SELECT a.example_id, a.pos, list_position(a.logits, list_max(a.logits)) - 1 AS pred FROM lm a JOIN lm b
  ON a.example_id = b.example_id AND b.pos = a.pos + 1 WHERE b.label <> -100),
ex AS (SELECT DISTINCT example_id FROM p),
tx AS (SELECT p.example_id, string_agg(v.token, ' ' ORDER BY p.pos) AS text FROM p JOIN vocab v
  ON v.id = p.pred AND NOT v.is_special GROUP BY p.example_id)
SELECT ex.example_id, regexp_replace(coalesce(tx.text, ''), '{o.unicode_patterns()['strip']}', '', 'g') AS text
FROM ex LEFT JOIN tx ON ex.example_id = tx.example_id"""


@register("a18_lm_prediction_texts", _LM_TEXT_SQL)
def q_lm_texts(spark, sf_dir):
    return _lm_texts(spark, sf_dir)


@register(
    "a18_lm_behavior_metrics",
    f"WITH {o.behavior_features_ctes(_LM_TEXT_SQL, unicode=True)}\n{o.behavior_metric_select()} FROM f HAVING count(*) > 0",
)
def q_lm_behavior(spark, sf_dir):
    return behavior_metrics(_lm_texts(spark, sf_dir), "text")
