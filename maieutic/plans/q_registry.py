"""Catalogue: the named preprocessors (U1, U3) over whole tables, and span QA from preparation to score.

Span-QA examples are the ``documents``: the text is the context, and by
``doc_id % 6`` the example has no answers, empty answer lists, an answer at
the start, at the end (cut off in a long text), inside words, or two answers.  Every
fiftieth question is too long to leave room for context.  Long-form examples take the source as the title.
Dialogues are the ``conversations`` in nested form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators import dialogue as dl
from maieutic.operators import span_qa as sq
from maieutic.operators import tokens as tk
from maieutic.plans import registry
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table
from maieutic.plans.q_dialogue import _POLICIES_SQL, _POLICY_PROMPT_SQL, _policies, _turns
from maieutic.plans import oracle as o
from maieutic.plans.q_tokens import _DOC_VOCAB_SQL, EMPTY, P, _doc_vocab, arr_str, id_lists_sql, vocab_sql

SQUAD_MAX_LENGTH, LONG_QA_MAX_LENGTH = 384, 512

# (text, start) of the first answer by doc_id % 6; both engines read these expressions.
_ANSWER = {
    2: ("substring(text, 1, 12)", "0"),
    3: ("substring(text, length(text) - 9, 10)", "length(text) - 10"),
    4: ("substring(text, 6, 4)", "5"),
    5: ("substring(text, 31, 20)", "30"),
}
_QUESTION = "CASE WHEN doc_id % 50 = 7 THEN repeat('why ', 400) ELSE 'What does the ' || source || ' passage say?' END"


def _squad_input(spark, sf_dir):
    cases = [f"WHEN doc_id % 6 = {k} THEN named_struct('text', array({t}{', source' if k == 5 else ''}), 'answer_start', "
             f"array(CAST({s} AS INT){', 3' if k == 5 else ''}))" for k, (t, s) in _ANSWER.items()]
    empty = "WHEN doc_id % 6 = 1 THEN named_struct('text', CAST(array() AS array<string>), 'answer_start', CAST(array() AS array<int>))"
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_QUESTION).alias("question"), F.col("text").alias("context"),
        F.expr(f"CASE {' '.join(cases)} {empty} END").alias("answers"),
    )


def _squad(spark, sf_dir):
    return registry.preprocess("squad", _squad_input(spark, sf_dir), vocab=_doc_vocab(spark, sf_dir),
                               max_length=SQUAD_MAX_LENGTH, id_col="doc_id")


def _case(i: int) -> str:
    return "CASE " + " ".join(f"WHEN doc_id % 6 = {k} THEN {v[i]}" for k, v in _ANSWER.items()) + " END"


def _squad_ctes(pattern: str, plain: str, pieces_of: str) -> str:
    """CTEs ending in ``squad``; ``pattern`` cuts ``plain`` text into tokens, and ``pieces_of`` (of the same length as the text) for offsets."""
    return f"""vocab AS ({vocab_sql('SELECT text FROM documents', pattern, plain)}),
src AS (SELECT doc_id, coalesce(text, '') AS text, {_QUESTION} AS question, {_case(0)} AS a_text, {_case(1)} AS a_start FROM documents),
{id_lists_sql('SELECT doc_id, question FROM src', 'doc_id', 'question', 'vocab', 'qids', pattern, plain)},
{id_lists_sql('SELECT doc_id, text FROM src', 'doc_id', 'text', 'vocab', 'cids', pattern, plain)},
pc AS (SELECT doc_id, regexp_extract_all({pieces_of}, '{pattern}', 0) AS pieces, regexp_extract_all({pieces_of}, '{pattern}', 1) AS toks FROM src),
px AS (SELECT doc_id, unnest(pieces) AS piece, unnest(toks) AS tok, unnest(range(len(pieces))) AS pos FROM pc),
tk AS (SELECT doc_id, pos, length(tok) AS n, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM px),
ex AS (SELECT s.doc_id, s.text, s.a_start, s.a_start + length(s.a_text) AS a_stop, q.ids AS q, len(q.ids) + 2 AS cs,
  list_slice(c.ids, 1, {SQUAD_MAX_LENGTH} - len(q.ids) - 3) AS ctx, len(q.ids) + 3 >= {SQUAD_MAX_LENGTH} AS rejected
  FROM src s JOIN qids q ON q.doc_id = s.doc_id JOIN cids c ON c.doc_id = s.doc_id),
lb AS (SELECT ex.doc_id, max(CASE WHEN tk.e - tk.n <= a_start THEN tk.pos END) AS fs, min(CASE WHEN tk.e >= a_stop THEN tk.pos END) AS fe,
  list(CAST(tk.e - tk.n AS BIGINT)::VARCHAR || ':' || CAST(tk.e AS BIGINT)::VARCHAR ORDER BY tk.pos) AS offs
  FROM ex JOIN tk ON tk.doc_id = ex.doc_id WHERE NOT rejected AND tk.pos < len(ctx) GROUP BY ex.doc_id),
squad AS (SELECT ex.doc_id, rejected, CASE WHEN NOT rejected THEN cs END AS context_start, CASE WHEN NOT rejected THEN len(ctx) END AS context_len,
  CASE WHEN NOT rejected THEN list_resize(list_concat([{tk.CLS_ID}], q, [{tk.SEP_ID}], ctx, [{tk.SEP_ID}]), {SQUAD_MAX_LENGTH}, {tk.PAD_ID}) END AS input_ids,
  CASE WHEN NOT rejected THEN list_resize(list_resize({EMPTY}, len(q) + len(ctx) + 3, 1), {SQUAD_MAX_LENGTH}, 0) END AS attention_mask,
  CASE WHEN NOT rejected THEN list_resize(list_concat(list_resize(CAST([] AS VARCHAR[]), cs, '-'), coalesce(lb.offs, CAST([] AS VARCHAR[]))),
    {SQUAD_MAX_LENGTH}, '-') END AS offs,
  CAST(CASE WHEN rejected OR a_start IS NULL THEN NULL WHEN fs IS NULL OR fe IS NULL THEN 0 ELSE fs + cs END AS INTEGER) AS start_positions,
  CAST(CASE WHEN rejected OR a_start IS NULL THEN NULL WHEN fs IS NULL OR fe IS NULL THEN 0 ELSE fe + cs END AS INTEGER) AS end_positions,
  text FROM ex LEFT JOIN lb ON lb.doc_id = ex.doc_id)"""


_SQUAD_CTES = _squad_ctes(P, "lower({})", "text")
_SQUAD_COLUMNS = """SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask,
  array_to_string(offs, ' ') AS offset_mapping, CAST(context_start AS INTEGER) AS context_start, CAST(context_len AS INTEGER) AS context_len,
  start_positions, end_positions, md5(text) AS context_md5"""


@register("u1_squad", f"WITH {_SQUAD_CTES}\n{_SQUAD_COLUMNS}, CASE WHEN rejected THEN '{registry.NO_ROOM}' END AS reject_reason FROM squad")
def q_squad(spark, sf_dir):
    return _squad_shown(_squad(spark, sf_dir))


def _squad_shown(x):
    offsets = F.transform("offset_mapping", lambda o: F.coalesce(
        F.concat(o["start"].cast("string"), F.lit(":"), o["end"].cast("string")), F.lit("-")))
    return x.select(
        "doc_id", arr_str(F.col("input_ids")).alias("input_ids"), arr_str(F.col("attention_mask")).alias("attention_mask"),
        F.array_join(offsets, " ").alias("offset_mapping"), "context_start", "context_len", "start_positions", "end_positions",
        F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"), "reject_reason",
    )


# Tokens without case and accents; the tables' accented letters are single characters, so offsets are those of the plain text.
_UNCASED_P = f"{o.S}*([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}{o.U_SPACE}])"
_UNCASED_PLAIN = "lower(strip_accents({}))"


@register(
    "u5_uncased_squad",
    f"WITH {_squad_ctes(_UNCASED_P, _UNCASED_PLAIN, _UNCASED_PLAIN.format('text'))}\n"
    f"{_SQUAD_COLUMNS}, CASE WHEN rejected THEN '{registry.NO_ROOM}' END AS reject_reason FROM squad",
)
def q_uncased_squad(spark, sf_dir):
    """Span QA with a user's tokenizer that normalises the text: its offsets are those of the original characters."""
    tokenizer = tk.uncased_tokenizer()
    vocab = tk.build_vocab(table(spark, sf_dir, "documents", spread="doc_id").select(tokenizer(F.col("text")).alias("tokens")))
    return _squad_shown(registry.preprocess("squad", _squad_input(spark, sf_dir), vocab=vocab, max_length=SQUAD_MAX_LENGTH,
                                            id_col="doc_id", tokenizer=tokenizer))


@register(
    "r8_first_special_positions",
    f"""WITH {_SQUAD_CTES}
SELECT doc_id, CAST(list_position(input_ids, {tk.CLS_ID}) - 1 AS INTEGER) AS cls_index,
  CAST(list_position(input_ids, {tk.SEP_ID}) - 1 AS INTEGER) AS sep_index,
  CAST(coalesce(list_position(input_ids, {tk.PAD_ID}), 0) - 1 AS INTEGER) AS pad_index FROM squad WHERE NOT rejected""",
)
def q_first_special(spark, sf_dir):
    x = _squad(spark, sf_dir).where("reject_reason IS NULL")
    at = lambda i: tk.first_index(F.col("input_ids"), i)
    return x.select("doc_id", at(tk.CLS_ID).alias("cls_index"), at(tk.SEP_ID).alias("sep_index"), at(tk.PAD_ID).alias("pad_index"))


# Logits over the encoded positions: a fixed pattern, raised at the true label for every other document.
def _logit(a: int, b: int, label: str, i: str) -> str:
    return (f"CAST((doc_id * {a} + {i} * {b}) % 101 + CASE WHEN doc_id % 2 = 0 AND {i} = coalesce({label}, 0) THEN 200 ELSE 0 END AS DOUBLE)")


_START, _END = (31, 17, "start_positions"), (13, 29, "end_positions")


def _list_sql(logit) -> str:
    return f"list_transform(range({SQUAD_MAX_LENGTH}), lambda i: {_logit(*logit, 'i')})"


@register(
    "a14_squad_report",
    f"""WITH {_SQUAD_CTES},
e AS (SELECT doc_id, context_start AS lo, context_start + context_len AS hi, coalesce(start_positions, 0) AS ls,
  coalesce(end_positions, 0) AS le, {_list_sql(_START)} AS st, {_list_sql(_END)} AS en FROM squad WHERE NOT rejected),
s0 AS (SELECT doc_id, lo, hi, unnest(st) AS v, unnest(range({SQUAD_MAX_LENGTH})) AS pos FROM e),
sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, pos DESC) AS rk FROM s0),
e0 AS (SELECT doc_id, lo, hi, unnest(en) AS v, unnest(range({SQUAD_MAX_LENGTH})) AS pos FROM e),
er AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, pos DESC) AS rk FROM e0),
c AS (SELECT a.doc_id, a.pos AS ps, b.pos AS pe, a.v + b.v AS score, a.rk AS sk, b.rk AS ek FROM sr a JOIN er b ON a.doc_id = b.doc_id
  WHERE a.rk <= {sq.N_BEST_SIZE} AND b.rk <= {sq.N_BEST_SIZE} AND a.pos >= a.lo AND a.pos < a.hi AND b.pos >= b.lo AND b.pos < b.hi
  AND b.pos >= a.pos AND b.pos - a.pos + 1 <= {sq.MAX_ANSWER_LENGTH}),
b AS (SELECT doc_id, ps, pe FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sk, ek) AS r FROM c) x WHERE r = 1),
f AS (SELECT e.doc_id, ls, le, b.ps IS NULL AS fell_back, coalesce(b.ps, list_position(st, list_max(st)) - 1) AS ps,
  coalesce(b.pe, list_position(en, list_max(en)) - 1) AS pe FROM e LEFT JOIN b ON b.doc_id = e.doc_id),
g AS (SELECT *, greatest(pe - ps + 1, 0) AS pl, greatest(le - ls + 1, 0) AS tl, greatest(least(pe, le) - greatest(ps, ls) + 1, 0) AS cm FROM f),
h AS (SELECT *, CAST(CASE WHEN pl = 0 OR tl = 0 THEN (CASE WHEN pl = 0 AND tl = 0 THEN 1.0 ELSE 0.0 END) WHEN cm = 0 THEN 0.0
  ELSE 2 * (cm / pl) * (cm / tl) / ((cm / pl) + (cm / tl)) END AS DOUBLE) AS f1 FROM g)
SELECT fell_back, count(*) AS n_examples, CAST(sum(CAST(ps = ls AS BIGINT)) AS DOUBLE) / count(*) AS start_accuracy,
  CAST(sum(CAST(pe = le AS BIGINT)) AS DOUBLE) / count(*) AS end_accuracy,
  CAST(sum(CAST(ps = ls AND pe = le AS BIGINT)) AS DOUBLE) / count(*) AS exact_match,
  CAST(sum(CAST(ps <= pe AS BIGINT)) AS DOUBLE) / count(*) AS valid_span_ratio, round(sum(f1) / count(*), 9) AS f1
FROM h GROUP BY fell_back""",
)
def q_squad_report(spark, sf_dir):
    """Preparation to score: logits over the prepared examples, best spans, report by whether the fallback was needed."""
    x = _squad(spark, sf_dir).where("reject_reason IS NULL")
    logits = lambda l: F.expr(f"transform(sequence(0, {SQUAD_MAX_LENGTH - 1}), i -> {_logit(*l, 'i')})")
    label = lambda c: F.coalesce(c, F.lit(0))
    scored = x.select("doc_id", "offset_mapping", logits(_START).alias("start_logits"), logits(_END).alias("end_logits"),
                      label("start_positions").alias("start_label"), label("end_positions").alias("end_label"))
    decoded = sq.decode_spans(scored, None, "doc_id")
    return sq.span_qa_report(decoded.withColumn("fell_back", ~F.col("from_candidates")), ["fell_back"])


# --- long-form QA: title = source, first answer = text (none for every fourth document) ----------------
def _long_qa(spark, sf_dir):
    answers = F.expr("CASE WHEN doc_id % 4 = 3 THEN named_struct('text', CAST(array() AS array<string>)) ELSE named_struct('text', array(text, source)) END")
    return table(spark, sf_dir, "documents", spread="doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), answers.alias("answers"))


_LONG_SRC = "SELECT doc_id, 'Question: ' || source || chr(10) || 'Answer:' AS q, source AS t, CASE WHEN doc_id % 4 = 3 THEN '' ELSE coalesce(text, '') END AS a FROM documents"
_LONG_CTES = f"""vocab AS ({_DOC_VOCAB_SQL}), lsrc AS ({_LONG_SRC}),
{id_lists_sql('SELECT doc_id, q FROM lsrc', 'doc_id', 'q', 'vocab', 'lq')},
{id_lists_sql('SELECT doc_id, t FROM lsrc', 'doc_id', 't', 'vocab', 'lt')},
{id_lists_sql('SELECT doc_id, a FROM lsrc', 'doc_id', 'a', 'vocab', 'la')}"""


@register(
    "u1_eli5_qa",
    f"""WITH {_LONG_CTES},
p AS (SELECT q.doc_id, list_slice(q.ids, 1, {LONG_QA_MAX_LENGTH}) AS q, list_slice(a.ids, 1, {LONG_QA_MAX_LENGTH}) AS a FROM lq q JOIN la a ON a.doc_id = q.doc_id),
r AS (SELECT doc_id, list_slice(list_concat(q, a), 1, {LONG_QA_MAX_LENGTH}) AS ids,
  list_slice(list_concat(list_resize({EMPTY}, len(q), -100), a), 1, {LONG_QA_MAX_LENGTH}) AS labels FROM p)
SELECT doc_id AS id, array_to_string(list_resize(ids, {LONG_QA_MAX_LENGTH}, {tk.PAD_ID}), ' ') AS input_ids,
  array_to_string(list_resize(labels, {LONG_QA_MAX_LENGTH}, -100), ' ') AS labels FROM r""",
)
def q_eli5_qa(spark, sf_dir):
    x = registry.preprocess("eli5_qa", _long_qa(spark, sf_dir), vocab=_doc_vocab(spark, sf_dir), max_length=LONG_QA_MAX_LENGTH)
    return x.select("id", arr_str(F.col("input_ids")).alias("input_ids"), arr_str(F.col("labels")).alias("labels"))


@register(
    "u1_eli5_clm",
    f"""WITH {_LONG_CTES},
p AS (SELECT t.doc_id, list_concat(t.ids, a.ids) AS ids FROM lt t JOIN la a ON a.doc_id = t.doc_id),
b AS (SELECT doc_id, ids, unnest(range(len(ids) // {tk.CLM_BLOCK_SIZE})) AS block FROM p)
SELECT doc_id AS id, CAST(block AS INTEGER) AS block,
  array_to_string(list_slice(ids, block * {tk.CLM_BLOCK_SIZE} + 1, (block + 1) * {tk.CLM_BLOCK_SIZE}), ' ') AS input_ids FROM b""",
)
def q_eli5_clm(spark, sf_dir):
    x = registry.preprocess("eli5_clm", _long_qa(spark, sf_dir), vocab=_doc_vocab(spark, sf_dir))
    return x.select("id", F.col("block").cast("int"), arr_str(F.col("input_ids")).alias("input_ids"))


# --- nested dialogues with the training roles; every other role is dropped ------------------------------
_NAMES = f"CASE role WHEN 'user' THEN '{dl.JUNIOR_ROLE}' WHEN 'assistant' THEN '{dl.SENIOR_ROLE}' ELSE role END"


@register(
    "u1_socratic",
    f"""WITH m AS (SELECT conv_id, string_agg('|' || role || '=' || coalesce(text, ''), '' ORDER BY turn) AS body
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT p.conv_id, 'system=' || {_POLICY_PROMPT_SQL} || coalesce(m.body, '') AS rendered
FROM ({_POLICIES_SQL}) p LEFT JOIN m ON m.conv_id = p.conv_id""",
)
def q_socratic(spark, sf_dir):
    nested = dl.to_messages(_turns(spark, sf_dir).withColumn("role", F.expr(_NAMES)))
    policy = _policies(spark, sf_dir).select("conv_id", F.struct("withhold_final_answer", "avoid_numeric_rules_of_thumb").alias("policy"))
    x = registry.preprocess("socratic", nested.withColumnRenamed("messages", "turns").join(policy, "conv_id"))
    shown = F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), F.coalesce(m["content"], F.lit(""))))
    return x.select("conv_id", F.array_join(shown, "|").alias("rendered"))
