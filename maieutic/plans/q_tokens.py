"""Catalogue: token operators.

Token ids come from the full vocabularies of the whole tables (for conversations: of the
user messages, so the other roles have unknown words).  QA examples are all
adjacent message pairs of every conversation (question = the message, answer = the
next one), with an empty question for every seventh and an empty answer for
every fifth pair, so that the supervision checks have something to find.  Arrays are rendered as space-joined strings
so that both engines compare plain values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators import dialogue as dl
from maieutic.operators import tokens as tk
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import spread_if_few, table

QA_MAX_LENGTH, DIALOGUE_MAX_LENGTH = 256, 4096
# Fixed value: the long-form QA prompt format.
QA_PROMPT_PREFIX, QA_PROMPT_SUFFIX = "Question: ", "\nAnswer:"

P = f"{o.S}*({o.W}+|[^{o.U_WORD}{o.U_SPACE}])"
EMPTY = "CAST([] AS INTEGER[])"


def arr_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def vocab_sql(texts_sql: str, pattern: str = P, plain: str = "lower({})") -> str:
    specials = " UNION ALL ".join(
        f"SELECT '{t}' AS token, {i} AS id, true AS is_special" for i, t in enumerate(tk.SPECIAL_TOKENS)
    )
    n = len(tk.SPECIAL_TOKENS)
    return f"""SELECT token, CAST(id AS INTEGER) AS id, is_special FROM ({specials}) sp
UNION ALL SELECT token, CAST(id AS INTEGER) AS id, false AS is_special FROM (
  SELECT token, row_number() OVER (ORDER BY cnt DESC, md5(token), token) + {n - 1} AS id FROM (
    SELECT token, count(*) AS cnt FROM (
      SELECT unnest(regexp_extract_all({plain.format("coalesce(text, '')")}, '{pattern}', 1)) AS token FROM ({texts_sql}) s0) s1
    GROUP BY token) c) t"""


def id_lists_sql(src: str, keys: str, text_expr: str, vocab: str, name: str, pattern: str = P, plain: str = "lower({})") -> str:
    """CTEs ending in ``{name}(keys..., ids)``; every source row appears (empty list if no token)."""
    kl = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = l.{k}" for k in kl)
    return f"""{name}_t AS (SELECT {keys}, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM (
    SELECT {keys}, regexp_extract_all({plain.format(f"coalesce({text_expr}, '')")}, '{pattern}', 1) AS toks FROM ({src}) s0) s1),
{name}_e AS (SELECT {', '.join('t.' + k for k in kl)}, t.pos, coalesce(v.id, {tk.UNK_ID}) AS tid
    FROM {name}_t t LEFT JOIN {vocab} v ON t.token = v.token AND NOT v.is_special),
{name}_l AS (SELECT {keys}, list(tid ORDER BY pos) AS ids FROM {name}_e GROUP BY {keys}),
{name} AS (SELECT {', '.join('s.' + k for k in kl)}, coalesce(l.ids, {EMPTY}) AS ids FROM ({src}) s
    LEFT JOIN {name}_l l ON {on})"""


# --- W5 -------------------------------------------------------------------------------
@register(
    "w5_token_offsets",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{P}', 0) AS pieces,
    regexp_extract_all(coalesce(text, ''), '{P}', 1) AS toks FROM documents),
e AS (SELECT doc_id, unnest(pieces) AS piece, unnest(toks) AS tok, unnest(range(len(pieces))) AS pos FROM t),
r AS (SELECT doc_id, pos, tok, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM e)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, lower(tok) AS token, CAST(e - length(tok) AS INTEGER) AS start,
  CAST(e AS INTEGER) AS "end" FROM r""",
)
def q_token_offsets(spark, sf_dir):
    return tk.token_offsets(table(spark, sf_dir, "documents"), "doc_id")


def _doc_vocab(spark, sf_dir):
    d = table(spark, sf_dir, "documents", spread="doc_id")
    return tk.build_vocab(d.select(tk.word_tokens(F.col("text")).alias("tokens")))


_DOC_VOCAB_SQL = vocab_sql("SELECT text FROM documents")


@register("j6_vocab_documents", _DOC_VOCAB_SQL)
def q_vocab(spark, sf_dir):
    return _doc_vocab(spark, sf_dir)


TOP_TOKENS = 2000


@register("j6_top_vocabulary", f"SELECT * FROM ({_DOC_VOCAB_SQL}) v WHERE id < {TOP_TOKENS + len(tk.SPECIAL_TOKENS)}")
def q_top_vocab(spark, sf_dir):
    """The most frequent tokens by bounded summaries and a second pass over the candidates."""
    d = table(spark, sf_dir, "documents")
    return tk.build_vocab(d.select(tk.word_tokens(F.col("text")).alias("tokens")), size=TOP_TOKENS)


def _doc_ids(spark, sf_dir, vocab):
    d = table(spark, sf_dir, "documents", spread="doc_id")
    toks = d.select("doc_id", tk.word_tokens(F.col("text")).alias("tokens"))
    return tk.encode(toks, "doc_id", "tokens", vocab, "ids")


_DOC_IDS_CTES = f"""vocab AS ({_DOC_VOCAB_SQL}),
{id_lists_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text', 'vocab', 'dids')}"""


@register(
    "j6_encode_documents",
    f"""WITH {_DOC_IDS_CTES}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(len(list_filter(ids, lambda x: x = {tk.UNK_ID})) AS BIGINT) AS n_unk,
  array_to_string(ids, ' ') AS ids FROM dids""",
)
def q_encode(spark, sf_dir):
    e = _doc_ids(spark, sf_dir, _doc_vocab(spark, sf_dir))
    return e.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.size(F.filter("ids", lambda x: x == tk.UNK_ID)).cast("bigint").alias("n_unk"),
        arr_str(F.col("ids")).alias("ids"),
    )


@register(
    "j5_decode_documents",
    f"""WITH {_DOC_IDS_CTES},
u AS (SELECT doc_id, unnest(ids) AS tid, unnest(range(len(ids))) AS pos FROM dids),
j AS (SELECT u.doc_id, u.pos, v.token FROM u JOIN vocab v ON u.tid = v.id AND NOT v.is_special),
s AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.text, '') AS text FROM dids d LEFT JOIN s ON d.doc_id = s.doc_id""",
)
def q_decode(spark, sf_dir):
    d = spread_if_few(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    toks = d.select("doc_id", tk.word_tokens(F.col("text")).alias("tokens"))
    vocab = tk.build_vocab(toks.select("tokens"))
    ids = tk.encode(toks, "doc_id", "tokens", vocab, "ids", in_place=True)
    return tk.decode(ids, "doc_id", "ids", vocab, "text", in_place=True)


# --- QA examples over all adjacent messages of every conversation ---------------------------
def _user_vocab(turns):
    """All tokens of the user messages; a word that only other roles say is unknown to it."""
    users = turns.where(F.col("role") == "user")
    return tk.build_vocab(users.select(tk.word_tokens(F.col("text")).alias("tokens")))


_USER_VOCAB_SQL = vocab_sql("SELECT text FROM conversations WHERE role = 'user'")


def _qa_examples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    after = turns.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("_next"))
    pairs = turns.join(after, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    no_q, no_a = F.expr("(conv_id + turn) % 7 = 0"), F.expr("(conv_id + turn) % 5 = 0")
    prompt = F.concat(F.lit(QA_PROMPT_PREFIX), F.coalesce("text", F.lit("")), F.lit(QA_PROMPT_SUFFIX))
    ex = pairs.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pair_id"),
        tk.word_tokens(F.when(no_q, F.lit("")).otherwise(prompt)).alias("q"),
        tk.word_tokens(F.when(no_a, F.lit("")).otherwise(F.col("_next"))).alias("a"),
    )
    vocab = _user_vocab(turns)
    both = tk.encode(ex, "pair_id", ["q", "a"], vocab, ["q_ids", "a_ids"])
    return both.select("pair_id", tk.prompt_answer_example(F.col("q_ids"), F.col("a_ids"), QA_MAX_LENGTH).alias("x"))


_QA_CTES = f"""ex AS (SELECT u.conv_id * 1000000 + u.turn AS pair_id, CASE WHEN (u.conv_id + u.turn) % 7 = 0 THEN '' ELSE
    'Question: ' || coalesce(u.text, '') || chr(10) || 'Answer:' END AS q_text,
    CASE WHEN (u.conv_id + u.turn) % 5 = 0 THEN '' ELSE coalesce(a.text, '') END AS a_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
cvocab AS ({_USER_VOCAB_SQL}),
{id_lists_sql('SELECT pair_id, q_text FROM ex', 'pair_id', 'q_text', 'cvocab', 'qids')},
{id_lists_sql('SELECT pair_id, a_text FROM ex', 'pair_id', 'a_text', 'cvocab', 'aids')},
parts AS (SELECT q.pair_id, list_slice(q.ids, 1, {QA_MAX_LENGTH}) AS q, list_slice(a.ids, 1, {QA_MAX_LENGTH}) AS a
  FROM qids q JOIN aids a ON q.pair_id = a.pair_id),
raw AS (SELECT pair_id, list_slice(list_concat(q, a), 1, {QA_MAX_LENGTH}) AS ids,
  list_slice(list_concat(list_resize({EMPTY}, len(q), -100), a), 1, {QA_MAX_LENGTH}) AS labels FROM parts),
qa AS (SELECT pair_id, list_resize(ids, {QA_MAX_LENGTH}, {tk.PAD_ID}) AS input_ids,
  list_resize(list_resize({EMPTY}, len(ids), 1), {QA_MAX_LENGTH}, 0) AS attention_mask,
  list_resize(labels, {QA_MAX_LENGTH}, -100) AS labels FROM raw)"""


@register(
    "r1_r5_qa_examples",
    f"""WITH {_QA_CTES}
SELECT pair_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask,
  array_to_string(labels, ' ') AS labels FROM qa""",
)
def q_qa_examples(spark, sf_dir):
    x = _qa_examples(spark, sf_dir)
    return x.select("pair_id", arr_str(F.col("x.input_ids")).alias("input_ids"),
                    arr_str(F.col("x.attention_mask")).alias("attention_mask"), arr_str(F.col("x.labels")).alias("labels"))


@register(
    "r6_r7_label_views",
    f"""WITH {_QA_CTES}
SELECT pair_id, array_to_string(list_filter(labels, lambda x: x <> -100), ' ') AS answer_labels,
  array_to_string(list_transform(range(len(input_ids)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN input_ids[i + 1]
    ELSE {tk.PAD_ID} END), ' ') AS masked_ids FROM qa""",
)
def q_label_views(spark, sf_dir):
    x = _qa_examples(spark, sf_dir)
    return x.select("pair_id", arr_str(tk.answer_labels(F.col("x.labels"))).alias("answer_labels"),
                    arr_str(tk.masked_view(F.col("x.input_ids"), F.col("x.labels"))).alias("masked_ids"))


def _unpadded(x):
    """Examples without their padding (as long as the attention mask says)."""
    n = F.size(F.filter("x.attention_mask", lambda m: m == 1))
    return x.select("pair_id", F.slice("x.input_ids", F.lit(1), n).alias("input_ids"), F.slice("x.labels", F.lit(1), n).alias("labels"))


_CHECK_SQL = """CAST(len(input_ids) AS BIGINT) AS total_tokens,
  CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS target_tokens"""


@register(
    "p13_a16_a17_supervision_checks",
    f"""WITH {_QA_CTES}, un AS (SELECT pair_id, list_slice(input_ids, 1, list_sum(attention_mask)) AS input_ids,
  list_slice(labels, 1, list_sum(attention_mask)) AS labels FROM qa), c AS (SELECT pair_id, {_CHECK_SQL},
  CAST(len(list_filter(input_ids, lambda x: x = {tk.UNK_ID})) AS BIGINT) AS unk_full,
  CAST(len(list_filter(list_transform(range(len(input_ids)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN input_ids[i + 1]
    ELSE {tk.PAD_ID} END), lambda x: x = {tk.UNK_ID})) AS BIGINT) AS unk_masked FROM un)
SELECT pair_id, total_tokens, target_tokens, total_tokens - target_tokens AS masked_tokens, unk_full, unk_masked,
  CASE WHEN total_tokens = 0 THEN '0 tokens' WHEN target_tokens = 0 THEN 'no target tokens'
       WHEN target_tokens >= total_tokens THEN 'all tokens are targets' END AS reason,
  NOT (total_tokens = 0 OR target_tokens = 0 OR target_tokens >= total_tokens) AS valid FROM c""",
)
def q_supervision_checks(spark, sf_dir):
    x = _unpadded(_qa_examples(spark, sf_dir))
    s = tk.supervision_counts(F.col("input_ids"), F.col("labels"))
    return x.select("pair_id", s.alias("s")).select("pair_id", "s.*")


@register(
    "a16_a17_corpus_counts",
    f"""WITH {_QA_CTES}, un AS (SELECT pair_id, list_slice(input_ids, 1, list_sum(attention_mask)) AS input_ids,
  list_slice(labels, 1, list_sum(attention_mask)) AS labels FROM qa), c AS (SELECT {_CHECK_SQL},
  CAST(len(list_filter(input_ids, lambda x: x = {tk.UNK_ID})) AS BIGINT) AS unk_full,
  CAST(len(list_filter(list_transform(range(len(input_ids)), lambda i: CASE WHEN labels[i + 1] <> -100 THEN input_ids[i + 1]
    ELSE {tk.PAD_ID} END), lambda x: x = {tk.UNK_ID})) AS BIGINT) AS unk_masked FROM un)
SELECT count(*) AS n_examples, sum(total_tokens) AS total_tokens, sum(target_tokens) AS target_tokens,
  sum(total_tokens - target_tokens) AS masked_tokens, sum(unk_full) AS unk_full, sum(unk_masked) AS unk_masked,
  CAST(sum(CASE WHEN total_tokens = 0 OR target_tokens = 0 OR target_tokens >= total_tokens THEN 1 ELSE 0 END) AS BIGINT)
  AS n_invalid FROM c""",
)
def q_corpus_counts(spark, sf_dir):
    return tk.sequence_counts(_unpadded(_qa_examples(spark, sf_dir)))


# --- W4: causal-LM blocks over documents (title = source, answer = text) -----------------
@register(
    "w4_clm_blocks",
    f"""WITH {_DOC_IDS_CTES},
{id_lists_sql('SELECT doc_id, source FROM documents', 'doc_id', 'source', 'vocab', 'sids')},
full_ids AS (SELECT s.doc_id, list_concat(s.ids, d.ids) AS ids FROM sids s JOIN dids d ON s.doc_id = d.doc_id),
b AS (SELECT doc_id, ids, unnest(range(len(ids) // {tk.CLM_BLOCK_SIZE})) AS block FROM full_ids)
SELECT doc_id, CAST(block AS INTEGER) AS block,
  array_to_string(list_slice(ids, block * {tk.CLM_BLOCK_SIZE} + 1, (block + 1) * {tk.CLM_BLOCK_SIZE}), ' ') AS input_ids
FROM b""",
)
def q_clm_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents", spread="doc_id")
    rows = d.select("doc_id", tk.word_tokens(F.col("source")).alias("s"), tk.word_tokens(F.col("text")).alias("t"))
    ids = tk.encode(rows.select("doc_id", F.concat("s", "t").alias("t")), "doc_id", "t", _doc_vocab(spark, sf_dir), "ids")
    blocks = ids.select("doc_id", F.posexplode(tk.clm_blocks(F.col("ids"))).alias("block", "b"))
    return blocks.select("doc_id", F.col("block").cast("int"), arr_str(F.col("b")).alias("input_ids"))


# --- R12: assistant-only labels over whole dialogues --------------------------------------
_DIALOGUE_CTES = f"""cvocab AS ({_USER_VOCAB_SQL}),
{id_lists_sql('SELECT conv_id, turn, role, text FROM conversations', 'conv_id, turn, role', 'text', 'cvocab', 'tids')},
seg AS (SELECT conv_id, turn,
  CASE role WHEN 'system' THEN list_concat([{tk.ROLE_TAG_IDS['system']}], ids)
            WHEN 'user' THEN list_concat([{tk.ROLE_TAG_IDS['user']}], ids)
            WHEN 'assistant' THEN list_concat([{tk.ROLE_TAG_IDS['assistant']}], ids) ELSE {EMPTY} END AS si,
  CASE WHEN role = 'assistant' THEN list_concat([-100], ids)
       WHEN role IN ('system', 'user') THEN list_resize({EMPTY}, len(ids) + 1, -100) ELSE {EMPTY} END AS sl
  FROM tids),
agg AS (SELECT conv_id, list_concat(flatten(list(si ORDER BY turn)), [{tk.EOS_ID}]) AS ids,
  list_concat(flatten(list(sl ORDER BY turn)), [-100]) AS labels FROM seg GROUP BY conv_id)"""


@register(
    "r12_assistant_labels",
    f"""WITH {_DIALOGUE_CTES}
SELECT conv_id, array_to_string(list_slice(ids, 1, {DIALOGUE_MAX_LENGTH}), ' ') AS input_ids,
  array_to_string(list_slice(labels, 1, {DIALOGUE_MAX_LENGTH}), ' ') AS labels FROM agg""",
)
def q_assistant_labels(spark, sf_dir):
    out = _dialogue_examples(spark, sf_dir)
    return out.select("conv_id", arr_str(F.col("input_ids")).alias("input_ids"), arr_str(F.col("labels")).alias("labels"))


def _dialogue_examples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ids = tk.encode(turns.select("conv_id", "turn", "role", tk.word_tokens(F.col("text")).alias("t")),
                    ["conv_id", "turn", "role"], "t", _user_vocab(turns), "ids")
    return tk.assistant_only_labels(ids, "conv_id", "ids", DIALOGUE_MAX_LENGTH)


@register(
    "w3_target_spans",
    f"""WITH {_DIALOGUE_CTES},
cut AS (SELECT conv_id, list_slice(labels, 1, {DIALOGUE_MAX_LENGTH}) AS labels FROM agg),
sp AS (SELECT conv_id, list_filter(range(len(labels)), lambda i: labels[i + 1] <> -100 AND (i = 0 OR labels[i] = -100)) AS st,
  list_filter(range(len(labels)), lambda i: labels[i + 1] <> -100 AND (i = len(labels) - 1 OR labels[i + 2] = -100)) AS en
  FROM cut)
SELECT conv_id, CAST(len(st) AS BIGINT) AS n_spans,
  array_to_string(list_transform(range(len(st)), lambda k: CAST(st[k + 1] AS VARCHAR) || ':' || CAST(en[k + 1] + 1 AS VARCHAR)), ' ')
  AS spans FROM sp""",
)
def q_target_spans(spark, sf_dir):
    """One run of supervised labels per assistant message that has tokens."""
    spans = tk.target_spans(F.col("labels"))
    shown = F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return _dialogue_examples(spark, sf_dir).select(
        "conv_id", F.size(spans).cast("bigint").alias("n_spans"), F.array_join(shown, " ").alias("spans")
    )
