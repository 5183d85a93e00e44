"""Catalogue: dialogue operators over the whole ``conversations`` table
(P9-P12, P16, W1, W2, T20-T22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators import dialogue as dl
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table

CHAT_ROLES = {"user": "user", "assistant": "assistant"}
_STRIP = o.unicode_patterns()["strip"]
NL = "chr(10)"


def sql_str(s: str) -> str:
    """A Python string as a SQL expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return f" || {NL} || ".join(parts)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _policies(spark, sf_dir):
    """One policy per conversation, derived from its id (all four flag combinations occur)."""
    return (
        _turns(spark, sf_dir)
        .select("conv_id")
        .distinct()
        .select(
            "conv_id",
            (F.col("conv_id") % 2 == 0).alias("withhold_final_answer"),
            (F.col("conv_id") % 3 == 0).alias("avoid_numeric_rules_of_thumb"),
        )
    )


_POLICIES_SQL = """SELECT conv_id, conv_id % 2 = 0 AS withhold_final_answer,
  conv_id % 3 = 0 AS avoid_numeric_rules_of_thumb FROM conversations GROUP BY conv_id"""
_POLICY_PROMPT_SQL = f"""CASE WHEN withhold_final_answer OR avoid_numeric_rules_of_thumb THEN
  {sql_str(dl.POLICY_BASE_PROMPT + dl.POLICY_RULE_INTRO)} ||
  CASE WHEN withhold_final_answer AND avoid_numeric_rules_of_thumb
       THEN {sql_str(dl.POLICY_WITHHOLD_TEXT + dl.POLICY_JOINER + dl.POLICY_AVOID_NUMERIC_TEXT)}
       WHEN withhold_final_answer THEN {sql_str(dl.POLICY_WITHHOLD_TEXT)}
       ELSE {sql_str(dl.POLICY_AVOID_NUMERIC_TEXT)} END || '.'
  ELSE {sql_str(dl.POLICY_BASE_PROMPT + dl.POLICY_DEFAULT_TEXT)} END"""

def last_sql(source: str = "conversations") -> str:
    """The last pair by turn order, from the definition: a message and the next one present."""
    return f"""SELECT conv_id, max(turn) AS last_user_turn, max(next_turn) AS target_turn FROM (
  SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM {source}
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) n
WHERE role = 'user' AND next_role = 'assistant' GROUP BY conv_id"""


_LAST_SQL = last_sql()
# Conversations with messages taken out, so that turn numbers have gaps.
GAPS = "(conv_id * 7 + turn * 3) % 4 <> 1"

_PLAIN_SEG = f"upper(coalesce(role, 'user')) || ':' || {NL} || coalesce(text, '')"


@register("w1_last_exchange", _LAST_SQL)
def q_last_exchange(spark, sf_dir):
    return dl.last_exchange(_turns(spark, sf_dir))


@register("w1_last_exchange_with_gaps", last_sql(f"(SELECT * FROM conversations WHERE {GAPS}) g"))
def q_last_exchange_gaps(spark, sf_dir):
    return dl.last_exchange(_turns(spark, sf_dir).where(GAPS))


_EVAL_SQL = f"""WITH last AS ({_LAST_SQL}),
pt AS (SELECT c.* FROM conversations c JOIN last l ON c.conv_id = l.conv_id WHERE c.turn <= l.last_user_turn),
r AS (SELECT conv_id, string_agg({_PLAIN_SEG}, {NL} || {NL} ORDER BY turn) AS j FROM pt GROUP BY conv_id)
SELECT r.conv_id, regexp_replace(j, '{_STRIP}', '', 'g') || {sql_str(dl.ASSISTANT_HEADER)} AS prompt,
  l.target_turn, coalesce(c.text, '') AS target
FROM r JOIN last l ON r.conv_id = l.conv_id
JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.target_turn"""


@register("w2_eval_prompts_with_gaps", f"WITH g AS (SELECT * FROM conversations WHERE {GAPS})," +
          _EVAL_SQL.replace("conversations", "g").removeprefix("WITH"))
def q_eval_prompts_gaps(spark, sf_dir):
    return dl.eval_examples(_turns(spark, sf_dir).where(GAPS), mode="messages")


@register("w2_eval_prompts", _EVAL_SQL)
def q_eval_prompts(spark, sf_dir):
    return dl.eval_examples(_turns(spark, sf_dir), mode="messages")


@register(
    "p16_nonempty_targets",
    f"""WITH last AS ({_LAST_SQL})
SELECT c.conv_id, c.turn AS target_turn FROM conversations c JOIN last l
  ON c.conv_id = l.conv_id AND c.turn = l.target_turn
WHERE coalesce(CASE WHEN c.conv_id % 3 = 0 THEN '' WHEN c.conv_id % 3 = 1 THEN c.text END, '') <> ''""",
)
def q_nonempty_targets(spark, sf_dir):
    """Every third conversation has empty texts, every third has none."""
    text = F.expr("CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN text END")
    _, targets = dl.split_prompt_target(_turns(spark, sf_dir).withColumn("text", text))
    return dl.nonempty_targets(targets).select("conv_id", "target_turn")


@register(
    "t20_render_plain",
    f"""SELECT conv_id, regexp_replace(string_agg({_PLAIN_SEG}, {NL} || {NL} ORDER BY turn), '{_STRIP}', '', 'g')
  AS rendered FROM conversations GROUP BY conv_id""",
)
def q_render_plain(spark, sf_dir):
    return dl.render_plain(_turns(spark, sf_dir))


@register(
    "t22_render_tagged",
    f"""SELECT conv_id, string_agg(CASE WHEN role IN ('system', 'user', 'assistant')
    THEN '<|' || role || '|>' || {NL} || coalesce(text, '') || {NL} ELSE {NL} END, '' ORDER BY turn) || '</s>'
  AS rendered FROM conversations GROUP BY conv_id""",
)
def q_render_tagged(spark, sf_dir):
    return dl.render_tagged(_turns(spark, sf_dir), eos="</s>")


@register(
    "p9_train_roles",
    """SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')""",
)
def q_train_roles(spark, sf_dir):
    return dl.map_roles_train(_turns(spark, sf_dir), CHAT_ROLES).select("conv_id", "turn", "role", "text")


@register(
    "p10_eval_roles",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant'
  ELSE 'user' END AS role, text FROM conversations""",
)
def q_eval_roles(spark, sf_dir):
    return dl.map_roles_eval(_turns(spark, sf_dir), CHAT_ROLES).select("conv_id", "turn", "role", "text")


@register("p11_policy_prompts", f"SELECT conv_id, {_POLICY_PROMPT_SQL} AS system_prompt FROM ({_POLICIES_SQL}) p")
def q_policy_prompts(spark, sf_dir):
    p = _policies(spark, sf_dir)
    return p.select("conv_id", dl.policy_system_prompt("withhold_final_answer", "avoid_numeric_rules_of_thumb")
                    .alias("system_prompt"))


@register(
    "p12_training_messages",
    f"""SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT conv_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, {_POLICY_PROMPT_SQL} AS text
FROM ({_POLICIES_SQL}) p""",
)
def q_training_messages(spark, sf_dir):
    return dl.training_messages(_turns(spark, sf_dir), _policies(spark, sf_dir), CHAT_ROLES)


# Nested form, rendered as one string per conversation (system message first, then the messages in order).
@register(
    "p12_training_messages_nested",
    f"""WITH m AS (SELECT conv_id, string_agg('|' || role || '=' || coalesce(text, ''), '' ORDER BY turn) AS body
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT p.conv_id, 'system=' || {_POLICY_PROMPT_SQL} || coalesce(m.body, '') AS rendered
FROM ({_POLICIES_SQL}) p LEFT JOIN m ON m.conv_id = p.conv_id""",
)
def q_training_messages_nested(spark, sf_dir):
    nested = dl.to_messages(_turns(spark, sf_dir))
    joined = nested.join(_policies(spark, sf_dir), "conv_id")
    system = dl.policy_system_prompt("withhold_final_answer", "avoid_numeric_rules_of_thumb")
    messages = dl.nested_messages(F.col("messages"), system, CHAT_ROLES)
    shown = F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), F.coalesce(m["content"], F.lit(""))))
    return joined.select("conv_id", F.array_join(shown, "|").alias("rendered"))


# Per record: ``messages`` if that is a non-empty list, else ``turns`` (here the messages in reverse).
@register(
    "w2_record_messages",
    """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN string_agg(coalesce(role, ''), '|' ORDER BY turn)
  ELSE string_agg(coalesce(role, ''), '|' ORDER BY turn DESC) END AS roles FROM conversations GROUP BY conv_id""",
)
def q_record_messages(spark, sf_dir):
    nested = dl.to_messages(_turns(spark, sf_dir))
    none = F.when(F.col("conv_id") % 3 == 1, F.slice("messages", 1, 0))  # an empty list, or null for conv_id % 3 = 2
    messages = F.when(F.col("conv_id") % 3 == 0, F.col("messages")).otherwise(none)
    picked = dl.record_messages(messages, F.reverse("messages"))
    return nested.select("conv_id", F.array_join(F.transform(picked, lambda m: F.coalesce(m["role"], F.lit(""))), "|").alias("roles"))
