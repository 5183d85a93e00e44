"""Dialogue normalisation, last-exchange extraction and prompt rendering.

Long form ``(conv_id, turn, role, text)`` is the compute shape; ``turn`` is
the 0-based position of the message in its conversation (``explode_dialogue``
produces it from the nested form).  Messages are adjacent in the order of their turns, whatever gaps the
turn numbers have (dropped roles leave some).  A conversation is cut into chunks of
``turn div 256``; pairs inside a chunk are found in-row, and only one summary row per
chunk is ordered per conversation, so no task sorts a whole conversation.

Ordered concatenation (rendering, re-nesting) is done in two levels: first per
``(conv_id, turn div chunk)``, then per conversation over the chunk results,
so no task sorts more than ``chunk`` turns of a conversation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.functions import text_rules as tr

# ---------------------------------------------------------------------------
# Role names, system prompts and policy sentences, exactly as
# the metric and training definitions use them.
# ---------------------------------------------------------------------------
JUNIOR_ROLE = "junior_engineer"
SENIOR_ROLE = "senior_engineer"
DEFAULT_ROLE_MAP = {JUNIOR_ROLE: "user", SENIOR_ROLE: "assistant"}
EVAL_SYSTEM_PROMPT = (
    "You are a senior hardware engineer. Teach using Socratic questions. "
    "Do not reveal the final answer. Avoid numeric rules-of-thumb."
)
POLICY_BASE_PROMPT = (
    "You are a senior engineer who teaches by asking guided questions. The Hint level hint_level: \n"
    " 1 = Socratic clarification \n 2 = Physical intuition \n 3 = System-level reasoning \n"
)
POLICY_WITHHOLD_TEXT = "withhold the final answer"
POLICY_AVOID_NUMERIC_TEXT = "avoid numeric rules of thumb"
POLICY_JOINER = " and "
POLICY_RULE_INTRO = "\nYour policy that you must follow under all circumstances is to "
POLICY_DEFAULT_TEXT = "\nProvide clear, direct answers with examples when helpful."
PLAIN_HEADER_SEP = ":\n"
PLAIN_MESSAGE_SEP = "\n\n"
ASSISTANT_HEADER = "\n\nASSISTANT:\n"
# ---------------------------------------------------------------------------

DEFAULT_CHUNK = 256


def explode_dialogue(
    df: DataFrame,
    id_col: str = "conv_id",
    array_col: str = "turns",
    role_field: str = "role",
    content_field: str = "content",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Nested ``array<struct<role, content>>`` to long ``(id, turn, role, text)``.

    Works for both dialogue schemas (``turns`` or ``messages``); no shuffle.
    """
    exploded = df.select(id_col, *keep, F.posexplode_outer(array_col).alias("turn", "_m"))
    return exploded.where(F.col("_m").isNotNull()).select(
        id_col,
        *keep,
        F.col("turn").cast("bigint").alias("turn"),
        F.col(f"_m.{role_field}").alias("role"),
        F.col(f"_m.{content_field}").alias("text"),
    )


def _mapped_role(role: Column, role_map: Mapping[str, str]) -> Column:
    expr = None
    for src, dst in role_map.items():
        expr = (F.when(role == src, F.lit(dst))) if expr is None else expr.when(role == src, F.lit(dst))
    return expr if expr is not None else F.lit(None).cast("string")


def map_roles_train(df: DataFrame, role_map: Mapping[str, str] = DEFAULT_ROLE_MAP) -> DataFrame:
    """Training normalisation (P9): map roles, drop turns whose role is not in the map."""
    return df.withColumn("role", _mapped_role(F.col("role"), role_map)).where(F.col("role").isNotNull())


def map_roles_eval(df: DataFrame, role_map: Mapping[str, str] = DEFAULT_ROLE_MAP) -> DataFrame:
    """Evaluation normalisation (P10): map roles, anything else becomes ``user``."""
    return df.withColumn("role", F.coalesce(_mapped_role(F.col("role"), role_map), F.lit("user")))


def nested_messages(turns: Column, system: Column | None = None, role_map: Mapping[str, str] = DEFAULT_ROLE_MAP,
                    role_field: str = "role", content_field: str = "content") -> Column:
    """``array<struct<role, content>>`` with mapped roles, others dropped, the system message first (P9, P12 in-row)."""
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    known = F.filter(F.coalesce(turns, F.array()), lambda m: m[role_field].isin(list(role_map)))
    mapped = F.transform(known, lambda m: message(_mapped_role(m[role_field], role_map), m[content_field]))
    return mapped if system is None else F.concat(F.array(message(F.lit("system"), system)), mapped)


def record_messages(messages: Column, turns: Column) -> Column:
    """Per record: its ``messages`` if that is a non-empty list, else its ``turns`` (evaluation input)."""
    return F.when(F.size(F.coalesce(messages, F.array())) > 0, messages).otherwise(turns)


def policy_system_prompt(withhold, avoid_numeric) -> Column:
    """System prompt of a policy (P11); flags are tested by truthiness (NULL = off)."""
    w = F.coalesce(F.col(withhold) if isinstance(withhold, str) else withhold, F.lit(False))
    a = F.coalesce(F.col(avoid_numeric) if isinstance(avoid_numeric, str) else avoid_numeric, F.lit(False))
    parts = F.array_compact(F.array(F.when(w, F.lit(POLICY_WITHHOLD_TEXT)), F.when(a, F.lit(POLICY_AVOID_NUMERIC_TEXT))))
    rules = F.concat(F.lit(POLICY_BASE_PROMPT + POLICY_RULE_INTRO), F.array_join(parts, POLICY_JOINER), F.lit("."))
    return F.when(F.size(parts) > 0, rules).otherwise(F.lit(POLICY_BASE_PROMPT + POLICY_DEFAULT_TEXT))


def prepend_system(turns: DataFrame, system: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Add one system message per conversation at ``turn = -1``.

    ``system`` has one row per conversation: ``(id_col, text)``.
    """
    sys_rows = system.select(
        id_col, F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.col("text")
    )
    return turns.select(id_col, "turn", "role", "text").unionByName(sys_rows)


def training_messages(
    turns: DataFrame,
    policies: DataFrame,
    role_map: Mapping[str, str] = DEFAULT_ROLE_MAP,
    id_col: str = "conv_id",
) -> DataFrame:
    """Long-form training messages (P9, P11, P12): policy system prompt + mapped turns.

    ``policies``: ``(id_col, withhold_final_answer, avoid_numeric_rules_of_thumb)``.
    """
    system = policies.select(
        id_col,
        policy_system_prompt("withhold_final_answer", "avoid_numeric_rules_of_thumb").alias("text"),
    )
    return prepend_system(map_roles_train(turns, role_map), system, id_col)


def last_exchange(
    turns: DataFrame,
    user_role: str | Sequence[str] = "user",
    assistant_role: str | Sequence[str] = "assistant",
    id_col: str = "conv_id",
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Last adjacent (user -> assistant) pair per conversation.

    ``(id_col, last_user_turn, target_turn)``; conversations without such a pair have no row.
    Adjacent means next in turn order: turn numbers may have gaps.
    """
    users, assistants = ([r] if isinstance(r, str) else list(r) for r in (user_role, assistant_role))
    kind = F.when(F.col("role").isin(users), 1).when(F.col("role").isin(assistants), 2).otherwise(0)
    part = F.floor(F.col("turn") / chunk).alias("_chunk")
    parts = turns.select(id_col, part, F.struct(F.col("turn"), kind.alias("kind")).alias("m"))
    parts = parts.groupBy(id_col, "_chunk").agg(F.array_sort(F.collect_list("m")).alias("m"))
    after = F.lead(F.element_at("m", 1)).over(Window.partitionBy(id_col).orderBy("_chunk"))
    parts = parts.select(id_col, "m", after.alias("after"))
    following = F.concat(F.slice("m", F.lit(2), F.size("m")), F.array("after"))
    pairs = F.filter(
        F.zip_with("m", following, lambda a, b: F.struct(a["turn"].alias("u"), a["kind"].alias("ak"), b["turn"].alias("t"), b["kind"].alias("bk"))),
        lambda p: (p["ak"] == 1) & (p["bk"] == 2),
    )
    last = parts.select(id_col, F.element_at(F.when(F.size(pairs) > 0, pairs), -1).alias("p")).where("p IS NOT NULL")
    best = last.groupBy(id_col).agg(F.max(F.struct("p.u", "p.t")).alias("p"))
    return best.select(id_col, F.col("p.u").alias("last_user_turn"), F.col("p.t").alias("target_turn"))


def split_prompt_target(
    turns: DataFrame,
    user_role: str | Sequence[str] = "user",
    assistant_role: str | Sequence[str] = "assistant",
    id_col: str = "conv_id",
) -> tuple[DataFrame, DataFrame]:
    """Prompt turns (all turns up to the last user turn) and the target message.

    Returns ``(prompt_turns, targets)``: ``prompt_turns`` is long form,
    ``targets`` is ``(id_col, target_turn, target)`` with missing content as ''.
    """
    last = last_exchange(turns, user_role, assistant_role, id_col)
    prompt_turns = (
        turns.join(last, id_col, "inner").where(F.col("turn") <= F.col("last_user_turn")).drop("last_user_turn", "target_turn")
    )
    targets = turns.join(last.select(id_col, F.col("target_turn").alias("turn")), [id_col, "turn"], "inner").select(
        id_col, F.col("turn").alias("target_turn"), F.coalesce(F.col("text"), F.lit("")).alias("target")
    )
    return prompt_turns, targets


def nonempty_targets(targets: DataFrame) -> DataFrame:
    """Drop examples whose target text is empty (P16, loss evaluation)."""
    return targets.where(F.col("target") != "")


def ordered_concat(
    df: DataFrame,
    key_cols: list[str],
    order_col: str,
    value_col: str,
    sep: str,
    out_col: str,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Join ``value_col`` strings in ``order_col`` order per key, with ``sep``.

    Two-level aggregation: ``(keys, order div chunk)`` first, then ``keys``.
    Values must be non-NULL (``array_join`` would skip them).
    """
    c = F.floor(F.col(order_col) / chunk).alias("_chunk")
    level1 = df.groupBy(*key_cols, c).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v")))),
                        lambda x: x["v"]),
            sep,
        ).alias("_piece")
    )
    return level1.groupBy(*key_cols).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("o"), F.col("_piece").alias("v")))),
                        lambda x: x["v"]),
            sep,
        ).alias(out_col)
    )


def plain_segment(role: Column, text: Column) -> Column:
    """One message of the plain rendering: ``ROLE:\\ncontent``."""
    return F.concat(F.upper(F.coalesce(role, F.lit("user"))), F.lit(PLAIN_HEADER_SEP), F.coalesce(text, F.lit("")))


def render_plain(turns: DataFrame, id_col: str = "conv_id", out_col: str = "rendered") -> DataFrame:
    """Plain dialogue rendering per conversation, stripped."""
    seg = turns.select(id_col, "turn", plain_segment(F.col("role"), F.col("text")).alias("_seg"))
    joined = ordered_concat(seg, [id_col], "turn", "_seg", PLAIN_MESSAGE_SEP, "_joined")
    return joined.select(id_col, tr.strip_text(F.col("_joined")).alias(out_col))


def render_prompt(turns: DataFrame, id_col: str = "conv_id", out_col: str = "prompt") -> DataFrame:
    """Generation prompt: plain rendering plus the assistant header."""
    r = render_plain(turns, id_col, "_r")
    return r.select(id_col, F.concat(F.col("_r"), F.lit(ASSISTANT_HEADER)).alias(out_col))


def tagged_segment(role: Column, text: Column, known_roles=("system", "user", "assistant")) -> Column:
    """``<|role|>\\ncontent\\n`` for known roles; an unknown role contributes ``\\n`` only."""
    body = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    return F.when(role.isin(*known_roles), body).otherwise(F.lit("\n"))


def render_tagged(
    turns: DataFrame, eos: str = "</s>", id_col: str = "conv_id", out_col: str = "rendered"
) -> DataFrame:
    """Tagged chat rendering: one tagged block per message, then ``eos``."""
    seg = turns.select(id_col, "turn", tagged_segment(F.col("role"), F.col("text")).alias("_seg"))
    joined = ordered_concat(seg, [id_col], "turn", "_seg", "", "_joined")
    return joined.select(id_col, F.concat(F.col("_joined"), F.lit(eos)).alias(out_col))


def eval_examples(
    turns: DataFrame,
    mode: str = "messages",
    id_col: str = "conv_id",
    role_map: Mapping[str, str] = DEFAULT_ROLE_MAP,
) -> DataFrame:
    """``(id, prompt, target)`` for every conversation with a user -> assistant pair.

    ``messages`` mode: roles are tested and rendered as they are.  ``turns``
    mode: adjacency is tested on the raw junior/senior roles, then the fixed
    evaluation system prompt is prepended and roles are mapped (unknown ->
    user).
    """
    if mode == "messages":
        prompt_turns, targets = split_prompt_target(turns, "user", "assistant", id_col)
    elif mode == "turns":
        users = [k for k, v in role_map.items() if v == "user"]
        assistants = [k for k, v in role_map.items() if v == "assistant"]
        prompt_turns, targets = split_prompt_target(turns, users, assistants, id_col)
        system = targets.select(id_col, F.lit(EVAL_SYSTEM_PROMPT).alias("text"))
        prompt_turns = prepend_system(map_roles_eval(prompt_turns, role_map), system, id_col)
    else:
        raise ValueError("mode must be 'messages' or 'turns'")
    prompts = render_prompt(prompt_turns, id_col, "prompt")
    return prompts.join(targets, id_col, "inner")


def to_messages(turns: DataFrame, id_col: str = "conv_id", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Long form back to ``(id, messages array<struct<role, content>>)`` in turn order."""
    c = F.floor(F.col("turn") / chunk).alias("_chunk")
    level1 = turns.groupBy(id_col, c).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_part")
    )
    level2 = level1.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("o"), F.col("_part").alias("p")))).alias("_parts")
    )
    msgs = F.transform(F.flatten(F.transform("_parts", lambda x: x["p"])),
                       lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return level2.select(id_col, msgs.alias("messages"))
