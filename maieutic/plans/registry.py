"""Named preprocessors and user-code hooks.

Each preprocessor is a function ``DataFrame -> DataFrame`` built from the
operators, applied with ``df.transform``; parameters are plain arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.operators import dialogue as dl
from maieutic.operators import span_qa as sq
from maieutic.operators import tokens as tk


Tokenizer = Callable[[Column], Column]


def _first_answer_text(answers_col: str) -> Column:
    return F.coalesce(F.get(F.col(f"{answers_col}.text"), 0), F.lit(""))


def eli5_qa(df: DataFrame, vocab: DataFrame, max_length: int = 512, id_col: str = "id", title_col: str = "title",
            answers_col: str = "answers", tokenizer: Tokenizer = tk.word_tokens) -> DataFrame:
    """Long-form QA for a causal LM: loss on the answer only."""
    q = F.concat(F.lit("Question: "), F.coalesce(F.col(title_col), F.lit("")), F.lit("\nAnswer:"))
    rows = df.select(id_col, tokenizer(q).alias("_q"), tokenizer(_first_answer_text(answers_col)).alias("_a"))
    both = tk.encode(rows, id_col, ["_q", "_a"], vocab, ["_qi", "_ai"])
    x = tk.prompt_answer_example(F.col("_qi"), F.col("_ai"), max_length)
    return both.select(id_col, x.alias("x")).select(id_col, "x.*")


def eli5_clm(df: DataFrame, vocab: DataFrame, block_size: int = tk.CLM_BLOCK_SIZE, id_col: str = "id",
             title_col: str = "title", answers_col: str = "answers", tokenizer: Tokenizer = tk.word_tokens) -> DataFrame:
    """Title + first answer ids cut into whole blocks; labels copy the ids."""
    title = tokenizer(F.coalesce(F.col(title_col), F.lit("")))
    rows = df.select(id_col, F.concat(title, tokenizer(_first_answer_text(answers_col))).alias("_t"))
    ids = tk.encode(rows, id_col, "_t", vocab, "_ids")
    blocks = ids.select(id_col, F.posexplode(tk.clm_blocks(F.col("_ids"), block_size)).alias("block", "ids"))
    return blocks.select(id_col, "block", F.col("ids").alias("input_ids"),
                         tk.lit_int_array(F.size("ids"), 1).alias("attention_mask"), F.col("ids").alias("labels"))


def socratic(df: DataFrame, id_col: str = "conv_id", policy_col: str = "policy", turns_col: str = "turns") -> DataFrame:
    """Nested dialogue -> ``messages`` with the policy system prompt, unknown roles dropped.

    In-row work on the nested array; nothing is exploded.
    """
    system = dl.policy_system_prompt(F.col(f"{policy_col}.withhold_final_answer"),
                                     F.col(f"{policy_col}.avoid_numeric_rules_of_thumb"))
    return df.select(id_col, dl.nested_messages(F.col(turns_col), system).alias("messages"))


NO_ROOM = "the question leaves no room for context"


def squad(df: DataFrame, vocab: DataFrame, max_length: int = 384, id_col: str = "id",
          tokenizer: Tokenizer | tk.Tokenizer = tk.word_tokens) -> DataFrame:
    """Span-QA encoding with answer token labels (R8, R10, R11, W5-W8, P6, P7), one row per input row.

    Output: ``input_ids, attention_mask, context, context_start, context_len,
    offset_mapping, start_positions, end_positions, reject_reason``.
    ``offset_mapping`` has a ``(start, end)`` for the positions of context tokens and NULL elsewhere.
    Labels are NULL without an answer and 0 (CLS) if the answer was cut off.  A row whose question leaves no room for
    context has a ``reject_reason`` and NULL in the encoded columns; it is not dropped.
    ``tokenizer`` cuts question and context if it is a ``Tokenizer``, whose offsets the labels then follow; a plain
    function knows no offsets and cuts the question alone.  Each text is cut once, for ids and offsets; context tokens that no
    example of ``max_length`` has room for are not looked up.
    """
    answer = F.when(sq.has_answers(F.col("answers")), sq.first_answer(F.col("answers")))
    source = df.select(id_col, "context", answer.alias("_a"))
    both = tk.encode_with_offsets(df, id_col, "question", "context", vocab, tokenizer, keep=max_length)
    x = both.select(id_col, F.col("lead").alias("_qi"), F.col("context").alias("_o")).join(source, id_col)
    x = x.withColumn("_e", tk.encode_pair(F.col("_qi"), F.transform("_o", lambda o: o["id"]), max_length))
    x = x.withColumn("_kept", F.slice("_o", F.lit(1), F.coalesce("_e.context_len", F.lit(0))))
    start = F.when(F.col("_e").isNotNull(), F.col("_a.start"))
    first, last = sq.answer_labels(F.col("_kept"), start, F.col("_a.start") + F.length("_a.text"), F.col("_e.context_start"))
    blank = F.lit(None).cast("struct<start:int,end:int>")
    mapping = F.concat(
        F.array_repeat(blank, F.col("_e.context_start")),
        F.transform("_kept", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))),
        F.array_repeat(blank, F.size("_e.input_ids") - F.col("_e.context_start") - F.size("_kept")),
    )
    return x.select(
        id_col, "_e.input_ids", "_e.attention_mask", "context", "_e.context_start", "_e.context_len",
        F.when(F.col("_e").isNotNull(), mapping).alias("offset_mapping"),
        first.alias("start_positions"), last.alias("end_positions"),
        F.when(tk.no_room(F.col("_qi"), max_length), F.lit(NO_ROOM)).alias("reject_reason"),
    )


PREPROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "eli5_qa": eli5_qa,
    "eli5_clm": eli5_clm,
    "socratic": socratic,
    "squad": squad,
}


def preprocess(name: str, df: DataFrame, **kwargs) -> DataFrame:
    """Look up a preprocessor by name (U1) and apply it with ``df.transform``."""
    if name not in PREPROCESSORS:
        raise KeyError(f"unknown preprocessor {name!r}; known: {sorted(PREPROCESSORS)}")
    fn = PREPROCESSORS[name]
    return df.transform(lambda d: fn(d, **kwargs))


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """User row code (U2) as Arrow batches: ``fn(pandas.DataFrame) -> pandas.DataFrame``.

    Parallelism is the number of partitions; use built-in operators first.
    """

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
