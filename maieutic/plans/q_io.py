"""Catalogue: sources and sinks as round trips through the shared checkpoint folder.

Each query writes data Spark derives from a driver table, reads it back with
the library's reader and returns what was read; the oracle states the same
rows directly in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.operators.behavior import token_count
from maieutic.operators.compare import pair_outputs, pairwise_f1
from maieutic.operators.sampling import DEFAULT_SEED, per_split_limits
from maieutic.operators.tokens import char_prefix, pandas_tokenizer
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table
from maieutic.plans.q_compare import _SCORED_SQL, _sides
from maieutic.plans.q_tokens import P
from maieutic.plans.registry import map_rows
from maieutic.plans.q_stream import PREFIXED_SQL, q_prefixed_rows
from maieutic.session import scratch_path
from maieutic.sources import io

_STRIP = o.unicode_patterns()["strip"]


@register("s3_json_lines_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def q_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "conversations-jsonl")
    table(spark, sf_dir, "conversations").write.mode("overwrite").json(path)
    back = io.read_json_records(spark, path, "auto", "conv_id bigint, turn bigint, role string, text string")
    return back.select("conv_id", "turn", "role", "text")


# Prompt lines: objects with a prompt, a question, both empty, or neither; plain texts, numbers, broken JSON, blanks; and
# objects whose prompt is a number, zero with a question that is true, and a list.
_LINE_KIND = "(conv_id * 5 + turn * 3) % 14"
_KINDS = {"blank": 7, "bad": 8, "number": 9, "text": 10, "number field": 11, "true field": 12, "list field": 13}


def _prompt_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    fields = F.struct(
        F.when(assistant, F.when(F.col("turn") % 4 == 3, F.lit("   ")).otherwise(F.col("text"))).when(user, F.lit("")).alias("prompt"),
        F.when(user, F.col("text")).alias("question"),
    )
    kind = F.expr(_LINE_KIND)
    broken = F.when(kind == _KINDS["blank"], F.lit("  ")).when(kind == _KINDS["bad"], F.lit("{bad")).when(kind == _KINDS["number"], F.lit("5")).when(
        kind == _KINDS["text"], F.lit('"{x} is a set, why?"')).when(
        kind == _KINDS["number field"], F.concat(F.lit('{"prompt": '), F.col("conv_id") + 1, F.lit("}"))).when(
        kind == _KINDS["true field"], F.lit('{"prompt": 0, "question": true}')).when(
        kind == _KINDS["list field"], F.lit('{"prompt": ["a"], "question": false}'))
    return c.select(F.coalesce(broken, F.to_json(fields)).alias("value"))


def _read_lines(spark, sf_dir):
    path = scratch_path(spark, "prompts-jsonl")
    _prompt_lines(spark, sf_dir).write.text(path)
    return io.read_prompts(spark, path, "jsonl", strict=False)


def _read_array(spark, sf_dir):
    """The same items without the broken ones, as a few JSON arrays."""
    path = scratch_path(spark, "prompts-json")
    lines = _prompt_lines(spark, sf_dir).where("trim(value) <> '' AND value <> '{bad'")
    arrays = lines.groupBy(F.abs(F.xxhash64("value")) % 8).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return io.read_prompts(spark, path, "json", strict=False)


_PICKED_SQL = """coalesce(nullif(CASE WHEN role = 'assistant' THEN (CASE WHEN turn % 4 = 3 THEN '   ' ELSE text END)
    WHEN role = 'user' THEN '' END, ''), nullif(CASE WHEN role = 'user' THEN text END, ''))"""
_ITEMS_SQL = f"""SELECT {_LINE_KIND} AS kind, CASE {_LINE_KIND} WHEN 11 THEN CAST(conv_id + 1 AS VARCHAR) WHEN 12 THEN 'True' WHEN 13 THEN NULL
  ELSE regexp_replace({_PICKED_SQL}, '{_STRIP}', '', 'g') END AS prompt FROM conversations"""


@register("s4_p4_prompts_jsonl", f"SELECT prompt FROM ({_ITEMS_SQL}) i WHERE (kind < 7 OR kind > 10) AND prompt IS NOT NULL")
def q_prompts_jsonl(spark, sf_dir):
    return _read_lines(spark, sf_dir)[0].select("prompt")


@register(
    "s4_prompts_json_array",
    f"""SELECT CASE WHEN kind = 10 THEN '{{x}} is a set, why?' ELSE prompt END AS prompt FROM ({_ITEMS_SQL}) i
WHERE kind = 10 OR ((kind < 7 OR kind > 10) AND prompt IS NOT NULL)""",
)
def q_prompts_json(spark, sf_dir):
    return _read_array(spark, sf_dir)[0].select("prompt")


@register(
    "p5_prompt_rejects",
    f"""SELECT 'jsonl' AS layout, CASE WHEN kind = 8 THEN '{io.BAD_JSON}' WHEN kind IN (9, 10) THEN '{io.WRONG_TYPE}' ELSE '{io.NO_FIELD}' END AS reason,
  count(*) AS n FROM ({_ITEMS_SQL}) i WHERE kind IN (8, 9, 10) OR ((kind < 7 OR kind > 10) AND prompt IS NULL) GROUP BY 2
UNION ALL SELECT 'json', CASE WHEN kind = 9 THEN '{io.WRONG_TYPE}' ELSE '{io.NO_FIELD}' END AS reason, count(*)
FROM ({_ITEMS_SQL}) i WHERE kind = 9 OR ((kind < 7 OR kind > 10) AND prompt IS NULL) GROUP BY 2""",
)
def q_prompt_rejects(spark, sf_dir):
    parts = [f(spark, sf_dir)[1].select(F.lit(name).alias("layout"), "reason") for name, f in (("jsonl", _read_lines), ("json", _read_array))]
    return parts[0].union(parts[1]).groupBy("layout", "reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "p3_text_prompts",
    f"""SELECT regexp_replace(line, '{_STRIP}', '', 'g') AS prompt FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l
WHERE regexp_matches(line, '{o.unicode_patterns()["nonspace"]}')""",
)
def q_text_prompts(spark, sf_dir):
    """Every line of the documents as a text prompt; blank lines go."""
    path = scratch_path(spark, "prompts-txt")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return io.read_prompts(spark, path, "txt").select("prompt")


ARRAY_ROWS = 4096


@register("s3_json_array_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def q_json_array(spark, sf_dir):
    path = scratch_path(spark, "conversations-json")
    turns = table(spark, sf_dir, "conversations")
    # Files of at most ARRAY_ROWS elements, whatever the length of a conversation: their number grows with the rows alone.
    file = F.floor(F.monotonically_increasing_id() / ARRAY_ROWS).alias("_file")
    rows = turns.select(file, F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("j"))
    arrays = rows.groupBy("_file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return io.read_json_records(spark, path, "auto", "conv_id bigint, turn bigint, role string, text string")


@register(
    "p1_flatten_structs",
    "SELECT doc_id, lang AS \"meta.lang\", source AS \"meta.origin.source\", n_chars AS \"meta.origin.n_chars\" FROM documents",
)
def q_flatten(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return io.flatten_structs(d.select("doc_id", F.struct("lang", F.struct("source", "n_chars").alias("origin")).alias("meta")))


_SPLIT_NAME = "CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'validation' ELSE 'other' END"


@register(
    "s1_table_splits",
    f"""WITH s AS (SELECT o_orderkey, {_SPLIT_NAME} AS split FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY
  CASE WHEN split = 'train' THEN md5(concat_ws(':', '{DEFAULT_SEED}', CAST(o_orderkey AS VARCHAR))) END, o_orderkey) AS k FROM s)
SELECT o_orderkey, split FROM p WHERE (split = 'train' AND k <= 2000) OR (split = 'validation' AND k <= 300)""",
)
def q_table_splits(spark, sf_dir):
    """A table with a split column: the configured splits are read, capped and one of them is not there."""
    path = scratch_path(spark, "orders-splits")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SPLIT_NAME).alias("split"))
    orders.write.partitionBy("split").parquet(path)
    limits = {"train": 2000, "validation": 300, "test": 10}
    rows = io.read_table(spark, path, splits=list(limits))
    return per_split_limits(rows, limits, ["o_orderkey"]).select("o_orderkey", "split")


@register("p2_keep_columns", "SELECT doc_id, lang AS label FROM documents")
def q_keep_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("label", F.col("lang"))
    return io.keep_columns(d, ["doc_id", "label"])


@register("k8_char_prefix", "SELECT doc_id, substring(text, 1, 80) AS head FROM documents")
def q_char_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", char_prefix(F.col("text"), 80).alias("head"))


def _shout(batch):
    return batch.assign(n=batch["text"].str.len()).drop(columns=["text"])


@register("u2_map_rows", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def q_map_rows(spark, sf_dir):
    return map_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), _shout, "doc_id bigint, n bigint")


def _letters(texts):
    return texts.str.findall("[aeiou]")


@register(
    "u5_r13_token_counts",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[aeiou]')) AS BIGINT) AS own,
  CAST(len(regexp_extract_all(text, '{P}')) AS BIGINT) AS word FROM documents""",
)
def q_token_counts(spark, sf_dir):
    """Counts by a user's tokenizer and by the built-in word tokenizer."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", token_count(t, pandas_tokenizer(_letters)).alias("own"), token_count(t, "word").alias("word"))


@register("s5_report_details", f"{_SCORED_SQL} SELECT id, precision, recall, f1, raw_f1 FROM scored")
def q_report_details(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    path = scratch_path(spark, "report")
    io.write_comparison_report(pairwise_f1(pair_outputs(trained, baseline, "id", "output")), path)
    back = spark.read.schema("id bigint, f1_metrics struct<precision:double,recall:double,f1:double,raw_f1:double>").json(f"{path}/results")
    return back.select("id", "f1_metrics.*")


@register(
    "s5_report_roundtrip",
    f"""{_SCORED_SQL}, agg AS (SELECT count(*) AS n_pairs, sum(CAST(round(f1 * 10000) AS BIGINT)) AS sq,
        min(f1) AS min_f1, max(f1) AS max_f1 FROM scored)
SELECT n_pairs, {o.round_ratio_half_even_sql('sq', 'n_pairs', 0)} / 10000.0 AS mean_f1, min_f1, max_f1
FROM agg WHERE n_pairs > 0""",
)
def q_report_roundtrip(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    path = scratch_path(spark, "report")
    io.write_comparison_report(pairwise_f1(pair_outputs(trained, baseline, "id", "output")), path,
                               {"trained_model": "documents", "baseline_model": "derived"})
    back = spark.read.schema("n_pairs bigint, mean_f1 double, min_f1 double, max_f1 double").json(f"{path}/summary")
    return back


@register("s6_metric_log_roundtrip", PREFIXED_SQL)
def q_metric_log(spark, sf_dir):
    path = scratch_path(spark, "metric-log")
    io.write_metric_log(q_prefixed_rows(spark, sf_dir), path, ("run_id",), mode="overwrite")
    return spark.read.parquet(path).select("run_id", "step", "metric", "value")

