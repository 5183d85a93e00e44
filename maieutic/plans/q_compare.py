"""Catalogue: pairwise comparison.

Trained outputs are all ``documents``.  Baseline outputs are derived from them, so that the work grows with
the table: the same text, its first half, nothing, or the source and a middle part, for nine documents of ten; the
tenth has no counterpart, and ``benchmark`` items (under negative ids) are on the baseline side only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maieutic.functions import text_rules as tr
from maieutic.operators.compare import f1_summary, pair_outputs, pairwise_f1, unpaired_counts
from maieutic.plans import oracle as o
from maieutic.plans.catalog import register
from maieutic.plans.inputs import table


_BASELINE = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, CAST(floor(length(text) / 2.0) AS INT)) WHEN 2 THEN ''
  ELSE source || ' ' || substring(text, CAST(floor(length(text) / 3.0) AS INT) + 1, CAST(floor(length(text) / 3.0) AS INT)) END"""


def _sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread="doc_id")
    trained = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("output"))
    derived = docs.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("id"), F.expr(_BASELINE).alias("output"))
    extra = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.col("text").alias("output"))
    return trained, derived.unionByName(extra)


_W = o.unicode_patterns()["word"]
_SIDES_SQL = f"""base AS (SELECT doc_id AS id, {_BASELINE} AS output FROM documents WHERE doc_id % 10 <> 9
  UNION ALL SELECT -1 - item_id, text FROM benchmark)"""
_PAIRS_SQL = f"""WITH {_SIDES_SQL}
SELECT d.doc_id AS id, d.text AS trained_output, b.output AS baseline_output FROM documents d JOIN base b ON d.doc_id = b.id"""
_SCORED_SQL = f"""WITH pairs AS ({_PAIRS_SQL}),
ws AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(trained_output, '')), '{_W}')) AS pw,
              list_distinct(regexp_extract_all(lower(coalesce(baseline_output, '')), '{_W}')) AS rw FROM pairs),
cnt AS (SELECT id, CAST(len(pw) AS BIGINT) AS p, CAST(len(rw) AS BIGINT) AS r,
               CAST(len(list_intersect(pw, rw)) AS BIGINT) AS c FROM ws),
scored AS (SELECT id,
  CASE WHEN p = 0 AND r = 0 THEN CAST(1 AS DOUBLE) WHEN p = 0 OR r = 0 THEN CAST(0 AS DOUBLE)
       ELSE {o.round_ratio_half_even_sql('c', 'p')} END AS precision,
  CASE WHEN p = 0 AND r = 0 THEN CAST(1 AS DOUBLE) WHEN p = 0 OR r = 0 THEN CAST(0 AS DOUBLE)
       ELSE {o.round_ratio_half_even_sql('c', 'r')} END AS recall,
  CASE WHEN p = 0 AND r = 0 THEN CAST(1 AS DOUBLE) WHEN p = 0 OR r = 0 THEN CAST(0 AS DOUBLE)
       WHEN c = 0 THEN CAST(0 AS DOUBLE)
       ELSE {o.round_ratio_half_even_sql('2 * c', 'p + r')} END AS f1,
  CASE WHEN p = 0 AND r = 0 THEN CAST(1 AS DOUBLE) WHEN p = 0 OR r = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * c / (p + r) END AS raw_f1
  FROM cnt)"""


@register("j1_pair_outputs", f"{_PAIRS_SQL}")
def q_pair_outputs(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    return pair_outputs(trained, baseline, "id", "output")


@register(
    "j1_unpaired_counts",
    f"""WITH {_SIDES_SQL} SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM base)) AS trained_only,
              (SELECT count(*) FROM base WHERE id NOT IN (SELECT doc_id FROM documents)) AS baseline_only""",
)
def q_unpaired(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    return unpaired_counts(trained, baseline, "id")


@register("t19_pairwise_f1", f"{_SCORED_SQL} SELECT id, precision, recall, f1, raw_f1 FROM scored")
def q_pairwise_f1(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    return pairwise_f1(pair_outputs(trained, baseline, "id", "output")).select("id", "precision", "recall", "f1", "raw_f1")


@register(
    "a15_f1_summary",
    f"""{_SCORED_SQL}, agg AS (SELECT count(*) AS n_pairs, sum(CAST(round(f1 * 10000) AS BIGINT)) AS sq,
        min(f1) AS min_f1, max(f1) AS max_f1 FROM scored)
SELECT n_pairs, {o.round_ratio_half_even_sql('sq', 'n_pairs', 0)} / 10000.0 AS mean_f1, min_f1, max_f1
FROM agg WHERE n_pairs > 0""",
)
def q_f1_summary(spark, sf_dir):
    trained, baseline = _sides(spark, sf_dir)
    return f1_summary(pairwise_f1(pair_outputs(trained, baseline, "id", "output")))


@register(
    "t18_word_sets",
    f"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '{_W}'))) AS BIGINT) AS n_distinct_words,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{_W}'))), ' ') AS words
FROM documents""",
)
def q_word_sets(spark, sf_dir):
    ws = tr.word_set(F.col("text"))
    return table(spark, sf_dir, "documents", spread="doc_id").select(
        "doc_id",
        F.size(ws).cast("bigint").alias("n_distinct_words"),
        F.array_join(F.array_sort(ws), " ").alias("words"),
    )
