"""Queries op1 .. op13 over the driver tables, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maieutic.llm import binary_records, decontaminate, line_dedup, mixing, near_dup, paragraph_dedup, quality_classifier, quality_rules, substring_dedup, token_alignment, token_count, url_rules, whitening

from maieutic.llm.common import fresh_path


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (the package that ships them, else the folder in the environment)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# The URL rules of the query (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
VOCABULARY = "word_bpe_49k.json"
ALIGNED_VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, h || q AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), limit=2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(table(spark, sf_dir, "documents"), max_edits=2, min_bytes=20, exact_below=True)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "removed_bytes", F.sha2("kept", 256).alias("kept_sha256"), "first_ids"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), min_words=20, min_repeat=8, max_repeat_pct=30)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# The longest repeat exceeds 15 % of the words if some run of max(8, floor(15 % of the words) + 1) words is repeated.
OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, w, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS k FROM (
  SELECT doc_id, w, unnest(range(1, n - 6)) AS i FROM m WHERE n >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
  SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
lw AS (SELECT doc_id, w, n, greatest(8, n * 15 // 100 + 1) AS z FROM m JOIN r USING (doc_id)),
lg AS (SELECT doc_id, md5(array_to_string(w[i:i + z - 1], ' ')) AS k FROM (
  SELECT doc_id, w, z, unnest(range(1, n - z + 2)) AS i FROM lw WHERE n >= z)),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, k FROM lg GROUP BY doc_id, k HAVING count(*) > 1)),
f AS (SELECT m.doc_id, n AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  n < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n AS base_failed, l.doc_id IS NOT NULL AS long_repeat
  FROM m LEFT JOIN r USING (doc_id) LEFT JOIN l ON l.doc_id = m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT long_repeat AS kept FROM f
"""


OP5_PARAMETERS = dict(shingle=5, threshold_pct=80, min_words=10, recall=0.9999, most_bands=14, joined=True)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.remove_paragraphs(table(spark, sf_dir, "documents"), **OP5_PARAMETERS)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "removed_bytes", F.sha2("kept", 256).alias("kept_sha256"), "first_ids"
    )


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Bytes as pairs of hex digits: windows of 400 bytes that start at more than one place, their union, and what lies between.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM s)),
spans AS (SELECT r, n, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, n),
gaps AS (SELECT r, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans
  UNION ALL SELECT r, 0, min(a) FROM spans GROUP BY r),
kept AS (SELECT d.r, string_agg(substr(h, 2 * gaps.a + 1, 2 * (coalesce(gaps.b, length(h) // 2) - gaps.a)), '' ORDER BY gaps.a) AS kept
  FROM gaps JOIN d ON d.r = gaps.r GROUP BY d.r),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r LEFT JOIN kept ON kept.r = d.r
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), max_epochs=3, seed=17)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", "part")


# Level of the water: it rises until no source above its clamp is left; then each source's documents are taken in hash order.
OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
one AS (SELECT list({'w': weight, 'c': 3 * source_size}) AS l, sum(source_size) AS total FROM w),
lv(k, level) AS (SELECT 0, total / list_sum(list_transform(l, lambda x: x.w)) FROM one UNION ALL
  SELECT k + 1, (total - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.w * level > x.c), lambda x: x.c)), 0))
    / list_sum(list_transform(list_filter(l, lambda x: x.w * level <= x.c), lambda x: x.w)) FROM lv, one
  WHERE k < len(l) AND len(list_filter(l, lambda x: x.w * level <= x.c)) > 0),
t AS (SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM w, (SELECT level FROM lv ORDER BY k DESC LIMIT 1) m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (SELECT *, CAST(round(target - passes * source_size) AS BIGINT) AS rest FROM p),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.passes, r.rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - upto + size)) AS BIGINT) AS taken,
  CAST(passes AS BIGINT) AS passes, CAST(greatest(0, least(size, rest - upto + size)) AS BIGINT) AS part FROM c
"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold_pct=80, bands=24)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT v AS doc_id, min(t) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_OP9_WORDS = """list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_OP9_WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP9_WORDS.format(t="text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(s) AS n, array_to_string(s, ' ') AS k FROM (
  SELECT item, w[i:i + 9] AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "op10-records")
    binary_records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_path(VOCABULARY), end_id=2)
    index = binary_records.write_index(spark, path)
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(tokenizer_path, ALIGNED_VOCABULARIES)
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), a, b, pairing="end")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024)
    # A sum of squares beyond 63 bits (some ten million vectors) has no long: null.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_source_mix": op7_source_mix,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_binary_records": op10_binary_records,
    "op11_token_alignment": op11_token_alignment,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op4_quality_rules": OP4_SQL, "op6_repeated_substrings": OP6_SQL, "op7_source_mix": OP7_SQL, "op8_near_duplicates": OP8_SQL, "op9_decontamination": OP9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
