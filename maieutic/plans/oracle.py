"""DuckDB SQL building blocks for the oracle side of the catalogue.

The oracle restates each operator in plain SQL over the same parquet views.
DuckDB's RE2 has ASCII ``\\w \\d \\s \\b``; on ASCII text the rule patterns
are used verbatim.  For Unicode text the classes below are written out from
the definition (Python ``re``: letters, numbers of any kind and ``_`` are word
characters; ``str.isspace`` characters are blanks), and word boundaries are
explicit neighbour-character tests (valid for the boolean "search" rules only).
Phrases, verbs and units come from the one block of fixed values by substitution.
"""

from __future__ import annotations

import re

from maieutic.functions import text_rules as tr

U_WORD = r"\p{L}\p{N}_"
U_SPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
W = f"[{U_WORD}]"
NW = f"[^{U_WORD}]"
S = f"[{U_SPACE}]"
NS = f"[^{U_SPACE}]"
D = r"\p{Nd}"


def ascii_patterns() -> dict[str, str]:
    """RE2 patterns equal to the rules on ASCII text."""
    return {
        "phrases": "(?i)(?:" + "|".join(tr.WITHHOLD_PHRASE_PATTERNS) + ")",
        "final": tr.FINAL_FORMAT_PATTERN,
        "step": tr.STEP_LINE_PATTERN,
        "num_unit": tr.NUMBER_WITH_UNIT_PATTERN,
        "range": tr.RANGE_PATTERN,
        "comparison": tr.COMPARISON_PATTERN,
        "unit_any": "(?i)(?:" + tr.UNITS_PATTERN + ")",
        "prescription": tr.PRESCRIPTION_PATTERN,
        "imperative": tr.IMPERATIVE_PATTERN,
        "word": r"\w+",
        "nonword_run": r"\W+",
        "nonspace_run": r"\S+",
        "nonspace": r"\S",
        "strip": r"^\s+|\s+$",
    }


def _units_then_boundary() -> str:
    """``(?:UNITS)\\b`` for RE2: a unit ending in a word character must be followed by a
    non-word character or the end; ``%`` (the one unit ending in a non-word
    character) must be followed by a word character."""
    units = tr.UNITS_PATTERN.split("|")
    word_end = [u for u in units if u != "%"]
    return f"(?:(?:{'|'.join(word_end)})(?:$|{NW})|%{W})"


def unicode_patterns() -> dict[str, str]:
    """RE2 patterns equal to the rules on any text (search truth values).

    ``\\b`` before/after a word character becomes "start or non-word" /
    "non-word or end" on the neighbour; that consumes the neighbour, which
    does not change whether a match exists.
    """
    lb, rb = f"(?:^|{NW})", f"(?:$|{NW})"
    num = f"{D}+(?:\\.{D}+)?"
    # Every phrase starts with a word character.  One that ends in ``\\w+`` needs a
    # word character there; "answer:" needs one behind it; the others need the word to end.
    alts = []
    for phrase in tr.WITHHOLD_PHRASE_PATTERNS:
        body = phrase.removeprefix(r"\b").removesuffix(r"\b")
        end = W if body.endswith(":") else "" if body.endswith(r"\w+") else rb
        alts.append(lb + body.replace(r"\w+", W).replace(r"\s", S) + end)
    prescribed, commanded = (
        re.search(r"\(([a-z|]+)\)", p)[1] for p in (tr.PRESCRIPTION_PATTERN, tr.IMPERATIVE_PATTERN)
    )
    nwd = f"[^{U_WORD}.]"
    units_b = _units_then_boundary()
    return {
        "phrases": "(?i)(?:" + "|".join(alts) + ")",
        "final": f"(?im)^{S}*(final|conclusion){S}*[:\\-]",
        "step": f"(?m)^{S}*(?:{D}+\\.|[-*]){S}+",
        "num_unit": f"(?i){lb}{num}{S}*{units_b}",
        "range": f"(?i){lb}{num}{S}*(?:-|{S}+to{S}+){S}*{D}+(?:\\.{D}+)?(?:{rb}|{S}*{units_b}|{S}+{W})",
        "comparison": f"(?:<=|>=|<|>){S}*{D}",
        "unit_any": "(?i)(?:" + tr.UNITS_PATTERN + ")",
        "prescription": f"(?i){lb}(?:{prescribed}){nwd}(?:[^.]*{nwd})?{num}{rb}",
        "imperative": f"(?i)(?:^|[.!?]{S}+)(?:{commanded}){rb}",
        "word": f"{W}+",
        "nonword_run": f"{NW}+",
        "nonspace_run": f"{NS}+",
        "nonspace": NS,
        "strip": f"^{S}+|{S}+$",
    }


def behavior_features_ctes(src_sql: str, text: str = "text", unicode: bool = False, prefix: str = "f") -> str:
    """CTEs ``{prefix}0..{prefix}`` adding the T1-T16 features to ``src_sql`` rows."""
    p = unicode_patterns() if unicode else ascii_patterns()
    cues = " + ".join(f"CASE WHEN contains(_joined, '{c}') THEN 1 ELSE 0 END" for c in tr.INTERROGATIVES)
    return f"""{prefix}0 AS (SELECT *, coalesce({text}, '') AS _t FROM ({src_sql}) _src),
{prefix}1 AS (SELECT *, regexp_replace(_t, '{p['strip']}', '', 'g') AS _s,
    trim(regexp_replace(lower(_t), '{p['nonword_run']}', ' ', 'g')) AS _joined,
    CAST(len(regexp_extract_all(lower(_t), '{p['word']}')) AS BIGINT) AS _nwords,
    NOT regexp_matches(_t, '{p['nonspace']}') AS _blank FROM {prefix}0),
{prefix}2 AS (SELECT *,
    CAST(length(_s) - length(replace(_s, '?', '')) AS BIGINT) AS _sq,
    CAST(length(_s) - length(translate(_s, '.!?', '')) AS BIGINT) AS _sm,
    CAST(len(regexp_extract_all(_s, '{p['step']}')) AS BIGINT) AS _ssteps FROM {prefix}1),
{prefix} AS (SELECT *,
    CASE WHEN _blank THEN false ELSE (regexp_matches(_s, '{p['phrases']}') OR regexp_matches(_s, '{p['final']}')
      OR (_ssteps >= 3 AND NOT (CASE WHEN _sm = 0 THEN _sq > 0 ELSE _sq >= greatest(1, _sm // 2) END))) END
      AS withhold_violation,
    CASE WHEN _blank THEN false ELSE (regexp_matches(_t, '{p['num_unit']}') OR regexp_matches(_t, '{p['range']}')
      OR (regexp_matches(_t, '{p['comparison']}') AND regexp_matches(_t, '{p['unit_any']}'))
      OR regexp_matches(_t, '{p['prescription']}')) END AS numeric_violation,
    contains(_t, '?') AS has_question,
    CAST(length(_t) - length(replace(_t, '?', '')) AS BIGINT) AS n_questions,
    CASE WHEN _nwords > 0 THEN ({cues}) / _nwords END AS interrogative_ratio,
    CAST(length(_t) AS BIGINT) AS n_chars,
    CAST(len(regexp_extract_all(_t, '{p['nonspace_run']}')) AS BIGINT) AS n_tokens,
    len(regexp_extract_all(_t, '{p['step']}')) >= 3 AS step_list,
    regexp_matches(_t, '{p['imperative']}') AS contains_imperative
  FROM {prefix}2)"""


def behavior_metric_select(group_cols: tuple[str, ...] = ()) -> str:
    g = ", ".join(group_cols)
    lead = f"{g}, " if g else ""
    return f"""SELECT {lead}count(*) AS n_responses,
  CAST(sum(CAST(withhold_violation AS BIGINT)) AS DOUBLE) / count(*) AS withhold_violation_rate,
  CAST(sum(CAST(numeric_violation AS BIGINT)) AS DOUBLE) / count(*) AS numeric_violation_rate,
  CAST(sum(CAST(has_question AS BIGINT)) AS DOUBLE) / count(*) AS question_rate,
  CAST(sum(n_questions) AS DOUBLE) / count(*) AS avg_questions_per_response,
  round(sum(coalesce(interrogative_ratio, 0.0)) / count(*), 9) AS avg_interrogative_ratio,
  CAST(sum(n_chars) AS DOUBLE) / count(*) AS avg_response_length_chars,
  CAST(sum(n_tokens) AS DOUBLE) / count(*) AS avg_response_length_tokens,
  CAST(quantile_disc(n_tokens, 0.95) AS BIGINT) AS p95_response_length_tokens,
  CAST(sum(CAST(step_list AS BIGINT)) AS DOUBLE) / count(*) AS step_list_rate,
  CAST(sum(CAST(contains_imperative AS BIGINT)) AS DOUBLE) / count(*) AS contains_imperative_rate"""


def round_ratio_half_even_sql(num: str, den: str, places: int = 4) -> str:
    """Same exact integer rounding as ``text_rules.round_ratio_half_even``."""
    scale = 10**places
    q = f"(CAST({num} AS BIGINT) * {scale}) // ({den})"
    rem = f"(CAST({num} AS BIGINT) * {scale} - ({q}) * ({den}))"
    up = f"(2 * {rem} > ({den}) OR (2 * {rem} = ({den}) AND ({q}) % 2 = 1))"
    return f"CAST((({q}) + CASE WHEN {up} THEN 1 ELSE 0 END) / {float(scale)} AS DOUBLE)"
