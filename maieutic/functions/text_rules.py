"""Rule-based behaviour features of a response text.

Each function takes a string ``Column`` and returns a ``Column``; nothing leaves
the JVM, so a projection of all features stays in one whole-stage-codegen span.

Regex dialect.  The rules are defined with Python ``re`` semantics.  Java's own
Unicode classes differ from Python's (``\\w`` there takes in combining marks and
joiners and leaves out ``²`` or ``½``), so ``java_regex`` writes the classes out:
a word character is a letter, a number of any kind or ``_``; a digit is a
decimal digit; a blank is one of the characters of ``BLANKS``; ``\\b`` is a change
between word and other characters.  Case folding is Unicode, and only ``\\n``
ends a line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These are the metric definitions and must stay exactly as
# written (pattern text, word lists and their order).
# ---------------------------------------------------------------------------
WITHHOLD_PHRASE_PATTERNS = [
    r"\bthe answer is\b",
    r"\banswer:\b",
    r"\btherefore\b",
    r"\bin summary\b",
    r"\bto conclude\b",
    r"\byou should\b",
    r"\bthe fix is\b",
    r"\bthe solution is\b",
    r"\bdo\s+\w+\b",
    r"\buse\s+\w+\b",
    r"\brecommended\b",
    r"\bset it to\b",
    r"\bchoose\s+\w+\b",
    r"\bplace\s+\w+\b",
    r"\bconnect\s+\w+\b",
]
FINAL_FORMAT_PATTERN = r"(?im)^\s*(final|conclusion)\s*[:\-]"
STEP_LINE_PATTERN = r"(?m)^\s*(?:\d+\.|[-*])\s+"
SENTENCE_MARKS = ".!?"
INTERROGATIVES = [
    "what",
    "why",
    "how",
    "which",
    "where",
    "when",
    "could",
    "would",
    "can",
    "should",
    "do you",
    "have you",
]
UNITS_PATTERN = (
    "V|mV|A|mA|uA|Ohm|ohm|Ω|kΩ|MΩ|%|mm|mil|inch|in|cm|"
    "MHz|GHz|kHz|Hz|ns|ps|dB|dBm|pF|nF|uF|mF|H|nH|uH|mH|°C|K|W|mW"
)
NUMBER_WITH_UNIT_PATTERN = rf"(?i)\b\d+(?:\.\d+)?\s*(?:{UNITS_PATTERN})\b"
RANGE_PATTERN = rf"(?i)\b\d+(?:\.\d+)?\s*(?:-|\s+to\s+)\s*\d+(?:\.\d+)?\s*(?:{UNITS_PATTERN})?\b"
COMPARISON_PATTERN = rf"(?i)(?:<=|>=|<|>)\s*\d+(?:\.\d+)?\s*(?:{UNITS_PATTERN})?"
PRESCRIPTION_PATTERN = r"(?i)\b(set|use|choose|pick|select|configure|bias|limit)\b[^.]*\b\d+(?:\.\d+)?\b"
IMPERATIVE_PATTERN = r"(?i)(?:^|[.!?]\s+)(do|use|set|place|connect|remove|add)\b"
STEP_LIST_MIN_LINES = 3
# ---------------------------------------------------------------------------

# The characters that Python's ``str.isspace`` accepts, as ranges.
BLANK_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
BLANKS = "".join(chr(c) for low, high in BLANK_RANGES for c in range(low, high + 1))

_JAVA_FLAGS = "(?ud)"
_WORD_MEMBERS = r"\p{L}\p{N}_"
_BLANK_MEMBERS = "".join(
    f"\\x{{{low:x}}}" if low == high else f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in BLANK_RANGES
)
_MEMBERS = {"w": _WORD_MEMBERS, "s": _BLANK_MEMBERS, "d": r"\p{Nd}"}
_BOUNDARY = f"(?:(?<![{_WORD_MEMBERS}])(?=[{_WORD_MEMBERS}])|(?<=[{_WORD_MEMBERS}])(?![{_WORD_MEMBERS}]))"


def expand_classes(pattern: str, members: dict[str, str], boundary: str) -> str:
    """Write the shorthand classes and boundaries of a pattern out, inside and outside of brackets."""
    out, in_set, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            kind = pattern[i + 1]
            i += 2
            if kind in members:
                out.append(members[kind] if in_set else f"[{members[kind]}]")
            elif kind.lower() in members and not in_set:
                out.append(f"[^{members[kind.lower()]}]")
            elif kind == "b" and not in_set:
                out.append(boundary)
            else:
                out.append("\\" + kind)
            continue
        in_set = c == "[" or (in_set and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def java_regex(pattern: str) -> str:
    """A Python-style pattern as the Java pattern with the same matches."""
    return _JAVA_FLAGS + expand_classes(pattern, _MEMBERS, _BOUNDARY)


def _words_of_rule(pattern: str) -> str:
    """The alternation of plain words that a fixed pattern holds, as it stands there."""
    return re.search(r"\(([a-z|]+)\)", pattern)[1]


def _initials(pattern: str) -> str:
    """The letters that the words of a rule begin with."""
    return "".join(sorted({word[0] for word in _words_of_rule(pattern).split("|")}))


def _phrase_alternation(patterns: list[str]) -> str:
    r"""One search instead of fifteen, with the shared leading ``\b`` tested once.

    Every phrase starts with a word character, so its leading ``\b`` is a look
    behind.  A trailing ``\w+\b`` only asks for one word character (the greedy run can
    always end at a boundary), any other trailing ``\b`` for the kind of character that
    changes there.  The truth value of the search is unchanged; the engine does far less work per position.
    """
    alts = []
    for p in patterns:
        body = p.removeprefix(r"\b").removesuffix(r"\b")
        end = r"\w" if body.endswith(r"\w+") else r"(?!\w)" if re.match(r"\w", body[-1]) else r"(?=\w)"
        alts.append(body.removesuffix(r"\w+").replace(r"\s+", r"\s++") + end)
    return r"(?i)(?<!\w)(?:" + "|".join(alts) + ")"


# The patterns as they are searched.  They have the truth values (and ``STEP_LINE`` the number of matches) of the fixed
# ones above but try no start twice, so a search is linear in the text:
# * A rule at a line start takes the blanks of its own line only; blank lines before it add nothing.
# * Runs of digits and blanks are possessive: what follows them cannot begin inside of them.
# * What a match begins with is asked before the character behind it, which costs more.
# * A range needs no more than the second number's end or a unit right after it: any other rest holds that end.
# * A prescription looks for the first verb of a segment (up to a full stop) once, atomically, then for a whole
#   number; later verbs of the segment add nothing, and a decimal's whole part is a number.
_SAME_LINE = f"[{_BLANK_MEMBERS}&&[^\\n]]"
_UNITS = f"(?:{UNITS_PATTERN})"
WITHHOLD_PHRASES_REGEX = java_regex(_phrase_alternation(WITHHOLD_PHRASE_PATTERNS))
FINAL_FORMAT_REGEX = java_regex(rf"(?im)^@*+(?:{_words_of_rule(FINAL_FORMAT_PATTERN)})\s*+[:\-]").replace("@", _SAME_LINE)
STEP_LINE_REGEX = java_regex(r"(?m)^@*+(?:\d++\.|[-*])\s++").replace("@", _SAME_LINE)
NUMBER_WITH_UNIT_REGEX = java_regex(rf"(?i)(?=\d)(?<!\w)\d++(?:\.\d++)?+\s*+{_UNITS}\b")
RANGE_REGEX = java_regex(rf"(?i)(?=\d)(?<!\w)\d++(?:\.\d++)?+(?:\s*+-\s*+|\s++to\s++)\d++(?:(?!\w)|{_UNITS}\b)")
COMPARISON_REGEX = java_regex(r"[<>]=?+\s*+\d")
UNIT_ANYWHERE_REGEX = java_regex("(?i)" + _UNITS)
PRESCRIPTION_REGEX = java_regex(
    rf"(?i)(?:\A|\.)(?>[^.]*?(?=[{_initials(PRESCRIPTION_PATTERN)}])(?<!\w)(?:{_words_of_rule(PRESCRIPTION_PATTERN)})(?!\w))"
    r"[^.]*?(?=\d)(?<!\w)\d++(?!\w)"
)
IMPERATIVE_REGEX = java_regex(rf"(?i)(?:^|[.!?]\s++)(?:{_words_of_rule(IMPERATIVE_PATTERN)})(?!\w)")
WORD_REGEX = java_regex(r"\w+")
# ``\S+`` with the same members: Java asks the parts of a class one by one, so the frequent characters come first, and
# the list of blanks is gone through only within the range that holds the rare ones.
NON_SPACE_RUN_REGEX = (
    r"[!-~[\x{a1}-\x{167f}\x{3001}-\x{10ffff}[\x{0}-\x{8}\x{e}-\x{1b}[\x{7f}-\x{3000}&&[^" + _BLANK_MEMBERS + "]]]]]+"
)
NON_SPACE_REGEX = java_regex(r"\S")


def _c(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _char_count(text: Column, chars: str) -> Column:
    """How many of the ASCII characters ``chars`` occur in ``text`` (no regex needed): the bytes that leaving each out saves."""
    size = F.octet_length(text)
    counts = [size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return reduce(Column.__add__, counts).cast("bigint")


# T17 -----------------------------------------------------------------------
def strip_text(text) -> Column:
    """Python's ``str.strip()``: a linear trim of its blanks (Spark's plain ``trim`` removes only spaces)."""
    return F.btrim(_c(text), F.lit(BLANKS))


def is_blank(text) -> Column:
    """True when the text is empty or whitespace only (``not text.strip()``)."""
    return ~_c(text).rlike(NON_SPACE_REGEX)


# T1, T3, T4 ----------------------------------------------------------------
def count_questions(text) -> Column:
    return _char_count(_c(text), "?")


def count_sentence_marks(text) -> Column:
    return _char_count(_c(text), SENTENCE_MARKS)


def is_mostly_questions(text) -> Column:
    q = count_questions(text)
    m = count_sentence_marks(text)
    return F.when(m == 0, q > 0).otherwise(q >= F.greatest(F.lit(1).cast("bigint"), F.floor(m / 2)))


# T2 ------------------------------------------------------------------------
def count_step_lines(text) -> Column:
    return F.regexp_count(_c(text), F.lit(STEP_LINE_REGEX)).cast("bigint")


# T5, T6, T7 ----------------------------------------------------------------
def has_answer_phrase(text) -> Column:
    return _c(text).rlike(WITHHOLD_PHRASES_REGEX)


def has_final_format(text) -> Column:
    return _c(text).rlike(FINAL_FORMAT_REGEX)


def is_withhold_violation(text) -> Column:
    """Gives the answer away: phrase, ``Final:`` line, or a step list that is not mostly questions.

    Blank text is never a violation.  Phrases and ``Final:`` lines are found in the raw text exactly when they are
    found in the stripped one, so only the step count takes the strip.
    """
    t = _c(text)
    steps = (count_step_lines(strip_text(t)) >= STEP_LIST_MIN_LINES) & ~is_mostly_questions(t)
    return ~is_blank(t) & (has_answer_phrase(t) | has_final_format(t) | steps)


# T8-T12 --------------------------------------------------------------------
def has_number_with_unit(text) -> Column:
    return _c(text).rlike(NUMBER_WITH_UNIT_REGEX)


def has_numeric_range(text) -> Column:
    return _c(text).rlike(RANGE_REGEX)


def has_comparison(text) -> Column:
    """A comparison with a number, and some unit text anywhere (both searches)."""
    return _c(text).rlike(COMPARISON_REGEX) & _c(text).rlike(UNIT_ANYWHERE_REGEX)


def has_prescription(text) -> Column:
    # The second test of the definition (a bare number anywhere) is implied by
    # this one, which already requires a number.
    return _c(text).rlike(PRESCRIPTION_REGEX)


def is_numeric_violation(text) -> Column:
    t = _c(text)
    return F.when(is_blank(t), F.lit(False)).otherwise(
        has_number_with_unit(t) | has_numeric_range(t) | has_comparison(t) | has_prescription(t)
    )


# T13 -----------------------------------------------------------------------
def word_count(text) -> Column:
    """Number of ``\\w+`` runs (``\\b\\w+\\b`` finds exactly the maximal runs)."""
    return F.regexp_count(_c(text), F.lit(WORD_REGEX)).cast("bigint")


def interrogative_hits(text) -> Column:
    """How many distinct cue strings occur as substrings of the space-joined lowercase words.

    Computed on ``lower(text)`` without building the joined string: a one-word
    cue has no space, so it occurs in the joined words exactly when it occurs
    in the lowercase text (any occurrence consists of word characters); a
    two-word cue ``a b`` occurs there exactly when ``a\\W+b`` matches the
    lowercase text (the joined form puts one space where the text has a run
    of non-word characters).
    """
    low = F.lower(_c(text))
    total = None
    for cue in INTERROGATIVES:
        if " " in cue:
            first, second = cue.split(" ", 1)
            hit = low.rlike(java_regex(re.escape(first) + r"\W+" + re.escape(second)))
        else:
            hit = low.contains(cue)
        term = hit.cast("bigint")
        total = term if total is None else total + term
    return total


def interrogative_ratio(text) -> Column:
    """Cue hits over word count; NULL for text without words.

    No conditional branch around the terms, so the shared ``lower(text)`` is
    evaluated once per row (subexpression elimination).
    """
    n = word_count(F.lower(_c(text)))
    return interrogative_hits(text) / F.nullif(n, F.lit(0).cast("bigint"))


# T14-T16 -------------------------------------------------------------------
def contains_imperative(text) -> Column:
    return _c(text).rlike(IMPERATIVE_REGEX)


def char_length(text) -> Column:
    """Code points, as Python ``len``."""
    return F.length(_c(text)).cast("bigint")


def whitespace_token_count(text) -> Column:
    """``len(text.split())``."""
    return F.regexp_count(_c(text), F.lit(NON_SPACE_RUN_REGEX)).cast("bigint")


# T18, T19 ------------------------------------------------------------------
def word_set(text) -> Column:
    """Distinct lowercase words (``set(re.findall(r'\\b\\w+\\b', text.lower()))``)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_REGEX), 0))


def round_ratio_half_even(num: Column, den: Column, places: int = 4) -> Column:
    """``num/den`` rounded half-to-even to ``places`` decimals, in exact integer math.

    Recorded difference: rounding the binary double instead (as the definition
    does) gives another last digit where the double lies on the other side of a
    decimal tie, for about one in a thousand ratios of small integers.  The
    unrounded columns do not depend on this.
    """
    scale = 10**places
    scaled = num.cast("bigint") * F.lit(scale)
    q = F.floor(scaled / den).cast("bigint")
    rem = scaled - q * den
    up = (rem * 2 > den) | ((rem * 2 == den) & (q % 2 == 1))
    return ((q + F.when(up, 1).otherwise(0)) / F.lit(float(scale))).cast("double")


def set_f1(pred_words, ref_words, places: int = 4) -> Column:
    """``f1_of_sizes`` of two word sets."""
    return f1_of_sizes(*set_sizes(_c(pred_words), _c(ref_words)), places)


def set_sizes(pred_words: Column, ref_words: Column) -> tuple[Column, Column, Column]:
    """Sizes of both sets and of their intersection."""
    sizes = F.size(pred_words), F.size(ref_words), F.size(F.array_intersect(pred_words, ref_words))
    return tuple(n.cast("bigint") for n in sizes)


def f1_of_sizes(p: Column, r: Column, c: Column, places: int = 4) -> Column:
    """Precision / recall / F1 of two sets of ``p`` and ``r`` words, ``c`` of them common, as a struct.

    ``raw_precision``, ``raw_recall`` and ``raw_f1`` are the unrounded quotients and the
    primary result; ``precision``, ``recall`` and ``f1`` are rounded to ``places``.
    Both empty -> 1,1,1; one empty -> 0,0,0.  F1 of sets reduces to
    ``2c / (p + r)``, so all three values are ratios of integers.

    Every size is used several times: where it is costly, bind it to a column that the optimizer keeps (``pairwise_f1``).
    """
    both_empty = (p == 0) & (r == 0)
    one_empty = (p == 0) | (r == 0)

    def pick(value: Column) -> Column:
        return F.when(both_empty, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(value)

    ratios = {"precision": (c, p), "recall": (c, r), "f1": (2 * c, p + r)}
    return F.struct(
        *(pick(round_ratio_half_even(num, den, places)).alias(name) for name, (num, den) in ratios.items()),
        *(pick(num / den).alias(f"raw_{name}") for name, (num, den) in ratios.items()),
    )
