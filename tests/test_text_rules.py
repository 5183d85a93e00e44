"""T1-T19 against hand-derived rows, and each fixed pattern against Python ``re`` on random strings."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maieutic.functions import text_rules as tr

def features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    t = F.col("text")
    return {r["id"]: r for r in df.select(
        "id",
        tr.is_withhold_violation(t).alias("w"), tr.is_numeric_violation(t).alias("n"),
        tr.count_questions(t).alias("q"), tr.count_step_lines(t).alias("steps"),
        tr.interrogative_ratio(t).alias("ratio"), tr.contains_imperative(t).alias("imp"),
        tr.char_length(t).alias("chars"), tr.whitespace_token_count(t).alias("tok"),
        tr.strip_text(t).alias("stripped"),
    ).collect()}


GOLDEN = [
    # text, withhold, numeric, questions, imperative, chars, tokens
    ("Where do you expect the ripple to peak first?", True, False, 1, False, 45, 9),
    ("Conclusion: pick 22 nF near pin 4.", True, True, 0, False, 34, 7),
    ("", False, False, 0, False, 0, 0),
    ("   ", False, False, 0, False, 3, 0),
    ("answer: x", False, False, 0, False, 9, 2),
    ("answer:x", True, False, 0, False, 8, 1),
    ("2020-2021", False, True, 0, False, 9, 1),
    ("5%a", False, True, 0, False, 3, 1),
    ("5% ", False, False, 0, False, 3, 1),
    ("< 7 apples", False, True, 0, False, 10, 3),
    ("< 7 x", False, False, 0, False, 5, 3),
    ("- one\n- two\n- three", True, False, 0, False, 19, 6),
    ("- one?\n- two?\n- three?", False, False, 3, False, 22, 6),
    ("Ok. Use it", True, False, 0, True, 10, 3),
    ("\nFinal: x", True, False, 0, False, 9, 2),
    ("5Ω", False, True, 0, False, 2, 1),
    ("25°C", False, True, 0, False, 4, 1),
    # A superscript or fraction is a word character, so no boundary lies before it.
    ("area is 5 mm²", False, False, 0, False, 13, 4),
    ("area is 5 mm wide", False, True, 0, False, 17, 5),
    ("do ½ now", True, False, 0, True, 8, 3),
    ("20-21² x", False, False, 0, False, 8, 2),
    ("20-21 x", False, True, 0, False, 7, 2),
    ("set it at 5² now", False, False, 0, True, 16, 5),
    ("set it at 5 now", False, True, 0, True, 15, 5),
    ("Use² it", False, False, 0, False, 7, 2),
    ("Use it", True, False, 0, True, 6, 2),
    ("use\u00a0it", True, False, 0, True, 6, 2),
    ("use\x1cit", True, False, 0, True, 6, 2),
    ("a therefore\u0301 b", True, False, 0, False, 14, 3),
    ("reuse it", False, False, 0, False, 8, 2),
    ("Choose one. Is it?", True, False, 1, False, 18, 4),
    ("1. a\n2. b\n3. c?", True, False, 1, False, 15, 6),
    ("1. a?\n2. b?\n3. c?", False, False, 3, False, 17, 6),
    ("- a\n- b\n-  ", False, False, 0, False, 11, 5),
    ("conclusion - fine", True, False, 0, False, 17, 3),
    ("my conclusion - fine", False, False, 0, False, 20, 4),
    ("> 5 and 3 mm", False, True, 0, False, 12, 5),
]


def test_golden_rows(spark):
    got = features(spark, [g[0] for g in GOLDEN])
    for i, (text, w, n, q, imp, chars, tok) in enumerate(GOLDEN):
        r = got[i]
        assert (r["w"], r["n"], r["q"], r["imp"], r["chars"], r["tok"]) == (w, n, q, imp, chars, tok), text


def test_both_violations_at_once(spark):
    sample = "Conclusion - place 4 nF beside the pin.\n- Lift the shield\n- Swap the probe\n- Read 12-15 ns"
    r = features(spark, [sample])[0]
    assert r["w"] is True and r["n"] is True


def test_interrogative_ratio_golden(spark):
    got = features(spark, ["Where do you expect the ripple to peak first?", "scanner", ""])
    assert got[0]["ratio"] == pytest.approx(2 / 9)
    assert got[1]["ratio"] == pytest.approx(1.0)  # "can" inside "scanner"
    assert got[2]["ratio"] is None


ALPHABET = list("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + list(
    ".!?:-*<>=%\n\t,;'\"()_") + ["Ω", "°C", "\u00a0", "é", "ß", "K", "Ä", "١", "²", "½", "①", "e\u0301", "\u200d", "\u200c", "‿", "\x1c",
    "\x85", "\u3000", "Ⅷ"] + [
    " do ", " use ", " set it to ", "answer:", " the answer is ", "Final", "1. ", "- ", " mV", " kHz",
    " to ", "what ", "could ", " choose ", " 3.3", "Remove ", ". Use ", "therefore", "in summary"]

PATTERNS = [f"(?i){p}" for p in tr.WITHHOLD_PHRASE_PATTERNS] + [
    tr.FINAL_FORMAT_PATTERN, tr.STEP_LINE_PATTERN, tr.NUMBER_WITH_UNIT_PATTERN, tr.RANGE_PATTERN, tr.COMPARISON_PATTERN,
    tr.PRESCRIPTION_PATTERN, tr.IMPERATIVE_PATTERN, r"\w+", r"\W+", r"\s+", r"\S+", r"\b\w+\b", r"\b", r"[^\w\s]", r"\d+",
]

SEARCHED = [
    (tr.FINAL_FORMAT_REGEX, tr.FINAL_FORMAT_PATTERN), (tr.NUMBER_WITH_UNIT_REGEX, tr.NUMBER_WITH_UNIT_PATTERN), (tr.RANGE_REGEX, tr.RANGE_PATTERN),
    (tr.COMPARISON_REGEX, tr.COMPARISON_PATTERN), (tr.PRESCRIPTION_REGEX, tr.PRESCRIPTION_PATTERN), (tr.IMPERATIVE_REGEX, tr.IMPERATIVE_PATTERN),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_match_as_in_python(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    counts = [F.regexp_count("text", F.lit(tr.java_regex(p))).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    phrases = F.col("text").rlike(tr.WITHHOLD_PHRASES_REGEX).alias("phrases")
    searched = [F.col("text").rlike(r).alias(f"s{i}") for i, (r, _) in enumerate(SEARCHED)]
    steps = tr.count_step_lines("text").alias("steps")
    plain = [tr.strip_text(F.col("text")).alias("stripped"), tr.char_length("text").alias("chars"), tr.whitespace_token_count("text").alias("tok")]
    for r in df.select("id", *counts, phrases, steps, *searched, *plain).collect():
        t = texts[r["id"]]
        for i, p in enumerate(PATTERNS):
            assert r[f"p{i}"] == sum(1 for _ in re.finditer(p, t)), (p, t)
        assert r["phrases"] == any(re.search(p, t, re.IGNORECASE) for p in tr.WITHHOLD_PHRASE_PATTERNS), t
        assert r["steps"] == len(re.findall(tr.STEP_LINE_PATTERN, t)), t
        for i, (_, p) in enumerate(SEARCHED):
            assert r[f"s{i}"] == bool(re.search(p, t)), (p, t)
        assert (r["stripped"], r["chars"], r["tok"]) == (t.strip(), len(t), len(t.split())), t


#: Pieces around which the linear patterns differ in form from the definitions.
NEAR = ["use", "Set", "limit", "5", "12", "3.3", ".", ". ", " ", "  ", "\n", "\n\n", " \n", "\t", "-", "to", " to ", "mV", "%", "in", "V", "x", "²", "_",
        "<", ">=", "=", "1.", "- ", "* ", "*", "final", "Conclusion", ":", " : ", "a", "do", "answer:", "\u00a0", "\x1c", "\u2028", "١", "°C"]


def test_linear_patterns_have_the_truth_values_of_the_definitions(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(NEAR) for _ in range(rnd.randint(1, 14))) for _ in range(12_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    searched = [F.col("text").rlike(r).alias(f"s{i}") for i, (r, _) in enumerate(SEARCHED)]
    for r in df.select("id", tr.count_step_lines("text").alias("steps"), *searched).collect():
        t = texts[r["id"]]
        assert r["steps"] == len(re.findall(tr.STEP_LINE_PATTERN, t)), t
        for i, (_, p) in enumerate(SEARCHED):
            assert r[f"s{i}"] == bool(re.search(p, t)), (p, t)


MEGABYTE = {
    "blanks": " " * 1_000_000, "line feeds": "\n" * 1_000_000, "verbs": "use it " * 143_000, "digits": "7" * 1_000_000,
    "a digit and blanks": "5" + " " * 1_000_000, "digits and blanks": "5 " * 500_000, "numbers and blanks": ("12" + " " * 500) * 2000,
    "stars": "*" * 1_000_000, "line feeds and blanks": "\n " * 500_000, "final": "final\n" * 166_000, "points": "." * 1_000_000,
    "comparisons": "< " * 500_000, "almost numbers": "use 5x " * 143_000, "to": "5 to " * 200_000, "do": "do" + " " * 1_000_000,
}


@pytest.mark.parametrize("rule", [
    tr.count_step_lines, tr.has_answer_phrase, tr.has_final_format, tr.is_withhold_violation, tr.has_number_with_unit,
    tr.has_numeric_range, tr.has_comparison, tr.has_prescription, tr.is_numeric_violation, tr.contains_imperative,
], ids=lambda f: f.__name__)
def test_rules_are_linear(spark, rule):
    """A row of a megabyte takes under 2 s whatever it repeats."""
    df = spark.createDataFrame([("warm", " a 5 mV\n")], "kind string, text string")
    df.select(rule(F.col("text"))).collect()
    for kind, text in MEGABYTE.items():
        df = spark.createDataFrame([(kind, text)], "kind string, text string").repartition(1)
        start = time.perf_counter()
        df.select(rule(F.col("text"))).collect()
        assert time.perf_counter() - start < 2, kind


def test_tokens_and_marks_of_every_code_point(spark):
    """Blanks are those of ``str.split``, in the basic plane and beyond, alone and in runs."""
    codes = [*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF]
    texts = [f"a{chr(c)}b?{chr(c)}{chr(c)} !{chr(c)}." for c in codes] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(8)
    t = F.col("text")
    got = df.select("id", tr.whitespace_token_count(t).alias("tok"), tr.count_questions(t).alias("q"), tr.count_sentence_marks(t).alias("m")).collect()
    want = {i: (len(t.split()), t.count("?"), sum(map(t.count, ".!?"))) if t else (None, None, None) for i, t in enumerate(texts)}
    assert {r.id: (r.tok, r.q, r.m) for r in got} == want


def test_first_characters_of_number_rules_are_those_of_python(spark):
    """Each verb in any case (also the long s), digits of any script, and what may stand before them."""
    verbs = re.search(r"\(([a-z|]+)\)", tr.PRESCRIPTION_PATTERN)[1].split("|")
    heads = [w for verb in verbs for w in (verb, verb.upper(), verb.title(), verb.replace("s", "\u017f"), "x" + verb, "." + verb, "²" + verb)]
    numbers = ["5", "\u0663", "x5", "_5", "²5", "5.5", "é5", "-5", "5 V", "\u0663mm", "5-\u0663", "a5-7", "5 to 7 v", ".5-7", ""]
    texts = [f"{head} it {number}" for head in heads for number in numbers]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rules = [(tr.has_number_with_unit, tr.NUMBER_WITH_UNIT_PATTERN), (tr.has_numeric_range, tr.RANGE_PATTERN), (tr.has_prescription, tr.PRESCRIPTION_PATTERN)]
    got = {r[0]: tuple(r[1:]) for r in df.select("id", *[rule("text").alias(f"r{i}") for i, (rule, _) in enumerate(rules)]).collect()}
    assert got == {i: tuple(re.search(p, t) is not None for _, p in rules) for i, t in enumerate(texts)}


def test_token_count_costs_what_a_word_count_costs(spark):
    """The blanks of the rule are many ranges; asking all of them at every character took 15 times as long."""
    text = "Some prose goes here, où les mots sont courts and runs on. " * 400
    df = spark.range(400).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).repartition(4).cache()
    assert df.count() == 400

    def seconds(column):
        took = []
        for _ in range(3):
            start = time.time()
            df.select(F.sum(column)).collect()
            took.append(time.time() - start)
        return min(took)

    assert seconds(tr.whitespace_token_count("text")) < 5 * seconds(tr.word_count("text")) + 0.1
    df.unpersist()


def test_interrogative_ratio_counts_numbers_as_words(spark):
    got = features(spark, ["why ½", "½ cup x²", "①②", "do\u2003you", "a\u200db"])
    assert [got[i]["ratio"] for i in range(5)] == [0.5, 0.0, 0.0, 0.5, 0.0]


def test_strip_is_linear(spark):
    texts = ["x" + " " * 200_000 + "y", " " * 200_000]
    start = time.perf_counter()
    got = features(spark, texts)
    assert time.perf_counter() - start < 20
    assert [len(got[i]["stripped"]) for i in range(2)] == [200_002, 0]


def test_set_f1_golden(spark):
    rows = [("the cat sat", "The cat ran fast"), ("", ""), ("a", ""), ("a a a", "a")]
    df = spark.createDataFrame(rows, "p string, r string")
    out = df.select(tr.set_f1(tr.word_set(F.col("p")), tr.word_set(F.col("r"))).alias("m")).collect()
    got = [(x["m"]["precision"], x["m"]["recall"], x["m"]["f1"]) for x in out]
    raw = [(x["m"]["raw_precision"], x["m"]["raw_recall"], x["m"]["raw_f1"]) for x in out]
    assert raw == [(2 / 3, 2 / 4, 4 / 7), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    assert got == [(0.6667, 0.5, 0.5714), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
