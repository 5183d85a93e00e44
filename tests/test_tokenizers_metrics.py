"""U5 (offsets, decode), hot tokens (J5, J6) and U4 (user metrics at scale)."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maieutic.operators import metrics, span_qa
from maieutic.operators import tokens as tk
from maieutic.plans import registry
from maieutic.plans.catalog import queries

SF = "/root/testdata/sf0.001"


# --- J5, J6 ----------------------------------------------------------------------------------
def _plain_ids(texts, ids):
    import re

    return [[ids.get(t, tk.UNK_ID) for t in re.findall(r"\w+|[^\w\s]", x.lower())] for x in texts]


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_lookups_do_not_depend_on_the_frequent_part(spark, monkeypatch, hot):
    monkeypatch.setattr(tk, "HOT_ENTRIES", hot)
    rnd = random.Random(4)
    words = ["the", "of", "a,", "rare", "word", "x", "y", "z?"]
    texts = [" ".join(rnd.choices(words, [90, 40, 20, 3, 2, 1, 1, 1], k=rnd.randint(0, 30))) for _ in range(200)] + ["", " ", "unseen things"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    vocab = tk.build_vocab(df.where("doc_id < 200").select(tk.word_tokens(F.col("text")).alias("tokens")))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    rows = df.select("doc_id", tk.word_tokens(F.col("text")).alias("t"), tk.word_tokens(F.reverse("text")).alias("u"))
    got = {r["doc_id"]: (r["t_ids"], r["u_ids"]) for r in tk.encode(rows, "doc_id", ["t", "u"], vocab, ["t_ids", "u_ids"]).collect()}
    want, back = _plain_ids(texts, ids), _plain_ids([t[::-1] for t in texts], ids)
    assert got == {i: (want[i], back[i]) for i in range(len(texts))}
    encoded = tk.encode(rows, "doc_id", "t", vocab)
    by_id = {i: t for t, i in ids.items() if i >= len(tk.SPECIAL_TOKENS)}
    text = {r["doc_id"]: r["text"] for r in tk.decode(encoded, "doc_id", "ids", vocab).collect()}
    assert text == {i: " ".join(by_id[x] for x in w if x in by_id) for i, w in enumerate(want)}
    full = {r["doc_id"]: r["text"] for r in tk.decode(encoded, "doc_id", "ids", vocab, skip_special=False).collect()}
    assert full == {i: " ".join(by_id.get(x, tk.UNK) for x in w) for i, w in enumerate(want)}
    twice = rows.unionByName(rows.where("doc_id = 5"))
    with pytest.raises(Exception, match="unique ids"):
        tk.encode(twice, "doc_id", "t", vocab).collect()


def test_hot_tokens_are_not_shuffled(spark, monkeypatch):
    """With broadcasting left to the operator alone, no task joins more than three times the median's rows."""
    from pyspark.sql import Row  # noqa: F401

    monkeypatch.setattr(tk, "HOT_ENTRIES", 50)
    texts = [("the " * 300) + " ".join(f"w{(i * 7 + k) % 900}" for k in range(100)) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    vocab = tk.build_vocab(df.select(tk.word_tokens(F.col("text")).alias("tokens")))
    rows = df.select("doc_id", tk.word_tokens(F.col("text")).alias("tokens"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tk.encode(rows, "doc_id", "tokens", vocab)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1
        # What is left for the shuffle, by the hash it is dealt by.
        hot = vocab.where(f"NOT is_special AND id < {len(tk.SPECIAL_TOKENS) + 50}")
        left = rows.select(F.explode("tokens").alias("token")).join(F.broadcast(hot), "token", "left_anti")
        sizes = [r["count"] for r in left.groupBy(F.pmod(F.hash(F.xxhash64("token")), F.lit(8))).count().collect()]
        assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2] and sum(sizes) <= 120 * 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_row_per_token_is_made_of_known_tokens(spark):
    """Only what the tasks' table lacks is exploded: here nothing, of 40,000 tokens."""
    df = spark.createDataFrame([(i, "one two three four " * 100) for i in range(100)], "doc_id long, text string")
    rows = df.select("doc_id", tk.word_tokens(F.col("text")).alias("tokens"))
    vocab = tk.build_vocab(rows)
    encoded = tk.encode(rows, "doc_id", "tokens", vocab)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_rare" in plan and "posexplode(_t" not in plan
    assert encoded.select(F.size("ids").alias("n")).distinct().collect()[0]["n"] == 400


# --- U5 --------------------------------------------------------------------------------------
def test_user_tokenizers_get_slices_and_keep_all_rows(spark, monkeypatch):
    """A batch is cut, whatever its size, and every row has its own tokens."""
    monkeypatch.setattr(tk, "SLICE_CHARS", 50)
    slices = tk._slices([30, 30, 0, 200, 10, 10])
    assert list(slices) == [(0, 1), (1, 3), (3, 4), (4, 6)] and list(tk._slices([])) == [(0, 0)]
    texts = [None if i % 7 == 3 else "É" * (i % 5) + f" w{i}, " * (i % 4) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    most = 4 << 20  # more than a slice of it at once is an error
    counted = tk.pandas_tokenizer(lambda s: s.fillna("").str.findall(r"\w+") if s.str.len().sum() <= most else None)
    got = {r["id"]: r for r in df.select("id", tk.uncased_tokenizer().spans(F.col("text")).alias("s"), counted(F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i]["s"]] == tk.uncased_spans(t or "")
        assert len(got[i]["t"]) == (t or "").count("w") + ("É" in (t or ""))


def test_uncased_spans_count_original_characters():
    text = "Élan été, ﬁn İx_9²"
    got = tk.uncased_spans(text)
    assert [t for t, _, _ in got] == ["elan", "ete", ",", "ﬁn", "ix", "_", "9²"]
    assert [text[a:b] for _, a, b in got] == ["Élan", "été", ",", "ﬁn", "İx", "_", "9²"]
    marked = "cafe\u0301 e\u0301\u0302, o"
    assert [marked[a:b] for _, a, b in tk.uncased_spans(marked)] == ["cafe\u0301", "e\u0301\u0302", ",", "o"]
    plain, origin = tk.aligned("aﬁb", lambda c: {"ﬁ": "fi"}.get(c, c))
    assert (plain, origin) == ("afib", [0, 1, 1, 2])


QA = "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>"


def test_squad_labels_follow_a_users_offsets(spark):
    context = "Le café Zoë, c'est ÉTÉ partout."
    answer = "Zoë"
    rows = [("a", "Où ?", context, ([answer], [context.index(answer)])), ("b", "Où ?", context, (["ÉTÉ partout"], [context.index("ÉTÉ")])),
            ("c", "Où ?", context, ([], [])), ("d", None, None, None)]
    df = spark.createDataFrame(rows, QA)
    tokenizer = tk.uncased_tokenizer()
    vocab = tk.build_vocab(df.select(F.concat(tokenizer(F.col("question")), tokenizer(F.col("context"))).alias("tokens")))
    out = {r["id"]: r for r in registry.preprocess("squad", df, vocab=vocab, max_length=24, tokenizer=tokenizer).collect()}
    tokens = [t for t, _, _ in tk.uncased_spans(context)]
    lead = 2 + len(tk.uncased_spans("Où ?"))
    assert (out["a"]["start_positions"], out["a"]["end_positions"]) == (lead + tokens.index("zoe"),) * 2
    assert (out["b"]["start_positions"], out["b"]["end_positions"]) == (lead + tokens.index("ete"), lead + tokens.index("partout"))
    spans = [context[o["start"] : o["end"]] for o in out["a"]["offset_mapping"] if o is not None]
    assert spans == [context[a:b] for _, a, b in tk.uncased_spans(context)] and spans[1] == "café"
    assert out["c"]["start_positions"] is None and out["d"]["context_len"] == 0
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert out["a"]["input_ids"][lead : lead + len(tokens)] == [ids[t] for t in tokens]


def test_built_in_and_plain_function_keep_their_offsets(spark):
    rows = [("a", "What is blue?", "  The sky is\tblue today ", (["blue"], [13]))]
    df = spark.createDataFrame(rows, QA)
    vocab = tk.build_vocab(df.select(tk.word_tokens(F.concat_ws(" ", "question", "context")).alias("tokens")))
    for tokenizer in (tk.word_tokens, tk.pandas_tokenizer(lambda s: s.str.lower().str.findall(r"\w+|\?"))):
        r = registry.preprocess("squad", df, vocab=vocab, max_length=20, tokenizer=tokenizer).collect()[0]
        spans = [rows[0][2][o["start"] : o["end"]] for o in r["offset_mapping"] if o is not None]
        assert spans == ["The", "sky", "is", "blue", "today"]
        assert (r["start_positions"], r["end_positions"]) == (9, 9)
    plan = registry.preprocess("squad", df, vocab=vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(context") <= 1


def test_library_tokenizer_spans_and_decode(spark, tmp_path):
    library = pytest.importorskip("tokenizers")
    # A small byte-level tokenizer file made here: letters and a few merges.
    letters = sorted(library.pre_tokenizers.ByteLevel.alphabet())
    merges = [("Ġ", "s"), ("b", "l"), ("bl", "u"), ("blu", "e"), ("Ã", "©")]
    model = library.models.BPE({t: i for i, t in enumerate([*letters, *("".join(m) for m in merges)])}, merges)
    tokenizer = library.Tokenizer(model)
    tokenizer.pre_tokenizer = library.pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = library.decoders.ByteLevel()
    path = str(tmp_path / "t.json")
    tokenizer.save(path)
    own = tk.library_tokenizer(path)
    texts = ["sky blue é", None, "", "blue blue"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in df.select("id", own.spans(F.col("text")).alias("s"), own.join(own(F.col("text"))).alias("back")).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "")
        assert [(s["token"], s["start"], s["end"]) for s in got[i]["s"]] == [(a, *b) for a, b in zip(want.tokens, want.offsets)]
        assert got[i]["back"] == (t or "")
    vocab = tk.build_vocab(df.select(own(F.col("text")).alias("tokens")))
    ids = tk.encode(df.select("id", own(F.col("text")).alias("tokens")), "id", "tokens", vocab)
    back = {r["id"]: r["text"] for r in tk.decode(ids, "id", "ids", vocab, tokenizer=own).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


# --- U4 --------------------------------------------------------------------------------------
def _words_metric():
    """Made in a function, so that it is sent to the workers by value."""

    class _Words:
        """A metric with a state that is no sum: distinct words and the longest text of a group."""

        def init(self):
            return set(), None

        def update(self, state, frame):
            words, longest = state
            words = words | {w for t in frame["text"] for w in t.split()}
            top = max([*frame["text"], longest or ""], key=lambda t: (len(t), t))
            return words, top

        def merge(self, state, other):
            return state[0] | other[0], max([state[1] or "", other[1] or ""], key=lambda t: (len(t), t))

        def finish(self, state):
            return {"n_words": len(state[0]), "longest": state[1]}

    return _Words()


@pytest.mark.parametrize("held", [1, 10_000])
def test_a_users_metric_is_merged_over_partitions(spark, monkeypatch, held):
    monkeypatch.setattr(metrics, "GROUPS_HELD", held)
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.randint(0, 2), " ".join(rnd.choices("uvwxyz", k=rnd.randint(0, 5)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, text string").repartition(7)
    got = {(r["g"], r["k"]): (r["n_words"], r["longest"]) for r in metrics.metric_report(df, _words_metric(), "n_words bigint, longest string", ["g", "k"], ["text"]).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        texts = [t for *k, t in rows if tuple(k) == key]
        want[key] = (len({w for t in texts for w in t.split()}), max(texts, key=lambda t: (len(t), t)))
    assert got == want
    whole = metrics.metric_report(df, _words_metric(), "n_words bigint, longest string").collect()
    assert len(whole) == 1 and whole[0]["n_words"] == 6
    assert metrics.metric_report(df.limit(0), _words_metric(), "n_words bigint, longest string").count() == 0


def test_span_qa_report_as_a_users_metric(spark):
    rnd = random.Random(6)
    rows = [(i % 3, rnd.randint(0, 6), rnd.randint(0, 6), rnd.randint(0, 6), rnd.randint(0, 6)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, pred_start int, pred_end int, start_label int, end_label int").repartition(5)
    for groups in ([], ["g"]):
        built_in = span_qa.span_qa_report(df, groups).toPandas().sort_values(groups or "f1").reset_index(drop=True)
        own = metrics.metric_report(df, metrics.span_qa_metric(), metrics.SPAN_QA_RESULT, groups).toPandas().sort_values(groups or "f1").reset_index(drop=True)
        pd.testing.assert_frame_equal(own[built_in.columns], built_in, check_dtype=False, atol=1e-9)


def test_user_metric_queries_on_whole_tables(spark):
    q = queries()
    a, b = (q[n](spark, SF).collect()[0].asDict() for n in ("a14_span_qa_report", "u4_user_metric_report"))
    assert a == pytest.approx(b)
