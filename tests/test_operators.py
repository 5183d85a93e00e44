"""Golden rows (FIXTURES F2, F4-F11) and invariants for the DataFrame operators."""

import math

import pytest
from pyspark.sql import functions as F

from maieutic.operators import behavior, compare, dialogue, loss, sampling, span_qa, tokens


# --- A11 ---------------------------------------------------------------------------------
def test_behavior_metrics_f1_aggregate(spark):
    df = spark.createDataFrame(
        [(1, "Where do you expect the ripple to peak first?"), (2, "Conclusion: pick 22 nF near pin 4.")],
        "response_id bigint, text string")
    r = behavior.behavior_metrics(df).collect()[0].asDict()
    assert r["withhold_violation_rate"] == 1.0
    assert r["numeric_violation_rate"] == 0.5
    assert r["question_rate"] == 0.5 and r["avg_questions_per_response"] == 0.5
    assert r["avg_interrogative_ratio"] == pytest.approx(1 / 9)
    assert r["avg_response_length_chars"] == 39.5 and r["avg_response_length_tokens"] == 8.0
    assert r["p95_response_length_tokens"] == 9
    assert r["step_list_rate"] == 0.0 and r["contains_imperative_rate"] == 0.0


def test_behavior_metrics_empty_input_has_no_row(spark):
    df = spark.createDataFrame([], "response_id bigint, text string")
    assert behavior.behavior_metrics(df).count() == 0


def test_p95_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 40):
        df = spark.createDataFrame([(i, " ".join(["w"] * (i + 1))) for i in range(n)], "response_id int, text string")
        got = behavior.behavior_metrics(df).collect()[0]["p95_response_length_tokens"]
        lengths = sorted(i + 1 for i in range(n))
        assert got == lengths[max(0, min(math.ceil(0.95 * n) - 1, n - 1))]


# --- W1/W2, P9-P12 -------------------------------------------------------------------------
def _turns(spark, convs):
    rows = [(cid, t, role, f"m{cid}-{t}") for cid, roles in convs.items() for t, role in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_last_exchange_cases(spark):
    J, S = "user", "assistant"
    convs = {1: [J, S, J, S], 2: [J, S, J, S, J], 3: [J, J, S], 4: [S, J], 5: [J], 6: [J, "x", S]}
    got = {r["conv_id"]: r["last_user_turn"] for r in dialogue.last_exchange(_turns(spark, convs)).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_last_exchange_over_gaps_and_chunks(spark):
    rows = [(1, 0, "user"), (1, 2, "assistant"), (2, 255, "user"), (2, 900, "assistant"), (2, 901, "x"), (3, 1, "user"), (3, 5, "x"), (3, 9, "assistant")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string").withColumn("text", F.lit("t"))
    got = {r["conv_id"]: (r["last_user_turn"], r["target_turn"]) for r in dialogue.last_exchange(df).collect()}
    assert got == {1: (0, 2), 2: (255, 900)}
    dropped = dialogue.map_roles_train(df, {"user": "user", "assistant": "assistant"})
    assert {r["conv_id"] for r in dialogue.last_exchange(dropped).collect()} == {1, 2, 3}
    nested = spark.createDataFrame([(1, [("user", "a")], [("user", "b")]), (2, [], [("user", "b")]), (3, None, [("user", "b")])],
                                   "id int, messages array<struct<role:string,content:string>>, turns array<struct<role:string,content:string>>")
    picked = nested.select("id", dialogue.record_messages(F.col("messages"), F.col("turns")).alias("m")).collect()
    assert {r["id"]: r["m"][0]["content"] for r in picked} == {1: "a", 2: "b", 3: "b"}


def test_repeated_ids_stop_token_operators(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a")], "id int, text string")
    vocab = tokens.build_vocab(df.select(tokens.word_tokens(F.col("text")).alias("tokens")))
    rows = df.select("id", tokens.word_tokens(F.col("text")).alias("t"))
    for bad in (tokens.encode(rows, "id", "t", vocab), tokens.token_offsets(df, "id")):
        with pytest.raises(Exception, match="two rows share one id"):
            bad.collect()
    fine = {r["id"]: r["ids"] for r in tokens.encode(rows.where("size(t) <> 1 OR id = 2"), "id", "t", vocab).collect()}
    assert fine[2] == fine[1][:1] and len(fine[1]) == 2


def test_exact_sample_of_repeated_keys(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k int, v int")
    assert sampling.sample_n(df, 37, ["k"]).count() == 37
    per_group = sampling.sample_n(df.withColumn("g", F.col("v") % 2), 7, ["k"], partition_cols=["g"])
    assert [r["count"] for r in per_group.groupBy("g").count().collect()] == [7, 7]
    assert sampling.exact_split(df, ["k"], 0.25).where("split = 'test'").count() == 25


def test_eval_prompt_rendering(spark):
    df = _turns(spark, {1: ["system", "user", "assistant", "user", "assistant"]})
    r = dialogue.eval_examples(df).collect()[0]
    assert r["prompt"] == "SYSTEM:\nm1-0\n\nUSER:\nm1-1\n\nASSISTANT:\nm1-2\n\nUSER:\nm1-3\n\nASSISTANT:\n"
    assert r["target"] == "m1-4" and r["target_turn"] == 4


def test_turns_mode_maps_roles_and_adds_system(spark):
    df = _turns(spark, {1: ["junior_engineer", "senior_engineer", "other"]})
    df = df.union(spark.createDataFrame([(1, 3, "junior_engineer", "q"), (1, 4, "senior_engineer", "a")],
                                        df.schema))
    r = dialogue.eval_examples(df, mode="turns").collect()[0]
    assert r["prompt"].startswith("SYSTEM:\n" + dialogue.EVAL_SYSTEM_PROMPT + "\n\nUSER:\nm1-0\n\nASSISTANT:\nm1-1")
    assert "USER:\nm1-2" in r["prompt"] and r["target"] == "a"


def test_policy_prompts(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True), (4, None, None)],
                               "id int, w boolean, a boolean")
    got = {r["id"]: r["p"] for r in df.select("id", dialogue.policy_system_prompt("w", "a").alias("p")).collect()}
    base = dialogue.POLICY_BASE_PROMPT
    assert got[1] == base + dialogue.POLICY_RULE_INTRO + "withhold the final answer and avoid numeric rules of thumb."
    assert got[2] == base + dialogue.POLICY_RULE_INTRO + "withhold the final answer."
    assert got[3] == base + dialogue.POLICY_RULE_INTRO + "avoid numeric rules of thumb."
    assert got[4] == base + dialogue.POLICY_DEFAULT_TEXT


def test_ordered_concat_many_chunks(spark):
    df = spark.createDataFrame([(1, t, str(t)) for t in range(1000)], "k int, t int, v string")
    out = dialogue.ordered_concat(df, ["k"], "t", "v", ",", "s", chunk=64).collect()[0]["s"]
    assert out == ",".join(str(t) for t in range(1000))


# --- K1-K4, K9 -------------------------------------------------------------------------------
def test_exact_split_invariants(spark):
    df = spark.range(0, 2345).withColumnRenamed("id", "k")
    a = sampling.exact_split(df, ["k"], 0.2)
    b = sampling.exact_split(df.repartition(7), ["k"], 0.2)
    rows_a = {r["k"]: r["split"] for r in a.collect()}
    rows_b = {r["k"]: r["split"] for r in b.collect()}
    assert len(rows_a) == 2345 and rows_a == rows_b
    assert sum(1 for v in rows_a.values() if v == "test") == math.ceil(0.2 * 2345)


def test_sample_n_and_batches(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    s = sampling.sample_n(df, 137, ["k"]).collect()
    assert len(s) == 137 and len({r["k"] for r in s}) == 137
    assert sampling.sample_n(df, 5000, ["k"]).count() == 1000
    ranks = sorted(r["rank"] for r in sampling.hash_rank(df, ["k"]).collect())
    assert ranks == list(range(1, 1001))
    batches = sampling.assign_batches(df, 64, ["k"]).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [40] + [64] * 15


# --- R1-R7, W3, W4, P13 ----------------------------------------------------------------------
def test_prompt_answer_example(spark):
    df = spark.createDataFrame([([11, 12, 13], [21, 22, 23, 24])], "q array<int>, a array<int>")
    r = df.select(tokens.prompt_answer_example(F.col("q"), F.col("a"), 10).alias("x")).collect()[0]["x"]
    assert r["labels"] == [-100, -100, -100, 21, 22, 23, 24, -100, -100, -100]
    assert r["attention_mask"] == [1] * 7 + [0] * 3 and r["input_ids"][:7] == [11, 12, 13, 21, 22, 23, 24]
    r5 = df.select(tokens.prompt_answer_example(F.col("q"), F.col("a"), 5).alias("x")).collect()[0]["x"]
    assert r5["input_ids"] == [11, 12, 13, 21, 22] and r5["labels"] == [-100, -100, -100, 21, 22]


def test_target_spans_and_checks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [-100, 5, 6, -100, 7]), ([1], [1]), ([1], [-100]), ([], [])],
                               "ids array<int>, labels array<int>")
    out = df.select(tokens.target_spans(F.col("labels")).alias("s"),
                    tokens.supervision_counts(F.col("ids"), F.col("labels")).alias("c")).collect()
    assert [(x["start"], x["end"]) for x in out[0]["s"]] == [(1, 3), (4, 5)]
    assert [(x["start"], x["end"]) for x in out[1]["s"]] == [(0, 1)]
    assert out[2]["s"] == [] and out[3]["s"] == []
    assert [o["c"]["reason"] for o in out] == [None, "all tokens are targets", "no target tokens", "0 tokens"]


def test_clm_blocks(spark):
    df = spark.createDataFrame([(list(range(10)),), (list(range(3)),)], "ids array<int>")
    out = df.select(tokens.clm_blocks(F.col("ids"), 4).alias("b")).collect()
    assert out[0]["b"] == [[0, 1, 2, 3], [4, 5, 6, 7]] and out[1]["b"] == []


def test_token_offsets_and_answer_positions(spark):
    df = spark.createDataFrame([(1, "The sky is blue today")], "id int, text string")
    toks = tokens.token_offsets(df, "id")
    assert [(r["start"], r["end"]) for r in toks.orderBy("pos").collect()] == [(0, 3), (4, 7), (8, 10), (11, 15), (16, 21)]
    ex = spark.createDataFrame(
        [(1, 11, "blue", 0, 5), (1, 8, "is blue", 0, 5), (1, 12, "lu", 0, 5), (1, 16, "today", 0, 5),
         (1, 16, "today", 0, 3), (1, None, None, 0, 5)],
        "id int, answer_start int, answer_text string, context_start int, context_len int")
    ex = ex.withColumn("k", F.monotonically_increasing_id())
    got = []
    for r in ex.collect():
        one = spark.createDataFrame([(1, r["answer_start"], r["answer_text"], 0, r["context_len"])], ex.drop("k").schema)
        got.append(tuple(span_qa.answer_positions(toks, one, "id").collect()[0])[1:])
    assert got == [(3, 3), (2, 3), (3, 3), (4, 4), (0, 0), (None, None)]


# --- K5-K7, R9, A14 ----------------------------------------------------------------------------
def test_best_span_cases(spark):
    offs = [{"s": 0, "e": 1}, {"s": 2, "e": 3}, {"s": 4, "e": 5}]
    df = spark.createDataFrame(
        [(1, [0.1, 0.9, 0.2], [0.8, 0.1, 0.7], offs, 1, 1), (2, [0.0, 0.0, 9.0], [9.0, 0.0, 0.0], offs, 1, 1)],
        "example_id int, start_logits array<double>, end_logits array<double>, "
        "offset_mapping array<struct<s:int,e:int>>, start_label int, end_label int")
    b1 = df.select(span_qa.best_span(F.col("start_logits"), F.col("end_logits"), F.col("offset_mapping")).alias("b"))
    r = b1.collect()
    assert (r[0]["b"]["start"], r[0]["b"]["end"]) == (1, 2) and r[0]["b"]["score"] == pytest.approx(1.6)
    b2 = df.select(span_qa.best_span(F.col("start_logits"), F.col("end_logits"), F.col("offset_mapping"), 1).alias("b"))
    r2 = b2.collect()[1]["b"]
    assert (r2["start"], r2["end"], r2["from_candidates"]) == (2, 0, False)
    dec = df.withColumn("pred_start", F.lit(1)).withColumn("pred_end", F.lit(2))
    f1 = dec.select(span_qa.span_f1(F.col("pred_start"), F.col("pred_end"), F.col("start_label"),
                                    F.col("end_label")).alias("f")).collect()[0]["f"]
    assert f1 == pytest.approx(2 / 3)
    rep = span_qa.span_qa_report(dec).collect()[0]
    assert rep["start_accuracy"] == 1.0 and rep["end_accuracy"] == 0.0 and rep["exact_match"] == 0.0


# --- J1, A15 --------------------------------------------------------------------------------------
def test_pairing_and_summary(spark):
    t = spark.createDataFrame([(1, "the cat sat"), (2, ""), (3, "x")], "id int, output string")
    b = spark.createDataFrame([(1, "The cat ran fast"), (2, ""), (4, "y")], "id int, output string")
    scored = compare.pairwise_f1(compare.pair_outputs(t, b))
    s = compare.f1_summary(scored).collect()[0]
    assert (s["n_pairs"], s["min_f1"], s["max_f1"]) == (2, 0.5714, 1.0)
    assert s["mean_f1"] == 0.7857
    u = compare.unpaired_counts(t, b).collect()[0]
    assert (u["trained_only"], u["baseline_only"]) == (1, 1)


# --- A12, A13 -----------------------------------------------------------------------------------------
def test_missing_losses_carry_no_weight(spark):
    df = spark.createDataFrame([(2.0, 10), (None, 5), (3.0, None)], "loss double, n_tokens bigint")
    r = loss.weighted_loss(df).collect()[0]
    assert (r["n_tokens"], r["eval_loss"]) == (10, 2.0)


def test_weighted_loss(spark):
    df = spark.createDataFrame([(1, 2.0, 10), (1, 1.0, 30), (2, 1.0, 0), (3, 50.0, 1)], "g int, loss double, n_tokens int")
    got = {r["g"]: r for r in loss.weighted_loss(df, group_cols=["g"]).collect()}
    assert got[1]["eval_loss"] == 1.25 and got[1]["perplexity"] == pytest.approx(math.exp(1.25))
    assert math.isnan(got[2]["eval_loss"]) and math.isnan(got[2]["perplexity"])
    assert got[3]["perplexity"] == pytest.approx(math.exp(20.0))


# --- T19 -----------------------------------------------------------------------------------
def test_pairwise_f1_cuts_each_text_once(spark):
    rows = [(1, "the cat sat", "The cat ran fast"), (2, "", None), (3, "a", ""), (4, "a a b", "b c d")]
    df = spark.createDataFrame(rows, "id int, trained_output string, baseline_output string")
    scored = compare.pairwise_f1(df)
    for out in (scored, scored.select("id", "precision", "recall", "f1", "raw_f1"), compare.f1_summary(scored)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 2 and plan.count("array_intersect") == 1
    got = {r["id"]: (r["precision"], r["recall"], r["f1"], r["raw_f1"]) for r in scored.collect()}
    assert got == {1: (0.6667, 0.5, 0.5714, 4 / 7), 2: (1.0, 1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0, 0.0), 4: (0.5, 0.3333, 0.4, 0.4)}
    assert scored.columns == [*df.columns, "f1_metrics", "precision", "recall", "f1", "raw_precision", "raw_recall", "raw_f1"]


# --- K4 ------------------------------------------------------------------------------------
def test_small_samples_take_one_scan_and_equal_large_ones(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id", "id % 3 AS g", "CAST(NULL AS STRING) AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = lambda x: sorted((r["id"], r["g"]) for r in x.collect())
    calls = [(n, groups) for n in (0, 1, 37, 5000) for groups in ([], ["g"], ["n"])]
    small = {}
    for n, groups in calls:
        sample = sampling.sample_n(df, n, ["id"], partition_cols=groups)
        if n == 37:
            plan = sample._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1 and ("TakeOrderedAndProject" in plan or "WindowGroupLimit" in plan)
        small[n, tuple(groups)] = rows(sample)
    monkeypatch.setattr(sampling, "BOTTOM_K", -1)
    for n, groups in calls:
        assert small[n, tuple(groups)] == rows(sampling.sample_n(df, n, ["id"], partition_cols=groups))
        assert len(small[n, tuple(groups)]) == (min(n, 2000) if groups != ["g"] else sum(min(n, k) for k in (667, 667, 666)))


def test_ranks_and_batches_of_a_null_group(spark):
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'a' END AS g")
    ranked = sampling.hash_rank(df, ["id"], partition_cols=["g"]).collect()
    assert sorted((r["g"] or "", r["rank"]) for r in ranked) == sorted((g, i) for g in ("", "a") for i in range(1, 31))
