"""Streaming = batch (X1-X5), the as-of attach (J9, FIXTURES F12), readers (S3, S4, P3-P5), registry, entry."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from maieutic.plans import registry
from maieutic.sources import io
from maieutic.streaming import asof, step_metrics

SF = "/root/testdata/sf0.001"


def _steps(spark):
    rows = [("r", s, i, i, t) for i, (s, t) in enumerate(
        [(0, "Use 5 V."), (50, "Why? What now?"), (50, "Why? What now?"), (75, "x"), (100, "Set it to 3 mA."),
         (100, "How would you check it?")])]
    return spark.createDataFrame(rows, "run_id string, step int, prompt_id int, response_id int, text string")


def test_eval_steps_every_n(spark):
    got = sorted({r["step"] for r in step_metrics.eval_steps(_steps(spark), 50).collect()})
    assert got == [50, 100]


def test_stream_equals_batch(spark, tmp_path):
    df = _steps(spark)
    src = str(tmp_path / "src")
    df.write.parquet(src)
    batch = {(r["run_id"], r["step"]): r.asDict() for r in step_metrics.step_metrics(df, 50).collect()}
    stream = spark.readStream.schema(df.schema).parquet(src)
    sink = str(tmp_path / "sink")
    q = step_metrics.start_step_metrics_stream(stream, 50, sink, str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(sink).collect()
    assert {r["metric"] for r in rows} == {"custom/" + m for m in
                                           ["withhold_violation_rate", "numeric_violation_rate", "question_rate",
                                            "avg_questions_per_response", "avg_interrogative_ratio",
                                            "avg_response_length_chars", "avg_response_length_tokens",
                                            "p95_response_length_tokens", "step_list_rate",
                                            "contains_imperative_rate"]}
    for r in rows:
        assert batch[(r["run_id"], r["step"])][r["metric"][len("custom/"):]] == pytest.approx(r["value"])


def test_stream_of_late_and_repeated_rows_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    texts = ["Why? What now?", "Use 5 V.", "Set it to 3 mA.", "How would you check it?", "x"]
    rows = [("r", 50 * (1 + i % 3), i % 7, i, texts[i % 5], base + dt.timedelta(minutes=i)) for i in range(60)]
    schema = "run_id string, step int, prompt_id int, response_id int, text string, ts timestamp"
    src = str(tmp_path / "src")
    # Three files, one micro-batch each: later ones repeat and bring older rows.
    for part in (rows[:30], rows[20:45] + rows[:5], rows[40:] + rows[10:12]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    whole = spark.createDataFrame(rows, schema)
    subset = step_metrics.eval_subset_ids(whole, 4)
    want = step_metrics.prefixed_metric_rows(step_metrics.step_metrics(whole, 50, subset_ids=subset)).collect()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = step_metrics.start_step_metrics_stream(stream, 50, str(tmp_path / "sink"), str(tmp_path / "ckpt"), trigger_once=True,
                                               subset_ids=subset, watermark_col="ts", delay="2 hours")
    q.awaitTermination(240)
    got = spark.read.schema("metric string, value double, run_id string, step int").parquet(str(tmp_path / "sink")).collect()
    key = lambda r: (r["run_id"], r["step"], r["metric"])
    assert sorted((*key(r), r["value"]) for r in got) == sorted((*key(r), r["value"]) for r in want)


def _events(spark, spec):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=m), 1, kind) for i, (m, kind) in enumerate(spec)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string")


def test_attach_next_log_cases(spark):
    ev = _events(spark, [(50, "error"), (60, "view"), (100, "error"), (100, "view")])
    got = sorted((r["log_id"], r["metric_id"]) for r in
                 asof.attach_next_log(ev, "user_id", "ts", "event_id", "event_type", "error", "view").collect())
    assert got == [(1, 0), (3, 2)]
    ev2 = _events(spark, [(50, "error"), (55, "error"), (600, "view")])  # next log is hours later
    got2 = [(r["log_id"], r["metric_id"]) for r in
            asof.attach_next_log(ev2, "user_id", "ts", "event_id", "event_type", "error", "view").collect()]
    assert got2 == [(2, 1)]
    busy = _events(spark, [(i, "error" if i % 3 else "view") for i in range(50)])  # one hour in many slices
    plain = sorted(tuple(r) for r in asof.attach_next_log(busy, "user_id", "ts", "event_id", "event_type", "error", "view").collect())
    sliced = asof.attach_next_log(busy, "user_id", "ts", "event_id", "event_type", "error", "view", events_per_slice=4)
    assert sorted(tuple(r) for r in sliced.collect()) == plain == [(1, 3 * i, 3 * i - 1) for i in range(1, 17)]


def _attached(rows):
    return sorted((r["user_id"], r["log_id"], r["metric_id"]) for r in rows)


def test_attach_on_a_stream_equals_the_table(spark, tmp_path):
    """Late, equal and repeated time stamps over several micro-batches, and a restart from the checkpoint in between."""
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string"
    rows = [(i, base + dt.timedelta(seconds=rnd.randint(0, 1200), microseconds=rnd.choice([0, 0, 1, 999_999])), rnd.randint(1, 4),
             rnd.choice(["error", "error", "view", "click"])) for i in range(400)]
    rows += [(1000, rows[3][1], rows[3][2], "view"), (1001, rows[3][1], rows[3][2], "error")]
    rows.sort(key=lambda r: (r[1] + dt.timedelta(seconds=rnd.randint(0, 200)), r[0]))  # up to 200 s late
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    parts[3] += parts[2][:25]  # repeated rows
    # The last event moves the watermark past all others; its own run has no log.
    parts.append([(5000, base + dt.timedelta(hours=3), 99, "error")])
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    call = ("user_id", "ts", "event_id", "event_type", "error", "view")
    for n, batches in enumerate((parts[:4], parts[4:])):
        for part in batches:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        found = asof.attach_next_log_stream(stream, *call, delay="4 minutes", slice_seconds=30)
        q = found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
        assert q.awaitTermination(240)
        if n == 0:
            assert 0 < spark.read.parquet(out).count()
    want = asof.attach_next_log(spark.createDataFrame(rows, schema), *call)
    got = spark.read.parquet(out)
    assert got.columns == want.columns and _attached(got.collect()) == _attached(want.collect())


def test_attach_on_a_stream_leaves_out_what_comes_too_late(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id string, ts timestamp, user_id string, event_type string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    at = lambda minutes: base + dt.timedelta(minutes=minutes)
    parts = [
        [("m1", at(1), "a", "error"), ("l1", at(2), "a", "view"), ("m2", at(3), "a", "error"), (None, at(3), "a", "error"), ("x", None, "a", "view")],
        [("t1", at(60), "b", "error")],  # the first slices are done with
        [("late", at(2.5), "a", "view"), ("l2", at(61), "a", "view")],
        [("t2", at(200), "b", "error")],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    found = asof.attach_next_log_stream(stream, "user_id", "ts", "event_id", "event_type", "error", "view", delay="1 minute")
    q = found.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(out)
    assert q.awaitTermination(240)
    assert _attached(spark.read.parquet(out).collect()) == [("a", "l1", "m1"), ("a", "l2", "m2")]


def test_read_prompts_formats(spark, tmp_path):
    txt = tmp_path / "p.txt"
    txt.write_text("  first \n\n second\n")
    assert [r["prompt"] for r in io.read_prompts(spark, str(txt)).orderBy("prompt_id").collect()] == ["first", "second"]
    jl = tmp_path / "p.jsonl"
    jl.write_text('{"prompt": "", "question": " q1 "}\n\n{"prompt": "  "}\n{"prompt": "p3"}\n')
    assert [r["prompt"] for r in io.read_prompts(spark, str(jl)).orderBy("prompt_id").collect()] == ["q1", "", "p3"]
    js = tmp_path / "p.json"
    js.write_text(json.dumps(["a ", {"question": "b"}]))
    assert [r["prompt"] for r in io.read_prompts(spark, str(js)).orderBy("prompt_id").collect()] == ["a", "b"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"answer": "x"}\n')
    with pytest.raises(io.InputError):
        io.read_prompts(spark, str(bad))
    good, rejects = io.read_prompts(spark, str(bad), strict=False)
    assert good.count() == 0 and rejects.count() == 1
    with pytest.raises(ValueError):
        io.read_prompts(spark, str(tmp_path / "p.csv"))
    for name, text, reason in (
        ("o.json", '{"prompt": "p"}', io.NOT_A_LIST), ("b.json", '["a", ', io.BAD_JSON), ("n.json", "[5]", io.WRONG_TYPE),
        ("b.jsonl", "{bad", io.BAD_JSON), ("s.jsonl", '"s"', io.WRONG_TYPE), ("m.jsonl", '{"answer": 1}', io.NO_FIELD),
    ):
        (tmp_path / name).write_text(text)
        good, rejects = io.read_prompts(spark, str(tmp_path / name), strict=False)
        assert good.count() == 0 and [r["reason"] for r in rejects.collect()] == [reason]
    (tmp_path / "braces.json").write_text('["{x} is a set, why?"]')
    assert [r["prompt"] for r in io.read_prompts(spark, str(tmp_path / "braces.json")).collect()] == ["{x} is a set, why?"]


def test_json_layout_auto(spark, tmp_path):
    arr = tmp_path / "a.json"
    arr.write_text('\n  [{"x": 1}, {"x": 2}]')
    lines = tmp_path / "l.json"
    lines.write_text('{"x": 1}\n\n{"x": 2}\n')
    empty = tmp_path / "e.json"
    empty.write_text("  \n")
    assert io.detect_json_layout(spark, str(arr)) == "array"
    assert sorted(r["x"] for r in io.read_json_records(spark, str(arr), schema="x int").collect()) == [1, 2]
    assert sorted(r["x"] for r in io.read_json_records(spark, str(lines), schema="x int").collect()) == [1, 2]
    assert io.read_json_records(spark, str(empty), schema="x int").count() == 0


def test_flatten_structs(spark):
    df = spark.createDataFrame([("t", (["a"], [1]))], "title string, answers struct<text:array<string>,score:array<int>>")
    assert io.flatten_structs(df).columns == ["title", "answers.text", "answers.score"]


def test_registry_squad_and_socratic(spark):
    from maieutic.operators import tokens as tk

    df = spark.createDataFrame(
        [("a", "What is blue?", "The sky is blue today", (["blue"], [11])),
         ("b", "What?", "The sky is blue today", ([], []))],
        "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>")
    vocab = tk.build_vocab(df.select(tk.word_tokens(F.concat_ws(" ", "question", "context")).alias("tokens")), size=100)
    out = {r["id"]: r for r in registry.preprocess("squad", df, vocab=vocab, max_length=16).collect()}
    # [CLS] what is blue ? [SEP] the sky is blue today [SEP]: context starts at 6, "blue" is context token 3.
    assert (out["a"]["start_positions"], out["a"]["end_positions"]) == (9, 9)
    assert out["b"]["start_positions"] is None and len(out["a"]["input_ids"]) == 16
    d = spark.createDataFrame(
        [(1, (True, False), [("junior_engineer", "hi"), ("robot", "x"), ("senior_engineer", "why?")])],
        "conv_id bigint, policy struct<withhold_final_answer:boolean,avoid_numeric_rules_of_thumb:boolean>, "
        "turns array<struct<role:string,content:string>>")
    long_q = df.limit(1).withColumn("question", F.expr("repeat('why ', 40)"))
    out = registry.preprocess("squad", df.limit(1).unionByName(long_q.withColumn("id", F.lit("z"))), vocab=vocab, max_length=16)
    reasons = {r["id"]: (r["reject_reason"], r["input_ids"] is None) for r in out.collect()}
    assert reasons == {"a": (None, False), "z": (registry.NO_ROOM, True)}
    msgs = registry.preprocess("socratic", d).collect()[0]["messages"]
    assert [m["role"] for m in msgs] == ["system", "user", "assistant"]
    assert msgs[0]["content"].endswith("withhold the final answer.")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    r = e.entry(spark).collect()
    assert len(r) == 1 and r[0]["n_responses"] > 0
    qs, ors = e.queries(), e.oracle_sql()
    assert set(ors) <= set(qs) and len(qs) >= 50
