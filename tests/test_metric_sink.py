"""The exactly-once metric log (X5, S6), bounded rank summaries on a stream (A8), heavy hitters."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from maieutic.operators import behavior
from maieutic.operators import tokens as tk
from maieutic.streaming import metric_sink, step_metrics

SCHEMA = "run_id string, step int, prompt_id int, response_id int, text string"


def _parts():
    texts = ["Use 5 V.", "Why? What now?", "Set it to 3 mA.", "How would you check it?", "x"]
    rows = [(f"r{i % 2}", (i // 4) * 50, i, i, texts[i % 5]) for i in range(60)]
    # Later parts bring more rows of earlier steps, so their metrics change.
    return [rows[0::3], rows[1::3], rows[2::3]]


def _put(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def _run(spark, src, log, state, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = step_metrics.start_metric_log_stream(stream, 50, log, state, trigger_once=True, **options)
    assert q.awaitTermination(240)


def _rows(df):
    return sorted((r["run_id"], r["step"], r["metric"], r["value"]) for r in df.collect())


def _want(spark, rows):
    return _rows(step_metrics.prefixed_metric_rows(step_metrics.step_metrics(spark.createDataFrame(rows, SCHEMA), 50)))


def test_replayed_batches_leave_the_same_table(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    parts = _parts()
    for part in parts:
        _put(spark, src, part)
    _run(spark, src, log, state)
    want = _want(spark, [r for p in parts for r in p])
    assert _rows(metric_sink.read_metric_log(spark, log)) == want
    commits = sorted(os.listdir(f"{log}/commits"))
    files = sorted(f for f in os.listdir(f"{log}/rows") if f.endswith(".parquet"))
    listed = sorted(f for c in commits if c.endswith(".json") for f in json.load(open(f"{log}/commits/{c}"))["files"])
    assert len([c for c in commits if c.endswith(".json")]) == 3 and listed == files
    # Spark forgets that it finished the last batch, as after a crash right behind the sink's commit, and runs it again.
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            shutil.move(f"{state}/commits/{name}", str(tmp_path / f"gone{name}"))
    _run(spark, src, log, state)
    assert _rows(metric_sink.read_metric_log(spark, log)) == want
    assert sorted(f for f in os.listdir(f"{log}/rows") if f.endswith(".parquet")) == files


def test_an_aborted_batch_leaves_the_same_table(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    parts = _parts()
    _put(spark, src, parts[0])
    _run(spark, src, log, state)
    before = _rows(metric_sink.read_metric_log(spark, log))
    files = sorted(os.listdir(f"{log}/rows"))
    _put(spark, src, parts[1])
    # The driver cannot commit: what tasks have written of the batch is taken back.
    metric_sink.register(spark)
    broken = f"{log}/commits"
    os.rename(broken, f"{log}/aside")
    open(broken, "w").close()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = step_metrics.start_metric_log_stream(stream, 50, log, state, trigger_once=True)
    with pytest.raises(Exception):
        q.awaitTermination(240)
    os.rename(broken, f"{log}/blocked")
    os.rename(f"{log}/aside", broken)
    assert sorted(os.listdir(f"{log}/rows")) == files
    assert _rows(metric_sink.read_metric_log(spark, log)) == before
    _run(spark, src, log, state)
    assert _rows(metric_sink.read_metric_log(spark, log)) == _want(spark, parts[0] + parts[1])


def test_writer_commits_once_and_takes_back(tmp_path):
    import pyarrow as pa

    writer = metric_sink.MetricLogWriter(str(tmp_path))
    batch = lambda v: iter([pa.record_batch([pa.array([v])], names=["v"])])
    first, again, lost = writer.write(batch(1)), writer.write(batch(1)), writer.write(batch(2))
    nothing = writer.write(iter([]))
    writer.commit([first, nothing, None], 7)
    writer.commit([again], 7)
    writer.abort([lost, None], 8)
    assert [f for f in os.listdir(tmp_path / "rows")] == [first.file]
    assert json.load(open(tmp_path / "commits" / f"{7:020}.json")) == {"batch": 7, "files": [first.file]}


def test_a_stream_in_append_mode_writes_directly(spark, tmp_path):
    src, log = str(tmp_path / "src"), str(tmp_path / "log")
    rows = [("r", 1, "custom/a", 0.5), ("r", 1, "custom/b", 1.5), ("s", 2, "custom/a", 2.5)]
    schema = "run_id string, step int, metric string, value double"
    for part in (rows[:2], rows[2:], [("r", 1, "custom/a", 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    metric_sink.register(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream.writeStream.format(metric_sink.FORMAT).option("path", log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert _rows(metric_sink.read_metric_log(spark, log)) == [("r", 1, "custom/a", 9.0), ("r", 1, "custom/b", 1.5), ("s", 2, "custom/a", 2.5)]


# --- A8 --------------------------------------------------------------------------------------
def test_rank_summary_is_near_and_bounded(spark):
    rnd = random.Random(1)
    values = {g: [int(rnd.paretovariate(0.7) * 10) for _ in range(n)] for g, n in (("a", 40_000), ("b", 900), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, n_tokens long").repartition(6)
    size = F.length(F.kll_sketch_agg_bigint("n_tokens", F.lit(behavior.SKETCH_SIZE)))
    got = {r["g"]: r for r in df.groupBy("g").agg(behavior.p95_length("sketch").alias("p"), behavior.p95_length().alias("e"), size.alias("s")).collect()}
    for g, vs in values.items():
        below = sum(v < got[g]["p"] for v in vs) / len(vs)
        upto = sum(v <= got[g]["p"] for v in vs) / len(vs)
        assert below - 0.005 <= 0.95 <= upto + 0.005 and got[g]["s"] < 40_000
    assert got["b"]["p"] == got["b"]["e"] and got["c"]["p"] == got["c"]["e"]
    with pytest.raises(ValueError):
        behavior.p95_length("other")


def test_rank_summary_on_a_stream_equals_the_batch(spark, tmp_path):
    src, log, state = (str(tmp_path / n) for n in ("src", "log", "state"))
    parts = _parts()
    for part in parts:
        _put(spark, src, part)
    _run(spark, src, log, state, percentile="sketch")
    assert _rows(metric_sink.read_metric_log(spark, log)) == _want(spark, [r for p in parts for r in p])


# --- J6 --------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [4, 40, 10_000])
def test_top_vocabulary_equals_the_full_count(spark, capacity, monkeypatch):
    rnd = random.Random(2)
    lists = [[f"w{int(rnd.paretovariate(0.8))}" for _ in range(rnd.randint(0, 60))] for _ in range(400)] + [[], None]
    df = spark.createDataFrame([(x,) for x in lists], "tokens array<string>").repartition(7)
    full = {r["token"]: r["id"] for r in tk.build_vocab(df).collect()}
    plain = tk.frequent_tokens
    monkeypatch.setattr(tk, "frequent_tokens", lambda d, size, col: plain(d, size, col, capacity))
    for size in (1, 5, 30, 100_000):
        got = {r["token"]: r["id"] for r in tk.build_vocab(df, size=size).collect()}
        assert got == {t: i for t, i in full.items() if i < size + len(tk.SPECIAL_TOKENS)}
