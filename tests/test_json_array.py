"""JSON arrays by byte ranges (S3, S4) against Python's parser and Spark's whole-file reader."""

import contextlib
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from maieutic.sources import io, json_array


@contextlib.contextmanager
def ranges_of(spark, n_bytes):
    """Byte ranges of about this many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(n_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


STRINGS = ['a, b', '"', '\\', '\\"', '],[', '{"x": [1, 2]}', 'é – 😀, "', "", "\\\\", "line\nfeed", "x" * 90, ",", "[", "}", " ,", '","']


def value(rnd, depth=0):
    kind = rnd.random()
    if depth > 2 or kind < 0.45:
        return rnd.choice(STRINGS)
    if kind < 0.6:
        return rnd.choice([1, -2.5, True, None, 10**12])
    if kind < 0.8:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["a", "b,", 'c"', "d]"]): value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}


def elements_of(spark, path):
    return [json.loads(r["element"]) for r in json_array.array_elements(spark, str(path))[0].orderBy("file", "at").collect()]


@pytest.mark.parametrize("size", [7, 64, 700])
def test_elements_equal_pythons(spark, tmp_path, size):
    rnd = random.Random(size)
    files = []
    for i in range(12):
        items = [value(rnd) for _ in range(rnd.randint(0, 30))]
        layout = rnd.choice([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
        lead, tail = rnd.choice([("", ""), ("\n  ", " \n\n")])
        (tmp_path / f"{i:02}.json").write_text(lead + json.dumps(items, **layout) + tail, encoding="utf-8")
        files.append(items)
    with ranges_of(spark, size):
        found, listed = json_array.array_elements(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 1
        got = [json.loads(r["element"]) for r in found.orderBy("file", "at").collect()]
        assert got == [x for items in files for x in items]
        assert all(r["ok"] for r in listed.collect())


def test_rows_equal_the_whole_file_reader(spark, tmp_path):
    rnd = random.Random(3)
    rows = [{"id": i, "text": rnd.choice(STRINGS), "score": rnd.choice([None, 1.5, 2.25]), "tags": [rnd.choice(STRINGS) for _ in range(i % 3)],
             "meta": {"lang": "en", "n": i * 10**9, "none": None}} for i in range(300)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, indent=1), encoding="utf-8")
    want = spark.read.option("multiLine", True).json(str(path))
    with ranges_of(spark, 500):
        inferred = io.read_json_records(spark, str(path))
        given = io.read_json_records(spark, str(path), "array", want.schema)
        assert dict(inferred.dtypes) == dict(want.dtypes) and given.schema == want.schema
        key = lambda r: r["id"]
        expected = sorted(want.collect(), key=key)
        assert sorted(given.collect(), key=key) == expected
        assert sorted(inferred.select(*want.columns).collect(), key=key) == expected


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    """One file of 24 MB in one line: as many ranges as its size gives, equal counts and sums."""
    path = tmp_path / "large.json"
    item = '{"id": %d, "text": "say \\"%s\\", [then] {leave}"}'
    with open(path, "w") as f:
        f.write("[" + ",".join(item % (i, "x, " * 60) for i in range(110_000)) + "]")
    with ranges_of(spark, 2 << 20):
        rows = io.read_json_records(spark, str(path), "auto", "id bigint, text string")
        states = json_array.range_states(spark, str(path)).collect()
        assert len(states) >= 12 and sum(not r["outside"] for r in states) > 0
        got = rows.agg(F.count("id"), F.sum("id"), F.min(F.length("text")), F.max(F.length("text"))).first()
    assert tuple(got) == (110_000, 110_000 * 109_999 // 2, 202, 202)


def test_empty_broken_and_other_files(spark, tmp_path):
    texts = {"a": "[ ]", "b": "[]", "c": " \n", "d": '["open', "e": '["x", 1}', "f": '{"a": [1, 2]}', "g": "[[1, 2], [3]]", "h": '["]"]', "i": "[1, ]",
             "j": "[1]]", "k": "﻿[7]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    for size in (3, 1 << 20):
        with ranges_of(spark, size):
            found, listed = json_array.array_elements(spark, str(tmp_path))
            files = {r["path"][-6:-5]: (r["file"], r["mark"], r["ok"]) for r in listed.collect()}
            got = {}
            for r in found.orderBy("file", "at").collect():
                got.setdefault(r["file"], []).append(r["element"])
        by_name = {n: got.get(f, []) for n, (f, _, _) in files.items()}
        # A file without any character has no row in a text reader.
        assert {n: ok for n, (_, _, ok) in files.items()} == {n: n not in "cdfj" for n in files} and set(texts) - set(files) <= {"c"}
        assert by_name == {n: {"e": ['"x"', "1}"], "g": ["[1, 2]", "[3]"], "h": ['"]"'], "i": ["1", ""], "k": ["7"]}.get(n, []) for n in files}
    with pytest.raises(io.InputError):
        io.read_json_records(spark, str(tmp_path / "d.json"), "array", "a int")


def test_marks_and_layouts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text(" " * 20_000 + "\n[1]")
    (tmp_path / "x" / "b.json.gz").write_bytes(gzip.compress(b'\n\t[{"x": 2}]'))
    assert sorted(json_array.first_marks(spark, str(tmp_path / "x"), block=64).values()) == ["[", "["]
    assert io.detect_json_layout(spark, str(tmp_path / "x")) == "array"
    assert sorted(elements_of(spark, tmp_path / "x"), key=str) == [1, {"x": 2}]
    (tmp_path / "x" / "c.json").write_text('{"x": 1}\n')
    assert io.detect_json_layout(spark, str(tmp_path / "x")) == "mixed"
    with pytest.raises(io.InputError):
        io.read_json_records(spark, str(tmp_path / "x"))


def test_prompts_of_an_array_in_ranges(spark, tmp_path):
    items = [" a, b ", {"prompt": "", "question": " q"}, {"prompt": 5}, {"prompt": 0, "question": 2.5}, {"prompt": False, "question": True},
             {"prompt": ["x"]}, {"answer": 1}, 7, None, {"prompt": "  "}]
    (tmp_path / "p.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "q.json").write_text('["last", nonsense]')
    (tmp_path / "r.json").write_text('"text"')
    (tmp_path / "s.json").write_text('["cut')
    (tmp_path / "t.json").write_text("nonsense")
    with ranges_of(spark, 20):
        good, rejects = io.read_prompts(spark, str(tmp_path), "json", strict=False)
        assert [r["prompt"] for r in good.orderBy("prompt_id").collect()] == ["a, b", "q", "5", "2.5", "True", "", "last"]
        reasons = [r["reason"] for r in rejects.orderBy("prompt_id").collect()]
    assert reasons == [io.NO_FIELD, io.NO_FIELD, io.WRONG_TYPE, io.WRONG_TYPE, io.BAD_JSON, io.NOT_A_LIST, io.BAD_JSON, io.BAD_JSON]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "v.json").write_text(json.dumps(["one"]))
    assert [r["prompt"] for r in io.read_prompts(spark, str(tmp_path / "u" / "v.json")).collect()] == ["one"]


def test_array_query_writes_few_files(spark, tmp_path, monkeypatch):
    """Files follow the number of rows, not of conversations, and every row comes back (F8)."""
    from maieutic.plans import q_io

    rows = [(i, t, "user", f'a, "b" [{i}]' if i % 3 else None) for i in range(300) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(q_io, "ARRAY_ROWS", 100)
    out = q_io.q_json_array(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
    monkeypatch.setattr(q_io, "scratch_path", lambda spark, name: str(tmp_path / name))
    q_io.q_json_array(spark, str(tmp_path))
    assert 6 <= len(list((tmp_path / "conversations-json").glob("part-*"))) <= 40
