"""op6, op9, op10 and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maieutic.llm import binary_records, decontaminate, substring_dedup
from maieutic.llm.common import fresh_path


def plain_cut(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (i < len(t) and gone[i]) != (i > 0 and bool(gone[i - 1]))]
        out.append((doc_id, len(t), tuple(zip(edges[0::2], edges[1::2])), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_run_length_matches_random():
    rng = random.Random(2)
    for t in range(300):
        length = rng.choice([2, 3, 4, 5, 8, 9])
        segments = [bytes(rng.choices(b"ab" if t % 2 else b"abcd", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        segments += segments[:1] if t % 3 == 0 else []
        got = Counter()
        for o, a, b in zip(*(x.tolist() for x in substring_dedup.run_length_matches(segments, length))):
            got[o, a, b] += 1
        want = plain_cut([(i, s.decode()) for i, s in enumerate(segments)], length)
        assert got == Counter((i, a, b) for i, _, spans, _ in want for a, b in spans)


@pytest.mark.parametrize("block_runs", [2000, 2])
def test_repeats_random(documents, block_runs):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(30)]
    passages = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(12)]
    rows = [
        (i, " ".join(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 8))))
        for i in range(100)
    ]
    rows += [(200, None), (201, ""), (None, rows[3][1]), (5, rows[5][1]), (202, "a" * 3000), (203, "ab" * 900), (204, "a" * 50)]
    got = substring_dedup.remove_repeats(documents(rows), length=30, gram=8, block_runs=block_runs, block_bytes=3000).collect()
    found = sorted(
        ((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got),
        key=lambda r: (r[0] is None, r[0] or 0, r[1:]),
    )
    assert found == plain_cut(rows, 30)
    assert substring_dedup.remove_repeats(documents([])).count() == 0


def test_long_texts_are_cut_into_pieces(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=4000))
    rows = [(1, base), (2, "x" * 100 + base[500:2500] + "y" * 100), (3, base[3000:])]
    got = substring_dedup.remove_repeats(documents(rows), length=60, gram=16, block_bytes=5000).collect()
    assert sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == plain_cut(rows, 60)


@pytest.fixture
def as_if_large(spark):
    """Small partitions of a shuffle are not put together, small tables not broadcast."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_rows_of_a_very_common_string_stay_dealt_out(documents, as_if_large, monkeypatch):
    tables = {}

    def kept(df, name, write=substring_dedup.written):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(substring_dedup, "written", kept)
    rng = random.Random(11)
    common = "".join(rng.choices("abcdefgh ", k=45))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=40)) + common + "".join(rng.choices("abcdefgh ", k=40))) for i in range(1200)]
    rows += [(1200 + i, rows[i][1][:60]) for i in range(300)] + [(2000, None), (None, common), (3, rows[3][1])]
    got = substring_dedup.remove_repeats(documents(rows, parts=16), length=30, gram=8, block_runs=50).collect()
    found = sorted(
        ((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got),
        key=lambda r: (r[0] is None, r[0] or 0, r[1:]),
    )
    assert found == plain_cut(rows, 30)
    for name in ("sub-shared", "sub-open"):
        hot = tables[name].groupBy("fp").count().orderBy(F.desc("count")).first()
        files = tables[name].where(F.col("fp") == hot["fp"]).groupBy(F.input_file_name()).count().collect()
        assert hot["count"] > 900 and max(r["count"] for r in files) < 0.7 * hot["count"], (name, hot, files)


@pytest.mark.parametrize("hot_keys", [1, 30, 1 << 40])  # no key, some keys, all keys are broadcast
def test_repeats_with_keys_of_many_rows(documents, monkeypatch, hot_keys):
    monkeypatch.setattr(substring_dedup, "HOT_KEYS", hot_keys)
    rng = random.Random(13)
    passages = ["".join(rng.choices("abcd ", k=rng.randint(25, 90))) for _ in range(9)]
    rows = [(i, "".join(rng.choice(passages[: rng.randint(1, 9)]) + "".join(rng.choices("abcd ", k=9)) for _ in range(rng.randint(0, 4)))) for i in range(90)]
    rows += [(200, None), (None, rows[3][1]), (5, rows[5][1]), (202, "a" * 2000), (203, "ab" * 500)]
    got = substring_dedup.remove_repeats(documents(rows), length=30, gram=8, block_runs=5, block_bytes=3000).collect()
    found = sorted(
        ((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got),
        key=lambda r: (r[0] is None, r[0] or 0, r[1:]),
    )
    assert found == plain_cut(rows, 30)


def plain_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, window):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, body in items:
            w = plain_words(body)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                part = w[i : i + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found |= {str(item)} - {"None"}
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("few", [1_000_000, 3])
def test_decontamination_random(spark, documents, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", few)  # beyond it words are counted before they are joined
    rng = random.Random(21)
    vocabulary = ["the", "of", "É", "é", "x1", "B", "c", "dd", "ee", "ff", "gg"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 14)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (None, "the of c"), (53, items[3][1]), (54, "only"), (55, "a a a a a a")]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        if rng.random() < 0.5:
            text += rng.choice([" ", ", ", "\n"]) + (rng.choice(items)[1] or "").upper() + " tail"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "a" * 9000), (103, "only only ONLY"), (3, docs[3][1]), (None, "the of c"), (7, "another text only")]
    docs += [(104, "a " * 500)]
    benchmark = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS words", "2 AS row", "3 AS start")
    got = decontaminate.decontaminate(documents(docs), benchmark, window=6).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    want = plain_hits(docs, items, 6)
    assert found == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in got)
    left = decontaminate.drop_contaminated(documents(docs), benchmark, window=6)
    assert left.columns == documents(docs).columns and left.count() == sum(r[2] == 0 for r in want)
    assert decontaminate.decontaminate(documents([]), benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(documents(docs), benchmark.limit(0)).collect()} == {0}


def test_items_without_id_count_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    item, other = (" ".join(f"{c}{i}" for i in range(12)) for c in "uv")
    benchmark = spark.createDataFrame([(None, item), (7, other)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"{other} z"), (3, f"{item} {other}"), (4, "clean words")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()] == [4]
    got = decontaminate.decontaminate(docs, benchmark, unnamed=True).collect()
    assert sorted((r.doc_id, r.n_hit, r.items, r.n_items, r.contaminated) for r in got) == [
        (1, 12, [], 0, True), (2, 12, ["7"], 1, True), (3, 24, ["7"], 1, True), (4, 0, [], 0, False),
    ]


def test_records_round_trip(spark, documents, vocabulary):
    rng = random.Random(5)
    rows = [(i * 7 % 101, " ".join(rng.choices(["plain", "wörds", "日本", "don't", "x<|endoftext|>"], k=rng.randint(0, 40)))) for i in range(101)]
    rows += [(500, None), (501, ""), (3, "again"), (None, "no id"), (502, "long " * 5000)]
    path = fresh_path(spark, "test-records")
    binary_records.write_records(documents(rows), path, vocabulary, end_id=2, chunk_bytes=700)
    index = binary_records.write_index(spark, path).collect()
    library = Tokenizer.from_file(vocabulary)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, text in ordered:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted(((r.id, r.start, r.n_tokens, r.ids_crc32) for r in index), key=lambda r: r[1])
    assert found == want
    assert len({(r.file, r.offset) for r in index}) == len(rows) and len({r.file for r in index}) > 3
    shuffled = [(r.id, r.ids) for r in binary_records.read_ids(spark, path, seed=4).collect()]
    plain = [(r.id, r.ids) for r in binary_records.read_ids(spark, path).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(shuffled, key=key) == sorted(plain, key=key) and shuffled != plain
    assert shuffled == [(r.id, r.ids) for r in binary_records.read_ids(spark, path, seed=4).collect()]


def test_records_of_one_id_go_to_several_shards(spark, vocabulary):
    """A hundred thousand rows without an id, a third of them one text: no shard gets most of them, and nothing is lost."""
    rows = spark.range(100_000).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('row ', id % 1000) END AS text"
    ).repartition(16)
    path = fresh_path(spark, "test-records")
    binary_records.write_records(rows, path, vocabulary, end_id=2)
    index = binary_records.write_index(spark, path)
    shards = {r["shard"]: r["count"] for r in index.groupBy("shard").count().collect()}
    assert sum(shards.values()) == 100_000 and len(shards) > 4 and max(shards.values()) < 30_000
    same = len(Tokenizer.from_file(vocabulary).encode("the same text", add_special_tokens=False).ids) + 1
    assert index.where(f"n_tokens = {same}").count() >= 33_334
    total = index.selectExpr("sum(n_tokens) AS n", "max(start + n_tokens) AS last", "count(DISTINCT start) AS starts").first()
    assert total["n"] == total["last"] and total["starts"] == 100_000


def test_records_empty_and_damaged(spark, documents, vocabulary):
    path = fresh_path(spark, "test-records")
    binary_records.write_records(documents([]), path, vocabulary)
    assert binary_records.write_index(spark, path).count() == 0
    body = b"MTR1" + bytes(8) + binary_records.frame(4, b"\1\0\2\0", 2) + b"\n"
    assert [(i, ids.tolist()) for _, _, i, ids in binary_records.records(body)] == [(4, [1, 2])]
    for at in range(12, len(body)):
        damaged = body[:at] + bytes([body[at] ^ 1]) + body[at + 1 :]
        with pytest.raises(ValueError):
            list(binary_records.records(damaged))
    for cut in range(1, len(body)):
        with pytest.raises(Exception):
            assert list(binary_records.records(body[:cut]))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    clean = [" ".join(word() for _ in range(60)) for _ in range(30)]
    item = " ".join(word() for _ in range(12))
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t)) for i, t in enumerate(clean)]
    near = clean[4].split()
    near[0] = "changed"
    rows += [(100, clean[4], "en", "a", 1), (101, " ".join(near), "en", "a", 1), (102, clean[5] + " " + item, "en", "b", 1)]
    rows += [(103, "too short", "en", "a", 1), (104, "same " * 80, "en", "a", 1), (105, None, None, None, None), (4, clean[4], "en", "a", rows[4][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [set(range(30)) | {100, 101, 102}, set(range(30)), set(range(30))]  # 102 is near to 5, whose id is smaller
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:3], want):
        docs_out = stage(spark, docs, str(tmp_path))
        assert docs_out.columns == docs.columns
        got = Counter(r.doc_id for r in docs_out.collect())
        assert set(got) == expected
        docs = docs_out
    assert got[4] == 1
    leak = spark.createDataFrame([(7, f"x {item} y", "en", "a", 1), (8, clean[0], "en", "a", 1)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.decontaminated(spark, leak, str(tmp_path)).collect()] == [8]
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    times = Counter(r.doc_id for r in mixed.collect())
    index = corpus_pipeline.records(spark, mixed, str(tmp_path))
    assert Counter(r.doc_id for r in index.collect()) == times
    full = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in full.collect()) == times
    ends = sorted((r.start, r.n_tokens) for r in full.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_pipeline_stages_keep_any_column(spark, tmp_path):
    """Columns called like those that the stages use inside come out as they went in."""
    import corpus_pipeline

    names = ["kept", "verdict", "_verdict", "key", "stays", "row", "row_hit", "row_key", "times", "copy", "__key", "__row", "__times", "__copy",
             "__stays", "__text", "size", "id", "k", "a.b", "Source_Size"]
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)), "en", "s", 1) for i in range(20)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing that occurs anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        found = out.collect()
        assert {r["doc_id"] for r in found} == set(range(20))
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in found for n in names)
