"""Lookups of rows that wait dealt by their id, and the disk that j5_decode_documents takes (round 4, F1)."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maieutic.operators import tokens as tk
from maieutic.plans.catalog import queries
from maieutic.session import scratch_table


def _shuffle_files(spark) -> dict[str, int]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle_")}


def _mb(size: float) -> float:
    return size / 1e6


@pytest.mark.parametrize("hot, warm", [(0, 0), (3, 2), (10_000, 100_000)])
def test_lookups_in_place_equal_the_others(spark, monkeypatch, hot, warm):
    """Unknown, missing and null items, a null id, empty and null arrays; whatever part of the vocabulary the tasks hold."""
    monkeypatch.setattr(tk, "HOT_ENTRIES", hot)
    monkeypatch.setattr(tk, "WARM_ENTRIES", warm)
    rnd = random.Random(7)
    words = ["the", "of", "a", "rare", "word", "x", "y", "z", None, "unknown"]
    lists = [rnd.choices(words, [90, 40, 20, 3, 2, 1, 1, 1, 2, 2], k=rnd.randint(0, 40)) for _ in range(150)]
    rows = spark.createDataFrame([*enumerate(lists), (None, ["x", "the", "z"])], "doc_id long, t array<string>").repartition(3)
    vocab = tk.build_vocab(rows.select(F.expr("filter(t, x -> x <> 'unknown')").alias("tokens")))
    by_token = {r["token"]: r["id"] for r in vocab.collect()}
    ids = {r["doc_id"]: r["ids"] for r in tk.encode(rows, "doc_id", "t", vocab, in_place=True).collect()}
    assert ids == {r["doc_id"]: [by_token.get(t, tk.UNK_ID) for t in r["t"]] for r in rows.collect()}
    assert ids == {r["doc_id"]: r["ids"] for r in tk.encode(rows, "doc_id", "t", vocab).collect()}

    some = vocab.where("id <> 9 AND id <> 14")  # numbers that no entry has, in both parts
    given = [(i, rnd.choices([None, -5, 0, 1, 7, *range(8, 17), 300], k=rnd.randint(0, 30))) for i in range(100)]
    numbers = spark.createDataFrame([*given, (200, None), (None, [8, 9, 10])], "doc_id long, ids array<int>")
    by_id = {r["id"]: r["token"] for r in some.collect() if r["id"] is not None}
    for skip in (True, False):
        text = {r["doc_id"]: r["text"] for r in tk.decode(numbers, "doc_id", "ids", some, skip_special=skip, in_place=True).collect()}
        assert text == {r["doc_id"]: r["text"] for r in tk.decode(numbers, "doc_id", "ids", some, skip_special=skip).collect()}
        assert text[None] == " ".join(by_id.get(x, tk.UNK) for x in (8, 9, 10) if x in by_id or not skip)

    for twice in (rows.union(rows.where("doc_id = 5")), rows.union(rows.where("doc_id IS NULL"))):
        with pytest.raises(Exception, match="two rows share one id"):
            tk.encode(twice, "doc_id", "t", vocab, in_place=True).collect()
    with pytest.raises(Exception, match="two rows share one id"):
        tk.decode(numbers.union(numbers.where("doc_id = 5")), "doc_id", "ids", some, in_place=True).collect()


def test_batches_are_cut_for_the_lookup(spark):
    """A batch of more items than a slice, and a row that is longer than one, come out whole."""
    lists = pa.array([[1] * 30, None, [2] * (tk.SLICE_CHARS - 10), [3] * (2 * tk.SLICE_CHARS), [], [4]])
    cut = list(tk._list_slices(iter([lists])))
    assert len(cut) == 4 and pa.concat_arrays(cut).equals(lists)
    words = [f"w{i}" for i in range(500)]
    vocab = tk.build_vocab(spark.createDataFrame([(words,)], "tokens array<string>"))
    rows = spark.range(2_500).coalesce(1).select("id", F.expr("transform(sequence(1, 500 + id % 2), i -> 'w' || (i * id % 501))").alias("t"))
    ids = tk.encode(rows, "id", "t", vocab, in_place=True)
    wide = tk.decode(ids.coalesce(1), "id", "ids", vocab, in_place=True).join(rows, "id")
    known = F.array_join(F.filter("t", lambda x: x != "w500"), " ")
    assert wide.where(F.col("text") == known).count() == wide.count() == 2_500


@pytest.mark.parametrize("files", [1, 40])
def test_decoding_documents_takes_disk_for_one_exchange_of_the_ids(spark, monkeypatch, tmp_path, files):
    """Ids are not carried through the joins, and no known token travels: the shuffles took eight to ten times the input before."""
    monkeypatch.setattr(tk, "HOT_ENTRIES", 100)
    monkeypatch.setattr(tk, "WARM_ENTRIES", 4_000)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 8)))
    words = [word() for _ in range(20_000)]
    weights = [1 / (i + 3) for i in range(len(words))]
    texts = [" ".join(rnd.choices(words, weights, k=600)).capitalize() + "." for _ in range(2_000)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))

    before = _shuffle_files(spark)
    out = queries()["j5_decode_documents"](spark, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {i: " ".join(re.findall(r"\w+|[^\w\s]", (t or "").lower())) for i, t in enumerate(texts)}
    # One exchange of the texts if few files come, one of the ids, and the items behind the held entries four times.
    most, end = 3.5 * size, time.time() + 20
    while (held := sum(n for f, n in _shuffle_files(spark).items() if f not in before)) > most and time.time() < end:
        time.sleep(0.5)  # what the vocabulary shuffled goes in the background
    assert held <= most, f"{_mb(held):.1f} MB of shuffle files for {_mb(size):.1f} MB of documents"


def test_shuffle_files_of_a_written_table_can_go_at_once(spark):
    df = spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.sum("id").alias("s"))
    before = set(_shuffle_files(spark))
    kept = scratch_table(df, "kept")
    new = set(_shuffle_files(spark)) - before
    assert new
    gone = scratch_table(df, "gone", drop_shuffles=True)
    end = time.time() + 20
    while (left := set(_shuffle_files(spark)) - before - new) and time.time() < end:
        time.sleep(0.2)
    assert not left and sorted(kept.collect()) == sorted(gone.collect()) == sorted(df.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
