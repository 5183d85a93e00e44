"""op9: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one
window of its own length).  Containment of a window must be exact, so of its
words, ordered by rarity, a necessary prefix of one is enough: any place that
holds the window holds its rarest word.  Rarity is the number of that word in
all documents.  Document words are joined with the rarest words only; a
hit fixes the place where the window would have to start (positional bound), the
document must be long enough from there (length bound), and the words of that
place are then compared one by one.

Of all document words only those that matter leave their task: they are filtered by the 64-bit hashes of the benchmark's
words (of the rarest words for places), which are broadcast up to a counted million, and counted before
they are shuffled.  Beyond that bound words are counted per partition first, and the joins
are left to Spark, which splits a word that many documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import BROADCAST_KEYS, free_name, written
from maieutic.llm.cutting import keyed_texts, row_key
from maieutic.llm.url_rules import ascii_lower

# Fixed value: what separates words (ASCII other than letters and digits).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased (null: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _few(keys: DataFrame) -> bool:
    """Whether a written table of words is small enough to broadcast its 64-bit hashes (8 MB)."""
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str, unnamed: bool) -> DataFrame:
    """``(item, words)``, one row per distinct window of an item; with ``unnamed``, items with a null id have theirs."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where("size(words) > 0" if unnamed else "item IS NOT NULL AND size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words")).distinct()


def _hits(
    docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str, unnamed: bool
) -> tuple[DataFrame, DataFrame]:
    """(rows: id, row, words; found: row, n_hit, items of the rows with a hit)."""
    # A row is found again by id and text, so equal ids with other texts stay apart.
    keyed = keyed_texts(docs, id_col, text_col).select("id", F.col("k").alias("row"), "text")
    split = keyed.select("id", "row", words_of(F.col("text")).alias("words"))
    windows = item_windows(benchmark, window, item_col, item_text_col, unnamed)

    # Number of each benchmark word in the documents; words that no document has are rarest.  Words are counted by hash:
    # two words with one hash share their number, which changes the choice of a rarest word but not what is found.
    bench_words = written(windows.select(F.explode("words").alias("word")).distinct().withColumn("h", F.xxhash64("word")), "decon-words")
    few = _few(bench_words)
    hashes = split.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("h"))
    keys = bench_words.select("h").distinct()
    seen = (
        hashes.join(F.broadcast(keys), "h", "left_semi").groupBy("h").count() if few
        else hashes.groupBy("h").count().join(keys, "h", "left_semi")
    )
    rarity = bench_words.join(seen, "h", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    placed = windows.select("item", "words", F.posexplode("words").alias("at", "word")).join(rarity, "word")
    # A window with a word that no document has cannot occur; of the others keep the rarest word's place.
    prefix = (
        placed.groupBy("item", "words")
        .agg(F.min(F.struct("n", "at", "word")).alias("rarest"))
        .where("rarest.n > 0")
        .select("words", F.col("rarest.at").alias("at"), F.col("rarest.word").alias("word"), "item")
    )
    # A null id is in no set, but its window is a probe all the same.
    probes = prefix.groupBy("word", "at", "words").agg(F.collect_set("item").alias("items"))
    probes = written(probes.withColumn("probe", F.xxhash64("words")), "decon-probes")

    # Candidate places: (row, start) of words that are some window's rarest word.
    rarest = written(probes.select("word", "at", F.size("words").alias("length")).distinct(), "decon-rarest")
    places = split.select("row", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    if few:  # the rarest words are some of the benchmark's words
        hashed = rarest.select(F.xxhash64("word").alias("h")).distinct()
        places = places.withColumn("h", F.xxhash64("word")).join(F.broadcast(hashed), "h", "left_semi").drop("h")
    candidates = places.join(rarest, "word").select(
        "row", (F.col("pos") - F.col("at")).alias("start"), "length", "n", "word", "at"
    ).where("start >= 0 AND start + length <= n")
    per_row = candidates.groupBy("row").agg(F.collect_set(F.struct("start", "length", "word", "at")).alias("places"))

    # Exact comparison: the words at each place, as a key into the windows.  Texts are shuffled as they are and split behind the join:
    # an array of words takes twice their bytes.
    texts = keyed.select("row", "text").join(per_row, "row").dropDuplicates(["row"]).select("row", "places", words_of(F.col("text")).alias("words"))
    at_place = texts.select(
        "row", F.explode(F.transform("places", lambda p: F.struct(
            p["start"].alias("start"), p["at"].alias("at"), F.slice("words", p["start"] + 1, p["length"]).alias("found")
        ))).alias("p")
    ).select("row", "p.start", "p.at", "p.found")
    hits = at_place.join(
        probes, (F.xxhash64(at_place["found"]) == probes["probe"]) & (at_place["found"] == probes["words"]) & (at_place["at"] == probes["at"])
    ).select("row", "start", F.size("found").alias("length"), "items")
    found = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Length of the union of the spans: they come sorted by start.
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["covered"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("covered"),
            F.greatest(acc["end"], s["end"].cast("long")).alias("end"),
        ),
        lambda acc: acc["covered"],
    )
    return split, found.select("row", step.alias("n_hit"), "items")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    unnamed: bool = True,
) -> DataFrame:
    """``(<id_col>, n_words, n_hit, n_items, items, contaminated)``, one row per input row.

    ``n_hit`` counts the words inside any occurrence of any window, ``items``
    are the sorted ids (as strings) of the items with an occurring window.  A
    null or empty text has no words and no hit; an item without words has no
    window; one with a null id counts for ``n_hit`` and ``contaminated`` but not among the items (without ``unnamed`` it counts for
    nothing); equal windows of several items count for each; repeated
    rows each get their row.  Empty documents give an empty table, an
    empty benchmark leaves every row clean.
    """
    split, found = _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col, unnamed)
    return (
        split.select("id", "row", F.size("words").cast("long").alias("n_words"))
        .join(found, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = True
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item (edge cases as in ``decontaminate``)."""
    _, found = _hits(docs, benchmark, window, id_col, text_col, "item_id", "text", unnamed)
    key = row_key(F.col(id_col), F.col(text_col))
    row = free_name(docs.columns, "row_hit")
    found = found.select(F.col("row").alias(row))
    return docs.join(found, key == F.col(row), "left_anti")
