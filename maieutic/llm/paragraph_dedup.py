"""op5: near-duplicate paragraphs by MinHash banding.

Two cuts of a text into units are offered.  With ``joined`` (the query) the units
together hold every word: they are cut where a place is the best within
``min_words`` words to either side, line feeds before sentence ends before other
words, ties by a hash of the words there (``find_passages``).  So short sentences and
lines are joined, long stretches without an end mark are cut, and copies are cut
alike wherever they lie.  Without it a unit is a paragraph, a run of words up to a line feed or to
a word that ends in ``.``, ``!`` or ``?``, and shorter ones are left alone.

Units of at least ``min_words`` words are
sketched by the least hashes of their word shingles; the number of bands is
tuned to find a pair at the threshold with the wanted recall.  Equal units
become one class first; classes that share a band are linked through hubs and
tiles with exact Jaccard on the full shingle sets (``linking``), clustered by
components, and of each cluster only the first occurrence, by document id and place, stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import BROADCAST_KEYS, text_slices, written
from maieutic.llm.components import components
from maieutic.llm.cutting import bodies_of, classes_of, cut_repeats, keyed_texts
from maieutic.llm.linking import Jaccard, link_buckets
from maieutic.llm.near_dup import multipliers
from maieutic.llm.shingles import Words, find_words, mix, shingle_hashes

SLICE_BYTES = 1 << 20
TAG_BYTES = 5  # of a unit's hash, by which the members of a bucket are told apart
_TAG = np.uint64((1 << 8 * TAG_BYTES) - 1)
PAIRS_HELD = 1 << 21  # pairs of a task before they are sorted and sent, and units it remembers
KNOWN_UNITS = 1 << 19
PARTS = 16  # key ranges a shuffle partition has; a task sorts one at a time
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def tune_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` bands that finds a pair at the threshold
    with probability ``recall`` or more."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {most} bands has recall {recall} at {threshold}")
    return best


def find_paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word count, text number) of each paragraph of a batch."""
    n = len(words.starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    feeds = np.cumsum(words.data == ord("\n"))
    closes = _ENDS[words.data[words.ends - 1]]
    closes[:-1] |= feeds[words.starts[1:]] != feeds[words.ends[:-1] - 1]  # texts are a line feed apart, too
    first = np.concatenate([[0], np.flatnonzero(closes[:-1]) + 1])
    count = np.diff(np.append(first, n))
    text = np.searchsorted(words.offsets, words.starts[first], "right") - 1
    return first, count, text


def find_passages(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word count, text number) of units that together hold every word of a batch.

    A unit has ``min_words`` words or more, unless its whole text has fewer, and less than four times as many.
    """
    n = len(words.starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    never = np.uint64(2**64 - 1)
    feeds = np.cumsum(words.data == ord("\n"))
    rank = np.where(_ENDS[words.data[words.ends - 1]], 1, 2).astype(np.uint64)
    rank[:-1][feeds[words.starts[1:]] != feeds[words.ends[:-1] - 1]] = 0
    here = mix(np.roll(words.hashes, 1) * np.uint64(0x9E3779B97F4A7C15) + words.hashes)
    key = (rank << np.uint64(62)) | (here >> np.uint64(2))
    # A cut leaves min_words words at least to its text's ends, so texts that lie next to it do not matter.
    starts = np.cumsum(words.counts) - words.counts
    upto = np.arange(1, n + 1) - np.repeat(starts, words.counts)
    key[(upto < min_words) | (np.repeat(words.counts, words.counts) - upto < min_words)] = never
    reach = min_words - 1
    around = np.concatenate([np.full(reach, never), key, np.full(reach, never)])
    cut = key < never
    for d in range(1, min_words):
        cut &= (key < around[reach - d : reach - d + n]) & (key <= around[reach + d : reach + d + n])
    first = np.union1d(starts[words.counts > 0], np.flatnonzero(cut) + 1)
    count = np.diff(np.append(first, n))
    # Words that repeat have no best place: what is still long is cut evenly.
    parts = np.where(count >= 4 * min_words, count // (2 * min_words), 1)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + nth * 2 * min_words
    count = np.diff(np.append(first, n))
    return first, count, np.searchsorted(words.offsets, words.starts[first], "right") - 1


def _wide_hash(words: Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each paragraph's word sequence."""
    place = np.arange(len(words.hashes)) - np.repeat(first, count)
    spread = mix(words.hashes + mix(place.astype(np.uint64) + np.uint64(1)))
    again = mix(words.hashes ^ mix(place.astype(np.uint64) + np.uint64(0x51ED270B)))
    return np.add.reduceat(spread, first), np.add.reduceat(again * np.uint64(0x9FB21C651E98DF25), first)


def _chosen(words: Words, min_words: int, joined: bool):
    """The units that are compared: (first, count, text, c1, c2)."""
    first, count, text = find_passages(words, min_words) if joined else find_paragraphs(words)
    if not len(first):
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    c1, c2 = _wide_hash(words, first, count)
    keep = count >= (1 if joined else min_words)
    return first[keep], count[keep], text[keep], c1[keep], c2[keep]


def _band_keys(hashes: np.ndarray, first: np.ndarray, per: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (a row each) of units whose ``per`` shingles begin at word ``first``."""
    edges = np.cumsum(per) - per
    at = np.repeat(first - edges, per) + np.arange(per.sum())
    least = np.stack([np.minimum.reduceat(hashes[at] * m, edges) for m in multipliers(bands * rows)], 1)
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + least[:, b * rows + r])
        keys[:, b] = acc
    return keys


_UNIT = "k binary, id bigint, start bigint, stop bigint, c1 bigint, c2 bigint"


def _unit_rows(min_words: int, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                words = find_words(texts)
                first, count, text, c1, c2 = _chosen(words, min_words, joined)
                if not len(first):
                    continue
                base = words.offsets[text]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                after = np.append(words.starts, len(words.data))[first + count]  # the blanks behind go along
                yield pa.record_batch(
                    [part.column("k").take(pa.array(text)), part.column("id").take(pa.array(text)),
                     pa.array(words.starts[first] - base), pa.array(np.minimum(after - base, sizes[text])),
                     pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))],
                    names=["k", "id", "start", "stop", "c1", "c2"],
                )

    return run


def _distinct_pairs(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((tags, keys))
    keys, tags = keys[order], tags[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])
    return keys[fresh], tags[fresh]


def _band_pairs(shingle: int, min_words: int, bands: int, rows: int, joined: bool, parts: int):
    """``(part, keys, tags)``: the distinct pairs of a band key and a unit's tag, packed per range of keys.

    A task makes keys once for equal units (while it remembers them), and a pair takes ``8 + TAG_BYTES`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.zeros(0, np.uint64)

        def packed() -> pa.RecordBatch:
            keys, tags = _distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascends with the key
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            short = np.ascontiguousarray(tags.view(np.uint8).reshape(-1, 8)[:, :TAG_BYTES])
            there = np.flatnonzero(np.diff(edges))
            a, b = edges[there].tolist(), edges[there + 1].tolist()
            return pa.record_batch(
                [pa.array(there.astype(np.int32)), pa.array([keys[x:y].tobytes() for x, y in zip(a, b)], pa.binary()),
                 pa.array([short[x:y].tobytes() for x, y in zip(a, b)], pa.binary())], names=["part", "keys", "tags"],
            )

        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE_BYTES):
                words = find_words(texts)
                first, count, _, c1, _ = _chosen(words, min_words, joined)
                # A shorter unit is a whole text, which only equal ones repeat.
                long = np.flatnonzero(count >= min_words)
                if not len(long):
                    continue
                fresh, at = np.unique(c1[long], return_index=True)
                new = ~np.isin(fresh, known, assume_unique=True)
                long = long[at[new]]
                if not len(long):
                    continue
                known = np.concatenate([known if len(known) < KNOWN_UNITS else known[:0], fresh[new]])
                keys = _band_keys(shingle_hashes(words.hashes, shingle), first[long], count[long] - shingle + 1, bands, rows)
                held.append((keys.ravel(), np.repeat(c1[long] & _TAG, bands)))
                if sum(len(k) for k, _ in held) > PAIRS_HELD:
                    yield packed()
        if held:
            yield packed()

    return run


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, tag, size)`` of the keys that several tags have; rows of one part lie together."""

    def settled(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(k for k, _ in parts), np.uint64)
        tags = np.zeros((len(keys), 8), np.uint8)
        tags[:, :TAG_BYTES] = np.frombuffer(b"".join(t for _, t in parts), np.uint8).reshape(-1, TAG_BYTES)
        keys, tags = _distinct_pairs(keys, tags.view(np.uint64).ravel())
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        size = np.diff(np.append(first, len(keys)))
        several = np.repeat(size > 1, size)
        return pa.record_batch(
            [pa.array(keys[several].view(np.int64)), pa.array(tags[several].view(np.int64)), pa.array(np.repeat(size, size)[several])],
            names=["key", "tag", "size"],
        )

    now, parts = None, []
    for batch in batches:
        for part, keys, tags in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if part != now and parts:
                yield settled(parts)
                parts = []
            now = part
            parts.append((keys, tags))
    if parts:
        yield settled(parts)


def _unit_sets(shingle: int):
    """Shingle sets of given paragraphs (start, stop) of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies in text_slices(batch, "body", SLICE_BYTES):
                words = find_words(bodies)
                hashes = shingle_hashes(words.hashes, shingle)
                first = np.concatenate([[0], np.cumsum(words.counts)])
                sets = [np.unique(hashes[a : a + n - shingle + 1]).view(np.int64) for a, n in zip(first.tolist(), words.counts.tolist())]
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.record_batch(
                    [part.column("cls"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets)))],
                    names=["cls", "n", "payload"],
                )

    return run


def remove_paragraphs(
    docs: DataFrame,
    shingle: int = 5,
    threshold_pct: int = 80,
    min_words: int = 10,
    recall: float = 0.99,
    most_bands: int = 4,
    joined: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, removed_bytes, kept, first_ids)``, one row per input row.

    ``kept`` is the UTF-8 of the text without the removed paragraphs and the blanks behind them, ``n_removed`` their
    number, ``first_ids`` the sorted ids of the documents that hold the occurrences that stay in their place (the document itself where
    it repeats itself).  With ``joined`` every word is in a unit (a text below ``min_words`` words is one that only an
    equal text repeats); without, paragraphs below ``min_words`` words are kept as they are.  A null or empty text has none.
    Rows that repeat both id and text are one document and get the same result; a null id comes after all others
    when the first occurrence is chosen.  An empty table gives an empty table.
    """
    bands, rows = tune_bands(threshold_pct / 100, recall, most_bands)
    keyed = keyed_texts(docs, id_col, text_col)
    texts = keyed.select("k", F.col("id").cast("bigint").alias("id"), "text")
    units = written(texts.mapInArrow(_unit_rows(min_words, joined), _UNIT), "para-units")

    # Buckets with at least two different units, by tag.  Units that share a tag by chance make a bucket larger, which
    # verification undoes; two of one bucket that do (1 pair in 2**40) count as one.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keyed.select("text").mapInArrow(
        _band_pairs(shingle, min_words, bands, rows, joined, n * PARTS), "part int, keys binary, tags binary"
    )
    pairs = pairs.repartition(n, "part").sortWithinPartitions("part")
    shared = written(pairs.mapInArrow(_shared_pairs, "key bigint, tag bigint, size bigint"), "para-shared")
    tags = written(shared.select("tag").distinct().withColumn("banded", F.lit(True)), "para-tags")
    few = tags.count() <= BROADCAST_KEYS

    # Classes that repeat or share a bucket; the full sets of the latter, each from one occurrence.
    cls = F.unhex(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")))
    classes = classes_of(units).withColumn("tag", F.col("c1").bitwiseAND(F.lit(int(_TAG))))
    classes = classes.join(F.broadcast(tags) if few else tags, "tag", "left").where("seen > 1 OR banded").withColumn("cls", cls)
    classes = written(classes, "para-classes")
    members = shared.join(classes.where("banded").select("tag", "cls"), "tag").select("key", "cls", "size")
    bodies = bodies_of(keyed, classes.where("banded"))
    sets = written(bodies.mapInArrow(_unit_sets(shingle), "cls binary, n bigint, payload array<bigint>"), "para-sets")
    labels = components(link_buckets(members, ["key"], sets, Jaccard(threshold_pct)))
    return cut_repeats(keyed, units, classes, labels).withColumnRenamed("id", id_col)
