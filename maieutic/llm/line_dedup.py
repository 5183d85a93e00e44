"""op3: near-duplicate lines by a segment-partition edit join.

Two lines are linked if their edit distance (over UTF-8 bytes) is at most
``max_edits``.  A line of length L is cut into ``max_edits + 1`` segments; of two
linked lines the shorter one has a segment that the longer one holds unchanged, at a
place that differs from the segment's by no more than the edits before and after it
allow.  So each line is entered by its own segments, and probes, for each shorter length
within reach, the few substrings of itself that could be such a segment (12 keys a line for 2 edits).

Equal lines are one class first; a line below ``min_bytes`` bytes has no other links.  Lines that share a key are a bucket, and are
linked through hubs and tiles (``linking``) after verification by a bit-parallel
edit distance over a diagonal band.  Of each component only the first
occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, with_keys, written
from maieutic.llm.components import components
from maieutic.llm.cutting import bodies_of, classes_of, cut_repeats, keyed_texts
from maieutic.llm.linking import link_buckets
from maieutic.llm.shingles import mix, power_tables, running_sums

SLICE_BYTES = 1 << 20


def within_edits(a: bytes, b: bytes, k: int) -> bool:
    """Whether the edit distance is at most ``k``.

    Common ends are taken off; on the rest, bit vectors of vertical differences advance one row per byte of
    the shorter string over the band of ``2 * k + 1`` diagonals that a path of at most ``k`` edits can use.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    start, end = 0, min(len(a), len(b))
    while start < end:  # longest common prefix by halving
        middle = (start + end + 1) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            end = middle - 1
    a, b = a[start:], b[start:]
    start, end = 0, min(len(a), len(b))
    while start < end:  # longest common suffix
        middle = (start + end + 1) // 2
        if a[len(a) - middle : len(a) - start] == b[len(b) - middle : len(b) - start]:
            start = middle
        else:
            end = middle - 1
    a, b = a[: len(a) - start], b[: len(b) - start]
    if len(a) < len(b):
        a, b = b, a
    if not b or k == 0:
        return len(a) <= k
    # reach[e]: bit d is set if, with e edits, the diagonal d - k is reached at the current row of b.  The
    # vectors of all error levels move together; the band is what keeps them 2k + 1 bits wide.
    width = 2 * k + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << (i + k))  # shifted so that row i's band starts at bit i
    # At row 0 the diagonal d (0 <= d <= e) is reached by deleting d bytes of a.
    reach = [sum(1 << (k + d) for d in range(e + 1)) for e in range(k + 1)]
    for i, c in enumerate(b):
        match = (places.get(c, 0) >> i) & full
        before = None
        fresh = []
        for e in range(k + 1):
            now = reach[e] & match
            if e:
                # substitution keeps the diagonal, insertion of b's byte moves one down, deletion of a's one up
                now |= reach[e - 1] | (reach[e - 1] >> 1) | (before << 1)
            before = now & full
            fresh.append(before)
        reach = fresh
        if not reach[k]:
            return False
    return bool(reach[k] >> (len(a) - len(b) + k) & 1)


class EditDistance:
    """Lines (UTF-8) within ``max_edits`` edits."""

    def __init__(self, max_edits: int):
        self.max_edits = max_edits

    def verified(self, pairs: DataFrame) -> DataFrame:
        k = self.max_edits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                linked = [within_edits(a, b, k) for a, b in zip(*(batch.column(c).to_pylist() for c in ("payload", "hub_payload")))]
                yield pa.record_batch([batch.column("cls"), batch.column("hub"), pa.array(linked, pa.bool_())], names=["cls", "hub", "linked"])

        return pairs.select("cls", "hub", "payload", "hub_payload").mapInArrow(run, "cls binary, hub binary, linked boolean")

    def near_sizes(self, sizes: np.ndarray, n: float) -> np.ndarray:
        return np.abs(sizes - n) <= self.max_edits

    def load(self, value) -> bytes:
        return value.as_py()

    def linked(self, a: bytes, b: bytes) -> bool:
        return within_edits(a, b, self.max_edits)


def segment_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Keys of each line (one row per line): its own segments and the probes into lines up to ``k`` bytes shorter.

    A key hashes the segment's bytes, its number and the length it belongs to.
    """
    sums = running_sums(data)
    _, down = power_tables(len(data))
    keys = []
    for shorter in range(k + 1):
        target = lengths - shorter
        base, over = target // (k + 1), target % (k + 1)
        for i in range(k + 1):
            at = i * base + np.maximum(0, i - (k + 1 - over))
            size = base + (i >= k + 1 - over)
            low, high = max(-i, shorter - (k - i)), min(i, shorter + (k - i))
            for shift in range(low, high + 1):
                a = starts + at + shift
                inside = (at + shift >= 0) & (at + shift + size <= lengths)
                a = np.where(inside, a, starts)
                h = mix((sums[a + size] - sums[a]) * down[a]) + mix((target * (k + 1) + i).astype(np.uint64))
                # A probe that does not fit stands for the line's first segment again, which it has anyway.
                keys.append(mix(h) if inside.all() else np.where(inside, mix(h), keys[0]))
    return np.stack(keys, 1)


_UNIT = "k binary, id bigint, start bigint, stop bigint, c1 bigint, c2 bigint, band_keys array<bigint>"


def _unit_rows(max_edits: int, min_bytes: int, exact_below: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                owner, start, stop, lines = [], [], [], []
                for i, text in enumerate(texts):
                    at = 0
                    for line in text.split(b"\n"):
                        if (exact_below or len(line) >= min_bytes) and line.strip():
                            owner.append(i), start.append(at), stop.append(min(at + len(line) + 1, len(text))), lines.append(line)
                        at += len(line) + 1
                if not lines:
                    continue
                sizes = np.fromiter(map(len, lines), np.int64, len(lines))
                long = sizes >= min_bytes  # a shorter line is linked to equal ones only
                keys = np.empty((0, 1), np.uint64)
                if long.any():
                    data = np.frombuffer(b"".join(lines), np.uint8)
                    keys = segment_keys(data, (np.cumsum(sizes) - sizes)[long], sizes[long], max_edits)
                edges = np.concatenate([[0], np.cumsum(long * keys.shape[1])]).astype(np.int32)
                wide = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), "<i8").reshape(-1, 2)
                yield pa.record_batch(
                    [part.column("k").take(pa.array(owner)), part.column("id").take(pa.array(owner)), pa.array(start, pa.int64()),
                     pa.array(stop, pa.int64()), pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy()),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.view(np.int64).ravel()))],
                    names=["k", "id", "start", "stop", "c1", "c2", "band_keys"],
                )

    return run


def remove_lines(
    docs: DataFrame,
    max_edits: int = 2,
    min_bytes: int = 20,
    exact_below: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, removed_bytes, kept, first_ids)``, one row per input row.

    ``kept`` is the UTF-8 of the text without the removed lines (their line feeds go along), ``n_removed`` their
    number, ``first_ids`` the sorted ids of the documents that hold the occurrences that stay in their place.  Lines of blanks only are kept as they are.
    Lines below ``min_bytes`` bytes are linked to equal lines with ``exact_below``, and kept as they are without.  A null or empty text has no lines.  Rows that repeat both id and
    text are one document and get the same result; a null id comes after all others when the first
    occurrence is chosen.  An empty table gives an empty table.
    """
    keyed = keyed_texts(docs, id_col, text_col)
    rows = keyed.select("k", F.col("id").cast("bigint").alias("id"), "text")
    units = written(rows.mapInArrow(_unit_rows(max_edits, min_bytes, exact_below), _UNIT), "line-units")
    cls = F.unhex(F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")))
    classes = written(classes_of(units).withColumn("cls", cls), "line-classes")

    banded = units.select("c1", "c2", F.explode("band_keys").alias("key"))
    mixed = banded.groupBy("key").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).where("low < high").select("key")
    shared = written(with_keys(banded, mixed, "key").select("key", cls.alias("cls")).distinct(), "line-shared")
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    bodies = bodies_of(keyed, classes.join(shared.select("cls").distinct(), "cls"))
    # A line's range includes its line feed; the last line of a text has none.
    body = F.when(F.substring("body", -1, 1) == F.lit(b"\n"), F.substring("body", F.lit(1), F.length("body") - 1)).otherwise(F.col("body"))
    items = written(bodies.select("cls", body.alias("payload")).withColumn("n", F.length("payload").cast("long")), "line-bodies")
    labels = components(link_buckets(shared.join(sizes, "key"), ["key"], items, EditDistance(max_edits)))
    return cut_repeats(keyed, units, classes, labels).withColumnRenamed("id", id_col)
