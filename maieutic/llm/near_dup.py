"""op8: near-duplicate documents by SetSketch registers.

A document's shingle set is sketched into registers ``floor(1 - log_b(x))`` of
the least of exponentially distributed hashes (b = 1.001): registers of a union
are the maxima of the registers, and two registers agree about as often as the
sets overlap.  The steps:

1. one pass over the texts: sketch, set size and a 128-bit hash of the set;
2. equal sets become one class (combined before the shuffle), so copies cost nothing from here on;
3. four registers are one band; classes that agree in a band are one bucket;
4. each bucket is compared with one hub, not pair by pair: the hub is the member whose bands are the most
   shared, which in a group of copies is the text nearest to their origin;
5. pairs (member, hub) whose joint likelihood, given the exact set sizes, does not rule out the threshold are
   verified on the full sets;
6. what is left: a member that did not link to its hub may still link to another member of the same
   hub's cluster.  Those leftovers are compared with the whole cluster in tiles of bounded size, again by
   likelihood, then by exact sets.  Two members that both link to the hub need no comparison;
7. components of the verified links.

Every pair that shares a band is thus either connected through a hub or
compared.  With 24 bands of 4 registers a pair at similarity 0.8 shares none
with probability 3e-6 (``(1 - 0.8**4) ** 24``).  Only step 6 can cost more than the
input: it grows with leftovers times cluster size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, written
from maieutic.llm.components import components
from maieutic.llm.cutting import keyed_texts
from maieutic.llm.linking import BASE, RATE, TOP, Jaccard, link_buckets
from maieutic.llm.shingles import shingle_sets

BAND_ROWS = 4  # registers of 2 bytes: a band is one 64-bit key
SLICE_BYTES = 1 << 20


def multipliers(registers: int) -> np.ndarray:
    """One odd 64-bit multiplier per register (fixed by the register number)."""
    return np.array([xxhash.xxh3_64_intdigest(f"register {i}") | 1 for i in range(registers)], np.uint64)


def sketch(shingles: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """Registers (uint16, one row per set); an empty set has all zeros."""
    out = np.zeros((len(counts), registers), np.uint16)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[filled])[:-1]])
    least = np.empty((len(filled), registers))
    for i, m in enumerate(multipliers(registers)):
        least[:, i] = np.minimum.reduceat(shingles * m, starts)
    uniform = (least + 0.5) / 2.0**64
    value = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    out[filled] = np.clip(value, 0, TOP + 1).astype(np.uint16)
    return out


def sketch_documents(docs: DataFrame, shingle: int, registers: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, k, n, cls, regs)``: ``k`` is the row's key, ``cls`` is the 128-bit hash of the set, null (like ``regs``) for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                values, counts = shingle_sets(texts, shingle)
                regs = sketch(values, counts, registers)
                edges = np.concatenate([[0], np.cumsum(counts)])
                cls = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(edges, edges[1:])]
                rows = [r.tobytes() if n else None for r, n in zip(regs, counts)]
                yield pa.record_batch(
                    [part.column("id"), part.column("k"), pa.array(counts), pa.array(cls, pa.binary()), pa.array(rows, pa.binary())],
                    names=["id", "k", "n", "cls", "regs"],
                )

    rows = keyed_texts(docs, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "k", "text")
    return rows.mapInArrow(run, "id bigint, k binary, n bigint, cls binary, regs binary")


def _band_keys(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<i8").reshape(rows, bands)
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(rows), bands)))
            band = np.tile(np.arange(bands, dtype=np.int32), rows)
            yield pa.record_batch([pa.array(band), pa.array(keys.ravel()), cls], names=["band", "key", "cls"])

    return run


def _sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                values, counts = shingle_sets(texts, shingle)
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cls = pa.array([xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(edges, edges[1:])], pa.binary())
                same = pa.array([a == b for a, b in zip(cls.to_pylist(), part.column("cls").to_pylist())])
                sets = pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)))
                yield pa.record_batch([part.column("cls"), sets], names=["cls", "shingles"]).filter(same)

    return run


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    threshold_pct: int = 80,
    bands: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, n_shingles, component_id, kept, row_key, stays)``, one row per input row.

    Words are A-Z lower-cased runs other than ASCII blanks; a text of fewer than
    ``shingle`` words is one shingle, and one without words (or null) has none, links
    with nothing and is kept.  Rows are linked if the Jaccard similarity of their
    sets is ``threshold_pct`` percent or more; ``component_id`` is the smallest id that links reach, and
    ``kept`` says whether the row has that id (rows that repeat it are all kept; rows with a null id count as
    kept only if no row they reach has an id).  ``row_key`` (see ``cutting.row_key``) finds the row again, and ``stays`` is
    true for one row key of each component: the smallest id, then the smallest key.  An empty table gives an empty table.
    """
    registers = bands * BAND_ROWS
    rows = written(sketch_documents(docs, shingle, registers, id_col, text_col), "near-sketch")
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k")).alias("at"),
        F.first("n").alias("n"), F.first("regs").alias("regs"),
    )
    classes = written(classes, "near-classes")

    banded = classes.select("cls", "regs").mapInArrow(_band_keys(bands), "band int, key bigint, cls binary")
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(banded.join(shared, ["band", "key"]), "near-members")
    # Full sets of the classes that share a band with another, from one document each.
    wanted = members.select("cls").distinct().join(classes.select("cls", "at"), "cls").select("cls", "at.k")
    texts = keyed_texts(docs, id_col, text_col).select("k", "text")
    sources = texts.join(wanted, "k").select("cls", "text")
    sets = written(
        sources.mapInArrow(_sets_of(shingle), "cls binary, shingles array<bigint>").dropDuplicates(["cls"])
        .join(classes.select("cls", "n"), "cls"),
        "near-sets",
    )

    items = sets.select("cls", "n", F.col("shingles").alias("payload")).join(classes.select("cls", "regs"), "cls")
    links = link_buckets(members, ["band", "key"], items, Jaccard(threshold_pct), registers)
    labels = components(links)
    rooted = classes.select("cls", "at").join(labels, F.col("cls") == F.col("node"), "left")
    rooted = written(rooted.select("cls", "at", F.coalesce("root", "cls").alias("root")), "near-roots")
    least = rooted.groupBy("root").agg(F.min("at").alias("first"))
    of_class = rooted.join(least, "root").select("cls", "first")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("id")).otherwise(F.col("first.id"))
    return (
        rows.select("id", "k", "n", "cls")
        .join(of_class, "cls", "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"), F.col("k").alias("row_key"),
            (alone | F.col("k").eqNullSafe(F.col("first.k"))).alias("stays"),
        )
    )
