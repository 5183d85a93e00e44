"""Units of texts (paragraphs, lines): their classes, their bodies, and the removal of all but the first of a cluster.

A unit is a byte range ``[start, stop)`` of a row's UTF-8; ``k`` is the row's key and
``(c1, c2)`` a 128-bit hash of the unit, equal for equal units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, written

SLICE_BYTES = 1 << 20


def row_key(id_col: Column, text_col: Column) -> Column:
    """128 bits by which a row is found again; repeated rows share it, as they share their result."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, k)`` of every row."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.select("id", "text", row_key(F.col("id"), F.col("text")).alias("k"))


def classes_of(units: DataFrame) -> DataFrame:
    """``(c1, c2, seen, at)``: number of occurrences of a class and its first one, by id (null last) and place."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k", "start", "stop")
    return units.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("seen"), F.min(place).alias("at"))


def bodies_of(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cls, body)`` of each class, cut from the text of its first occurrence."""
    cuts = classes.groupBy("at.k").agg(F.collect_list(F.struct("cls", "at.start", "at.stop")).alias("cuts"))
    texts = keyed.select("k", F.col("text").cast("binary").alias("text")).join(cuts, "k").dropDuplicates(["k"])
    body = F.substring("text", F.col("c.start").cast("int") + 1, (F.col("c.stop") - F.col("c.start")).cast("int"))
    return texts.select("text", F.explode("cuts").alias("c")).select("c.cls", body.alias("body"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_slices(batch, "text", SLICE_BYTES):
            kept, counts, gone, firsts = [], [], [], []
            for text, found in zip(texts, part.column("gone").to_pylist()):
                spans = sorted((x["start"], x["stop"]) for x in found or ())
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
                counts.append(len(spans))
                gone.append(len(text) - len(kept[-1]))
                firsts.append(sorted({x["first_id"] for x in found or () if x["first_id"] is not None}))
            yield pa.record_batch(
                [part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["id", "n_bytes", "n_removed", "removed_bytes", "kept", "first_ids"],
            )


def cut_repeats(keyed: DataFrame, units: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, n_bytes, n_removed, removed_bytes, kept, first_ids)``, one row per row of ``keyed``.

    ``labels`` ``(node, root)`` joins classes (by ``cls``) to clusters; a class without a label is its own cluster.
    """
    rooted = classes.join(labels, F.col("cls") == F.col("node"), "left").where("seen > 1 OR root IS NOT NULL")
    rooted = written(rooted.select("c1", "c2", "at", F.coalesce("root", "cls").alias("root")), "cut-roots")
    stays = rooted.groupBy("root").agg(F.min("at").alias("stays"))
    decided = rooted.join(stays, "root").select("c1", "c2", "stays")
    gone = (
        units.select("k", "start", "stop", "c1", "c2").join(decided, ["c1", "c2"])
        .where((F.col("k") != F.col("stays.k")) | (F.col("start") != F.col("stays.start")))
        .select("k", F.struct("start", "stop", F.col("stays.id").alias("first_id")).alias("g"))
    )
    per_row = written(gone.groupBy("k").agg(F.collect_set("g").alias("gone")), "cut-gone")
    return keyed.join(per_row, "k", "left").select(F.col("id").cast("bigint").alias("id"), "text", "gone").mapInArrow(
        _cut, "id bigint, n_bytes bigint, n_removed bigint, removed_bytes bigint, kept binary, first_ids array<bigint>"
    )
