"""op6: removal of long repeated byte strings with a run-length index.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
in the corpus too.  The steps:

1. one pass over the texts: each window of ``length`` bytes is assigned to an anchor, the least-hashed
   ``GRAM``-byte string inside it.  Equal windows have equal anchors at the same offset, so a window can only repeat
   where its anchor does.  An anchor and the run of windows that chose it are one row (about one per 170 bytes);
2. anchors seen once are dropped.  Rows of an anchor whose whole run of windows (``sk``) is equal are
   repeated as they are and need no bytes;
3. of anchors that have several different runs, one occurrence per run goes on with its bytes.  A window reaches over its
   anchor by some bytes to the left and the rest to the right; cut into ``PARTS`` ranges of that reach, all windows of a
   range share a long middle part, so a run none of whose middle parts is seen in another run is done.  The others are
   dealt into blocks by anchor; a block's bytes are indexed: suffix array, Burrows-Wheeler transform, its runs, and suffix samples at
   both sides of every run border.  Inside a run, a match is the match one byte earlier made one
   shorter, so the longest matches start at the samples: their lengths are streamed in text order, and those of
   ``length`` or more mark their bytes;
4. an anchor with more than ``BLOCK_RUNS`` different runs (a passage that very many documents share, each in its own
   surroundings) is not put into one block: its windows are hashed one by one and counted by Spark;
5. spans of all steps are joined to the texts and cut out.

Step 2 and 4 count 128 bits of hash; step 3 compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, written
from maieutic.llm.cutting import keyed_texts
from maieutic.llm.shingles import mix, power_tables, running_sums

GRAM = 64
PARTS = 4
PIECE = 4 << 20  # bytes hashed at once; a longer text is worked in overlapping pieces
SLICE_BYTES = 512 << 10
BLOCK_BYTES = 512 << 10  # an index holds about 100 bytes per byte of its block
BLOCK_RUNS = 800
HOT_KEYS = 4096
_POSITION = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string of ``data``, by its start."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = running_sums(data)
    _, down = power_tables(len(data))
    return mix((sums[gram:] - sums[:-gram]) * down[:n])


def anchors(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(piece number, anchor place, first window, last window, anchor hash) for each anchor and its run of windows.

    Places are in the piece.  The window's anchor is the least of the high 40 hash bits, the leftmost of equals.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    if len(h) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & _POSITION).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    room = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), room)
    first = np.concatenate([[0], np.cumsum(room)])
    window = np.arange(first[-1]) - first[owner] + starts[owner]
    at = place[window]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    who = owner[begin]
    return who, at[begin] - starts[who], window[begin] - starts[who], window[end] - starts[who], h[at[begin]]


def _middle_parts(length: int, gram: int) -> list[Column]:
    """Hashes of the part that all windows of a reach range share (null where the run has no such window)."""
    reach = length - gram
    edges = [reach * g // PARTS for g in range(PARTS + 1)]
    last = F.col("s") + F.length("body") - length
    out = []
    for near, far in zip(edges, edges[1:]):
        has = (F.col("s") <= -near) & (last >= -far)
        out.append(F.when(has, F.xxhash64(F.expr(f"substring(body, {1 - near} - s, {length - far + near})"))))
    return out


def _anchor_rows(length: int, gram: int):
    names = ["k", "at", "s", "e", "fp", "sk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                pieces, keys, bases = [], [], []
                for key, text in zip(part.column("k").to_pylist(), texts):
                    for base in range(0, max(len(text) - length + 1, 0), PIECE):
                        pieces.append(text[base : base + PIECE + length - 1])
                        keys.append(key), bases.append(base)
                # A long text is one slice: its pieces are hashed a few at a time.
                for group in _by_size(pieces, PIECE):
                    own = [pieces[i] for i in group]
                    who, at, first, last, fp = anchors(own, length, gram)
                    if not len(who):
                        continue
                    sk = np.fromiter(
                        (xxhash.xxh3_64_intdigest(own[w][a : b + length]) for w, a, b in zip(who.tolist(), first.tolist(), last.tolist())),
                        np.uint64, len(who),
                    )
                    base = np.array([bases[i] for i in group], np.int64)[who]
                    key = pa.array([keys[i] for i in group], pa.binary()).take(pa.array(who))
                    yield pa.record_batch(
                        [key, pa.array(at + base), pa.array((first - at).astype(np.int32)), pa.array((last - at).astype(np.int32)),
                         pa.array(fp.view(np.int64)), pa.array(sk.view(np.int64))],
                        names=names,
                    )

    return run


def _by_size(pieces: list[bytes], limit: int) -> Iterator[list[int]]:
    group, size = [], 0
    for i, p in enumerate(pieces):
        if group and size + len(p) > limit:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(p)
    if group:
        yield group


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols until all differ (the last is the inverse suffix array).

    A rank is the number of suffixes before its group, and only groups of several suffixes are sorted again.
    """
    n = len(symbols)

    def refine(active: np.ndarray, rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = rank[active]
        order = np.argsort(first * (n + 1) + second)
        a, f, s = active[order], first[order], second[order]
        place = np.arange(len(a))
        group = np.ones(len(a), bool)
        group[1:] = f[1:] != f[:-1]
        part = group.copy()
        part[1:] |= s[1:] != s[:-1]
        shift = np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[a] = f + shift
        return rank, a[~(part & np.append(part[1:], True))]

    def kept(rank: np.ndarray) -> np.ndarray:
        return rank.astype(np.int32) if n < 1 << 31 else rank

    dense = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    rank, active = refine(np.arange(n), np.zeros(n, np.int64), dense)
    levels, h = [kept(rank)], 1
    while len(active):
        second = np.zeros(len(active), np.int64)
        inside = active + h < n
        second[inside] = rank[active[inside] + h] + 1
        rank, active = refine(active, rank, second)
        levels.append(kept(rank))
        h *= 2
    return levels


def run_length_matches(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of maximal stretches covered by strings of ``length`` bytes that occur twice in ``segments``.

    The transform is cut into runs, a suffix sample is taken at both sides of each run border, and
    the samples' match lengths are streamed in text order.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    many = len(segments)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text = np.zeros(int(sizes.sum()) + many, np.int64)
    body = np.ones(len(text), bool)
    body[starts + sizes] = False
    text[body] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + many
    text[~body] = np.arange(many)  # each segment ends in a symbol of its own, which nothing matches
    levels = suffix_ranks(text)
    n = len(text)
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    transform = text[sa - 1]  # of the first suffix: the last symbol, an end mark
    border = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    a, b = sa[border - 1], sa[border]
    lcp = np.zeros(len(a), np.int64)
    # Only borders whose sides share the largest power of two below ``length`` can matter.
    top = length.bit_length() - 1
    if top >= len(levels):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    keep = levels[top][a] == levels[top][b]
    a, b, lcp = a[keep], b[keep], lcp[keep]
    for k in range(len(levels) - 1, -1, -1):
        inside = (a + lcp < n) & (b + lcp < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside] + lcp[inside]] == levels[k][b[inside] + lcp[inside]]
        lcp[same] += 1 << k
    keep = lcp >= length
    a, b, lcp = a[keep], b[keep], lcp[keep]
    edge = np.zeros(n + 1, np.int64)
    for side in (a, b):
        np.add.at(edge, side, 1)
        np.add.at(edge, side + lcp, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = flips[0::2], flips[1::2]
    owner = np.searchsorted(starts, first, "right") - 1
    return owner, first - starts[owner], last - starts[owner]


def _merged(rows: list[tuple[bytes, int, bytes]]) -> tuple[list[bytes], list[tuple[bytes, int]]]:
    """Join overlapping stretches of one text, so each place of a text is in a block once."""
    texts, places = [], []
    for key, start, body in sorted(rows, key=lambda r: (r[0], r[1], -len(r[2]))):
        if places and places[-1][0] == key and start <= places[-1][1] + len(texts[-1]):
            over = places[-1][1] + len(texts[-1]) - start
            if over < len(body):
                texts[-1] += body[over:]
        else:
            texts.append(body), places.append((key, start))
    return texts, places


def _block_spans(length: int):
    """Rows of a block lie together (sorted by block); removed spans come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            texts, places = _merged(rows)
            owner, first, last = run_length_matches(texts, length)
            key = pa.array([places[o][0] for o in owner.tolist()], pa.binary())
            base = np.array([places[o][1] for o in owner.tolist()], np.int64)
            return pa.record_batch([key, pa.array(first + base), pa.array(last + base)], names=["k", "start", "end"])

        block, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "k", "start", "body"))):
                if b != block:
                    if rows:
                        yield flush(rows)
                    block, rows = b, []
                rows.append(tuple(row))
        if rows:
            yield flush(rows)

    return run


def _windows(length: int):
    """One row per window of a stretch, with a 128-bit hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, off, key, start, body in zip(*(batch.column(c).to_pylist() for c in ("fp", "s", "k", "start", "body"))):
                n = len(body) - length + 1
                yield pa.record_batch(
                    [pa.array([fp] * n, pa.int64()), pa.array(range(off, off + n), pa.int32()),
                     pa.array([xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)], pa.binary()),
                     pa.array([key] * n, pa.binary()), pa.array(range(start, start + n), pa.int64())],
                    names=["fp", "off", "wh", "k", "start"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part, texts in text_slices(batch, "text", PIECE):
            all_spans, kept = [], []
            for text, found in zip(texts, part.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2])))
                all_spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.record_batch(
                [part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"],
            )


def _with_counts(rows: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``counts``, one row per key with ``seen``, the number of ``rows`` of that key.

    Keys that hold more than one in ``HOT_KEYS`` of the counted rows, so fewer than ``HOT_KEYS``, are broadcast: their rows stay
    where they are and no task gets all rows of a very common string.  The others are shuffled by key.
    """
    counts = written(counts, "sub-counts")
    least = (counts.agg(F.sum("seen")).first()[0] or 0) // HOT_KEYS
    often = counts.where(F.col("seen") > least)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(often), on).unionByName(rest.join(counts.where(F.col("seen") <= least), on))


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    gram: int = GRAM,
    block_runs: int = BLOCK_RUNS,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, n_bytes, spans, kept)``, one row per input row.

    ``spans`` are the maximal removed byte ranges of the text's UTF-8, sorted; ``kept`` the other bytes joined (cuts may fall
    inside a character).  Matches never cross documents; a text shorter than ``length``, empty or null has
    none.  A repeated row is another document and so repeats all of it.  ``gram`` must be at most ``length``.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed_texts(docs, id_col, text_col)
    fields = "k binary, at bigint, s int, e int, fp bigint, sk bigint"
    found = written(keyed.select("k", "text").mapInArrow(_anchor_rows(length, gram), fields), "sub-anchors")

    per_fp = found.groupBy("fp").agg(F.count(F.lit(1)).alias("seen"), F.min("sk").alias("low"), F.max("sk").alias("high"))
    per_fp = per_fp.where("seen > 1").select("fp", "seen", (F.col("low") == F.col("high")).alias("alike"))
    shared = written(_with_counts(found, per_fp, ["fp"]).select("k", "at", "s", "e", "fp", "sk", "alike"), "sub-shared")
    per_run = written(
        shared.where("NOT alike").groupBy("fp", "sk").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("k", "at", "s", "e")).alias("one")),
        "sub-runs",
    )
    repeated = _with_counts(shared.where("NOT alike"), per_run.where("same > 1").select("fp", "sk", F.col("same").alias("seen")), ["fp", "sk"])
    span = lambda df: df.select("k", (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e") + length).alias("end"))
    whole = span(shared.where("alike")).unionByName(span(repeated))

    # Bytes of one occurrence per run, fetched text by text.
    wanted = per_run.select(
        "fp", "one.k", (F.col("one.at") + F.col("one.s")).alias("start"), (F.col("one.e") - F.col("one.s") + length).alias("size"), F.col("one.s").alias("s")
    )
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("fp", "start", "size", "s")).alias("cuts"))
    texts = keyed.select("k", F.col("text").cast("binary").alias("text")).join(lists, "k").dropDuplicates(["k"])
    body = F.substring("text", F.col("c.start").cast("int") + 1, F.col("c.size").cast("int"))
    pieces = texts.select("k", "text", F.explode("cuts").alias("c")).select("k", "c.fp", "c.start", "c.s", body.alias("body"))
    pieces = written(pieces.withColumn("parts", F.array(*_middle_parts(length, gram))), "sub-pieces")
    parts = pieces.select("k", "fp", "start", F.posexplode("parts").alias("g", "h")).where("h IS NOT NULL")
    met = parts.groupBy("fp", "g", "h").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    open_runs = written(_with_counts(parts, met, ["fp", "g", "h"]).select("k", "fp", "start").distinct(), "sub-open-runs")
    runs_of = open_runs.groupBy("fp").agg(F.count(F.lit(1)).alias("seen"))
    open_runs = _with_counts(open_runs, runs_of, ["fp"]).select("k", "fp", "start", (F.col("seen") > block_runs).alias("many"))
    pieces = written(pieces.drop("parts").join(open_runs, ["k", "fp", "start"]), "sub-open")

    volume = pieces.where("NOT many").agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-volume // block_bytes))
    dealt = pieces.where("NOT many").select(F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("block"), "k", "start", "body")
    dealt = dealt.repartition(max(1, min(blocks, 4 * n)), "block").sortWithinPartitions("block")
    indexed = dealt.mapInArrow(_block_spans(length), "k binary, start bigint, end bigint")

    windows = pieces.where("many").select("fp", "s", "k", "start", "body").mapInArrow(
        _windows(length), "fp bigint, off int, wh binary, k binary, start bigint"
    )
    windows = written(windows, "sub-windows")
    twice = windows.groupBy("fp", "off", "wh").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    counted = _with_counts(windows, twice, ["fp", "off", "wh"]).select("k", "start", (F.col("start") + length).alias("end"))

    spans = whole.unionByName(indexed).unionByName(counted)
    per_row = written(spans.groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "sub-spans")
    kind = keyed.schema["id"].dataType.simpleString()
    out = keyed.join(per_row, "k", "left").select("id", "text", "spans").mapInArrow(
        _cut, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumnRenamed("id", id_col)
