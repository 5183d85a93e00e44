"""Verified links within buckets of candidate items, without comparing a bucket pair by pair.

Items are classes of equal sets (``cls``); buckets are groups of items that a
banding calls similar.  ``link_buckets`` returns links that connect exactly
those items which links at the threshold between members of a common bucket connect:

1. each bucket has a hub, the member whose buckets are the largest in sum, which in a group of copies is the
   one nearest to their origin; every other member is verified against its hub;
2. the members that share a hub are that hub's cluster.  Two members that both link to the hub are connected
   already.  A member that does not (a leftover) is compared with the whole cluster, in tiles of bounded size;
3. in a tile, pairs that earlier links of the tile connect are not tested again, and only links that
   connect something new come out.

So rows moved grow with memberships, but for leftovers, whose cost is leftovers
times cluster size, divided by the tile size.

With registers (SetSketch, see ``near_dup``) a pair is first judged by the joint
likelihood of its two sketches, and verified on the full sets unless that
rules the threshold out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import written

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2  # sketch base b, rate a and largest register q
TILE = 256  # rows of a side of a tile,
TILE_VALUES = 1 << 20  # and what their sets or lines may weigh together: members of heavier ones are spread over more tiles


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(n1: np.ndarray, n2: np.ndarray, less: np.ndarray, more: np.ndarray, registers: int, threshold: float) -> np.ndarray:
    """Whether the joint likelihood leaves the similarity at ``threshold`` or more.

    ``less`` / ``more``: registers in which the first sketch is below / above the second;
    ``n1``, ``n2``: exact set sizes.  Pairs whose sizes alone rule the threshold out are not plausible; others
    unless the likelihood ratio against the best estimate is beyond 36 (six standard deviations).
    """
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    equal = registers - less - more

    def log_likelihood(j):
        up, down = _p(u - v * j), _p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    best = np.full(len(n1), -np.inf)
    high = np.full(len(n1), -np.inf)
    for share in np.linspace(0, 1, 41):
        j = top * share
        value = log_likelihood(j)
        best = np.maximum(best, value)
        high = np.where(j >= threshold, np.maximum(high, value), high)
    high = np.where(top >= threshold, np.maximum(high, log_likelihood(np.minimum(top, threshold))), high)
    return (top >= threshold - 1e-9) & (2 * (best - high) <= 36)


def _plausible_pairs(registers: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, registers) for c in ("regs", "hub_regs")
            )
            n1, n2 = (batch.column(c).to_numpy().astype(float) for c in ("n", "hub_n"))
            keep = plausible(n1, n2, (a < b).sum(1), (a > b).sum(1), registers, threshold)
            yield pa.record_batch([batch.column("cls"), batch.column("hub"), pa.array(keep)], names=["cls", "hub", "maybe"])

    return run


class Jaccard:
    """Sets (sorted 64-bit shingles) at a Jaccard similarity of ``threshold_pct`` percent or more."""

    payload = "array<bigint>"

    def __init__(self, threshold_pct: int):
        self.threshold_pct = threshold_pct

    def verified(self, pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("payload", "hub_payload")).cast("long")
        linked = both * 100 >= (F.col("n") + F.col("hub_n") - both) * self.threshold_pct
        return pairs.select("cls", "hub", linked.alias("linked"))

    def near_sizes(self, sizes: np.ndarray, n: float) -> np.ndarray:
        return np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * self.threshold_pct

    def load(self, value) -> np.ndarray:
        return np.sort(value.values.to_numpy())

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        both = int((b[at] == a).sum())
        return 100 * both >= self.threshold_pct * (len(a) + len(b) - both)

    def index(self, bodies: list[np.ndarray]):
        """All sets of a tile by value, so that one set meets them all at once."""
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        values = np.concatenate(bodies)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(bodies)), sizes)[order], sizes

    def linked_to(self, index, body: np.ndarray) -> np.ndarray:
        """Which sets of the tile ``body`` links to."""
        values, owner, sizes = index
        low, high = np.searchsorted(values, body, "left"), np.searchsorted(values, body, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        return 100 * both >= self.threshold_pct * (len(body) + sizes - both)


def _tile_links(test, registers: int):
    """Rows of one tile lie together (sorted); links that connect something new come out."""

    def compare(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        names = [r[1] for r in rows]
        root = {x: x for x in names}
        settled: bytes | None = None  # members linked to the hub are connected to each other
        for _, cls, linked, *_ in rows:
            if linked:
                settled = settled or cls
                root[cls] = settled

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sizes = np.array([r[3] for r in rows], float)
        bodies = [r[5] for r in rows]
        if registers:
            regs = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, registers)
        index = test.index(bodies) if not registers and hasattr(test, "index") else None
        for i, (is_left, *_) in enumerate(rows):
            if not is_left:
                continue
            if index is not None:
                for j in np.flatnonzero(test.linked_to(index, bodies[i])).tolist():
                    if find(names[i]) != find(names[j]):
                        root[find(names[i])] = find(names[j])
                        yield names[i], names[j]
                continue
            maybe = np.flatnonzero(test.near_sizes(sizes, sizes[i]))
            if registers:
                less, more = (regs[i] < regs[maybe]).sum(1), (regs[i] > regs[maybe]).sum(1)
                one = np.full(len(maybe), sizes[i])
                maybe = maybe[plausible(one, sizes[maybe], less, more, registers, test.threshold_pct / 100)]
            for j in maybe.tolist():
                if find(names[i]) != find(names[j]) and test.linked(bodies[i], bodies[j]):
                    root[find(names[i])] = find(names[j])
                    yield names[i], names[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            found = list(compare(rows))
            a, b = zip(*found) if found else ((), ())
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        tile, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "lb", "yb")))
            plain = [batch.column(c).to_pylist() for c in ("is_left", "cls", "linked", "n", "regs")]
            payload = batch.column("payload")
            for i, (key, *row) in enumerate(zip(keys, *plain)):
                if key != tile:
                    if rows:
                        yield flush(rows)
                    tile, rows = key, []
                rows.append((*row, test.load(payload[i])))
        if rows:
            yield flush(rows)

    return run


def link_buckets(members: DataFrame, by: list[str], items: DataFrame, test, registers: int = 0) -> DataFrame:
    """Links ``(a, b)`` of the items.

    ``members``: (the bucket columns ``by``, cls binary, size: items of the bucket, above 1), without repeated
    rows; ``items``: (cls, n, payload, regs binary where ``registers`` is not 0), one row per item that has a
    bucket; ``test`` says which pairs link (see ``Jaccard``), from the payloads and the sizes ``n``.
    """
    spark = members.sparkSession
    central = members.groupBy("cls").agg(F.sum("size").alias("score"))
    hubs = (
        members.select(*by, "cls").join(central, "cls")
        .groupBy(*by).agg(F.max(F.struct("score", "cls"))["cls"].alias("hub"))
    )
    pairs = members.select(*by, "cls").join(hubs, by).where("cls <> hub").select("cls", "hub").distinct()
    if registers:
        known = items.select("cls", "n", "regs")
        as_hub = known.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("regs").alias("hub_regs"))
        pairs = (
            pairs.join(known, "cls").join(as_hub, "hub").select("cls", "hub", "n", "regs", "hub_n", "hub_regs")
            .mapInArrow(_plausible_pairs(registers, test.threshold_pct / 100), "cls binary, hub binary, maybe boolean")
        )
    else:
        pairs = pairs.withColumn("maybe", F.lit(True))
    pairs = written(pairs, "link-pairs")
    own = items.select("cls", "n", "payload")
    of_hub = own.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("payload").alias("hub_payload"))
    verified = test.verified(pairs.where("maybe").join(own, "cls").join(of_hub, "hub"))
    star = written(verified.unionByName(pairs.where("NOT maybe").select("cls", "hub", F.lit(False).alias("linked"))), "link-star")

    # Leftovers of a hub's cluster against the cluster, in tiles of about TILE rows a side, or fewer where they weigh more.  The
    # sums are written first: beside a scan Spark can split the members of one hub over several tasks.
    weighed = star.join(items.select("cls", "n"), "cls")
    left_over = F.when(~F.col("linked"), F.col("n"))
    blocks = lambda rows, weight: F.greatest(F.ceil(rows / TILE), F.ceil(F.coalesce(weight, F.lit(0)) / TILE_VALUES)).cast("int")
    clusters = weighed.groupBy("hub").agg(
        blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"), blocks(F.count(left_over), F.sum(left_over)).alias("left_blocks"),
        F.count(F.lit(1)).alias("size"),
    ).where("left_blocks > 0 AND size > 1")
    cluster = star.join(written(clusters, "link-clusters"), "hub")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cluster.where("NOT linked").select(
        "hub", "cls", "linked", block("left_blocks").alias("lb"), every("blocks").alias("yb"), F.lit(True).alias("is_left")
    )
    right = cluster.select(
        "hub", "cls", "linked", every("left_blocks").alias("lb"), block("blocks").alias("yb"), F.lit(False).alias("is_left")
    )
    tiles = left.unionByName(right).groupBy("hub", "lb", "yb", "cls", "linked").agg(F.max("is_left").alias("is_left"))
    regs = F.col("regs") if registers else F.lit(None).cast("binary").alias("regs")
    full = tiles.join(items.select("cls", "n", "payload", regs), "cls")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiled = full.select("hub", "lb", "yb", "is_left", "cls", "linked", "n", "regs", "payload")
    tiled = tiled.repartition(n, "hub", "lb", "yb").sortWithinPartitions("hub", "lb", "yb")
    extra = tiled.mapInArrow(_tile_links(test, registers), "a binary, b binary")
    return written(star.where("linked").select(F.col("cls").alias("a"), F.col("hub").alias("b")).unionByName(extra), "link-links")
