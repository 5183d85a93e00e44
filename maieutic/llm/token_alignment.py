"""op11: alignment of two tokenizers by interval coalescing.

Both tokenizers cut the same bytes.  All A and B tokens are sorted together by
start (``lexsort``), the running maximum of their ends is taken
(``maximum.accumulate``), and a group breaks where a start reaches that maximum.
Overlaps (or common ends) are expanded to links only within groups.

A text is first cut before every single space between two non-blank characters, where
both vocabularies provably end a token (``Aligner.cuts``): no pre-token of A
goes on past such a place and no piece of B holds a space after another character.
So the tokens, the groups and the links of a segment do not depend on its neighbours, and each
distinct segment is encoded and coalesced once per worker while its memo lasts.  Where a vocabulary does not
allow the proof, the text is one segment.

The encoded pass writes one row per text to the shared folder: its counts, the
digest of its groups and its distinct links with their numbers.  The corpus-wide counts of id pairs are sums
over those rows.  Looking the counts up again splits the pairs: a power-of-two histogram of the
counts gives the level above which at most ``broadcast_pairs`` pairs lie; these are
broadcast, the rarer ones, none of which is frequent, are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices, written
from maieutic.llm.token_count import _byte_alphabet, load_tokenizer

SLICE_BYTES = 1 << 20
MEMO_SEGMENTS = 300_000  # segments a worker remembers, and their bytes; memory bounds only
MEMO_BYTES = 16 << 20
CALL_BYTES = 1 << 16
#: Id pairs that are broadcast at most (24 bytes each); all others are joined by shuffle.
BROADCAST_PAIRS = 1 << 18

_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# Blanks other than space and line feed.
_RARE_BLANK = re.compile("[\t\v-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# How a sentence-piece vocabulary writes a space and a byte.
_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# Fixed value: the splitting pattern that "ByteLevel" pre-tokenizers stand for.
_BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Code points whose class is the same in every version of Unicode, and no blank at either end.
_EDGE = "!-~¡-ɏ"
_PLAIN_SEGMENT = re.compile(f"[{_EDGE}](?:[\t-\r {_EDGE}]*[{_EDGE}])?")


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals sorted by start, the group number of each; a group breaks where a start reaches the running maximum of the ends."""
    order = np.lexsort((side, starts))
    top = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= top[:-1]
    return order, np.cumsum(fresh) - 1


def expand_links(a_start, a_end, b_start, b_end, pairing: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked A and B tokens, ordered by A; both sides are sorted and do not overlap themselves.

    ``end``: byte ranges that end together; ``overlap``: byte ranges with a common byte.
    """
    if pairing == "end":
        _, a, b = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        return a, b
    first = np.searchsorted(b_end, a_start, "right")
    last = np.searchsorted(b_start, a_end, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(a_start)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return a, b


class Aligner:
    """Groups and links of texts; one per Python worker and pair of vocabulary files."""

    _instances: dict[tuple[str, str, str], "Aligner"] = {}

    def __init__(self, a_path: str, b_path: str, pairing: str):
        import os

        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.pairing = pairing
        self.a = load_tokenizer(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        # Added tokens are never met (special strings are plain text), so their entries need no bytes.
        self.a_bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else b"" for e in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i)
            else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.most_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{mark}{i}" for mark in "\n;|," for i in range(self.most_ids)]
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = self._proved(spec, pieces)
        self.ranks = self._as_ranks(spec, entries) if self.cuts else None
        self._forget()

    @classmethod
    def of(cls, a_path: str, b_path: str, pairing: str) -> "Aligner":
        key = (a_path, b_path, pairing)
        if key not in cls._instances:
            cls._instances.clear()
            cls._instances[key] = cls(a_path, b_path, pairing)
        return cls._instances[key]

    def _as_ranks(self, spec: dict, entries: list[str]):
        """A as a table of ranks, or None where that is not proved to give the same ids.

        Merging by rank merges any two neighbours whose bytes are an entry, merging by list only listed pairs.  They agree if
        entries are numbered in the order of their merges and each entry's own bytes are merged to that entry: then
        the neighbours were reached in its own merging, too, and are its listed pair.
        """
        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = ["".join(m) for m in merges]
        ids = list(map(self.a.token_to_id, made))
        model = self.a.model
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        if {bytes([x]) for x in range(256)} - set(self.a_bytes) or ids != sorted(ids) or set(made) | added | set(_byte_alphabet()) != set(entries):
            return None
        if any([t.id for t in model.tokenize(e)] != [i] for i, e in enumerate(entries) if e not in added):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if entries[i] not in added}
        return tiktoken.Encoding("ranks", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _proved(self, spec: dict, pieces: list[str]) -> bool:
        """Whether both vocabularies end a token before every single space between non-blank characters."""
        rule = spec["pre_tokenizer"] or {}
        plain_a = not spec["normalizer"] and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        probe = " a  b\tﬁ Å 　x \n"
        plain_b = b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode()
        # The piece of unknown text and control pieces are never merged.
        inner = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        return bool(plain_a and plain_b and not inner)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        # Per segment: tokens of A, of B, groups, links, 1 if the bytes differ, and the place of its links' id pairs.
        self.counts = np.zeros((0, 6), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.n_pairs = self.held = 0

    @staticmethod
    def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
        """An array with room for ``more`` rows after the first ``used``; it at least doubles, so adding is linear."""
        if used + more <= len(held):
            return held
        grown = np.zeros((max(2 * len(held), used + more), *held.shape[1:]), held.dtype)
        grown[:used] = held[:used]
        return grown

    def _encode(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, tokens of A per segment, the same of B) of segments; no tokens where the bytes differ.

        Segments that neither begin nor end with a blank are encoded side by side, some 64 KB a call: a cut lies between
        them.  All others, and a call whose bytes do not come back, go through the libraries one by one.
        """
        ids: list[list[np.ndarray]] = [[], []]
        sizes: list[list[np.ndarray]] = [[], []]

        def add(side: int, found, lengths) -> None:
            ids[side].append(np.asarray(found, np.int64))
            sizes[side].append(np.asarray(lengths, np.int64))

        def together(part: list[str]) -> bool:
            text = " ".join(part)
            if "".join(part).isascii():
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            else:
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            a, b = self.ranks.encode_to_numpy(" " + text).astype(np.int64), self.b.encode(text)
            # A's ranks hold every byte, so its tokens tile any text; B may have changed or left out something.
            if b"".join(map(self.b_bytes.__getitem__, b)) != (" " + text).encode():
                return False
            b = np.fromiter(b, np.int64, len(b))
            for side, found, size in ((0, a, self.a_size), (1, b, self.b_size)):
                upto = np.searchsorted(np.cumsum(size[found]), ends, "right")
                add(side, found, np.diff(upto, prepend=0))
            return True

        def one_by_one(part: list[str]) -> None:
            for s in part:
                raw = (" " + s).encode("utf-8", "surrogatepass")
                a, b = self.a.encode(" " + s, add_special_tokens=False).ids, self.b.encode(s)
                if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                    a, b = [], []
                add(0, a, [len(a)])
                add(1, b, [len(b)])

        plain: list[str] = []
        size = 0
        for s in [*fresh, None]:
            easy = s is not None and self.ranks is not None and _PLAIN_SEGMENT.fullmatch(s) is not None
            if plain and (not easy or size > CALL_BYTES):
                together(plain) or one_by_one(plain)
                plain, size = [], 0
            if easy:
                plain.append(s)
                size += len(s)
            elif s is not None:
                one_by_one([s])
        return (*(np.concatenate(x) for x in (ids[0], sizes[0], ids[1], sizes[1])),)

    def _learn(self, fresh: list[str]) -> None:
        """Encode and coalesce segments that the memo lacks, all at once."""
        n = len(fresh)
        flat_a, n_a, flat_b, n_b = self._encode(fresh)
        # All segments side by side: the tokens of each side tile the bytes without a gap.
        a_end, b_end = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        a_start, b_start = a_end - self.a_size[flat_a], b_end - self.b_size[flat_b]
        left, right = expand_links(a_start, a_end, b_start, b_end, self.pairing)
        pairs = flat_a[left] << 32 | flat_b[right]
        ids = np.concatenate([flat_a, flat_b])
        side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
        segment = np.concatenate([np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)])
        order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), side)
        ids, side, segment = ids[order], side[order], segment[order]
        by_side = np.argsort(group * 2 + side, kind="stable")  # starts ascend within a side
        ids, side, segment, group = ids[by_side], side[by_side], segment[by_side], group[by_side]
        new_group = np.diff(group, prepend=-1) > 0
        n_groups = np.bincount(segment[new_group], minlength=n)
        n_links = np.bincount(np.repeat(np.arange(n), n_a)[left], minlength=n)
        # What precedes a token: the next segment, the next group, the other side, or the same one.
        before = np.where(np.diff(segment, prepend=-1) > 0, 0, np.where(new_group, 1, np.where(np.diff(side, prepend=0) > 0, 2, 3)))
        texts = "".join(map(self.written.__getitem__, (before * self.most_ids + ids).tolist())).split("\n")[1:]
        if len(texts) < n:  # segments without tokens
            there = iter(texts)
            texts = [next(there) if k else "" for k in (n_a > 0).tolist()]
        at = len(self.groups)
        self.counts = self._room(self.counts, at, n)
        self.counts[at : at + n] = np.stack([n_a, n_b, n_groups, n_links, n_a == 0, self.n_pairs + np.cumsum(n_links) - n_links], 1)
        self.pairs = self._room(self.pairs, self.n_pairs, len(pairs))
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)] = pairs
        self.n_pairs += len(pairs)
        self.groups += texts
        self.number.update(zip(fresh, range(at, at + n)))
        self.held += sum(map(len, fresh))

    def _segments(self, text: str) -> list[str]:
        """The text cut before every single space between two characters that are no blanks."""
        if not self.cuts or not text:
            return [text] if text else []
        odd = "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " "
        return _BETWEEN_WORDS.split(text) if odd or _RARE_BLANK.search(text) else text.split(" ")

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str | None, np.ndarray]]:
        """(tokens of A, tokens of B, groups, digest input, id pairs of all links) of each text; no digest input: without tokens."""
        if len(self.number) > MEMO_SEGMENTS or self.held > MEMO_BYTES:
            self._forget()
        cut = list(map(self._segments, texts))
        flat = [s for segments in cut for s in segments]
        # In the order of their first place, so that reruns do the same.
        fresh = [s for s in dict.fromkeys(flat) if s not in self.number]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        upto = np.cumsum([0, *map(len, cut)])
        sums = np.zeros((len(flat) + 1, 5), np.int64)
        np.cumsum(self.counts[at, :5], axis=0, out=sums[1:])
        per_text = sums[upto[1:]] - sums[upto[:-1]]
        # The links of the slice, one segment after the other.
        n_links, first = self.counts[at, 3], self.counts[at, 5]
        places = np.repeat(first - sums[:-1, 3], n_links) + np.arange(sums[-1, 3])
        pairs = self.pairs[places]
        link_upto = sums[upto, 3].tolist()
        names, at = self.groups, at.tolist()
        out = []
        for i, (n_a, n_b, n_groups, _, differ) in enumerate(per_text.tolist()):
            if differ or not cut[i]:
                out.append((0, 0, 0, None, pairs[:0]))
                continue
            digest = ";".join([names[k] for k in at[upto[i] : upto[i + 1]]])
            out.append((n_a, n_b, n_groups, digest, pairs[link_upto[i] : link_upto[i + 1]]))
        return out


_ENCODED = (
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, row bigint, pairs array<bigint>, times array<int>"
)


def encoded_rows(docs: DataFrame, a_path: str, b_path: str, pairing: str, id_col: str, text_col: str) -> DataFrame:
    """One row per text: counts, digest, and its distinct links (``a << 32 | b``) with their numbers; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner.of(a_path, b_path, pairing)
        row = TaskContext.get().partitionId() << 40
        try:
            for batch in batches:
                for part, texts in text_slices(batch, "text", SLICE_BYTES):
                    found = aligner.align([t.decode("utf-8", "surrogatepass") for t in texts])
                    distinct = [np.unique(pairs, return_counts=True) for *_, pairs in found]
                    lengths = np.cumsum([0] + [len(p) for p, _ in distinct]).astype(np.int32)
                    n_a, n_b, n_groups = (np.array([f[i] for f in found], np.int64) for i in range(3))
                    yield pa.record_batch(
                        [
                            part.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                            pa.array([len(f[4]) for f in found], pa.int64()),
                            pa.array(["" if f[3] is None else hashlib.sha256(f[3].encode()).hexdigest() for f in found], pa.string()),
                            pa.array(np.arange(row, row + len(found))),
                            pa.ListArray.from_arrays(lengths, pa.array(np.concatenate([p for p, _ in distinct]), pa.int64())),
                            pa.ListArray.from_arrays(lengths, pa.array(np.concatenate([c for _, c in distinct]).astype(np.int32))),
                        ],
                        names=["id", *(f.split()[0] for f in _ENCODED.split(", "))],
                    )
                    row += len(found)
        finally:
            aligner._forget()  # a reused worker keeps the vocabularies only

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"id {kind}, {_ENCODED}"), "aligned")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``(pair, links, best)``: corpus-wide links of each id pair, and whether no other pair of its B id has more."""
    entries = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("e.pairs", "e.times")
    counts = entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    counts = written(counts, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def frequent_level(counts: DataFrame, most_pairs: int) -> int:
    """Smallest power of two such that at most ``most_pairs`` pairs have that many links or more."""
    level = F.floor(F.log2("links")).cast("int").alias("level")  # exact for the powers that matter: counts below 2**50
    histogram = {r["level"]: r["count"] for r in counts.groupBy(level).count().collect()}  # at most 63 rows
    above = 0
    for k in sorted(histogram, reverse=True):
        above += histogram[k]
        if above > most_pairs:
            return 1 << (k + 1)
    return 1


def align_tokenizers(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    pairing: str = "end",
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``(<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per input row.

    A encodes space and text, B the text (and adds the space itself), without special tokens; their strings inside
    texts are plain text.  ``pairing`` says which tokens of a group are linked (``expand_links``).  ``n_best`` counts the links
    whose id pair has the most links of its B id corpus-wide (ties included), ``count_sum`` adds up the corpus-wide
    counts of the links' id pairs, ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.  A null or empty text,
    or one whose tokens do not give back space and text byte for byte, has no tokens: zeros and an empty digest.  Null and
    repeated ids keep their rows; an empty table gives an empty table.
    """
    if pairing not in ("end", "overlap"):
        raise ValueError("pairing is 'end' or 'overlap'")
    encoded = encoded_rows(docs, a_path, b_path, pairing, id_col, text_col)
    counts = written(pair_counts(encoded), "pair-ranks")
    level = frequent_level(counts, broadcast_pairs)
    entries = encoded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "row", F.col("e.pairs").alias("pair"), F.col("e.times").cast("long").alias("times")
    )
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    ]
    # Bounded by ``broadcast_pairs``; entries of a row lie together, so the partial sums leave one row per text and task.
    frequent = F.broadcast(counts.where(F.col("links") >= level))
    found = entries.join(frequent, "pair").groupBy("row").agg(*sums)
    if level > 1:
        rare = entries.join(frequent.select("pair"), "pair", "left_anti").join(counts.where(F.col("links") < level), "pair")
        found = found.union(rare.groupBy("row").agg(*sums)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    texts = encoded.drop("pairs", "times")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return texts.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
