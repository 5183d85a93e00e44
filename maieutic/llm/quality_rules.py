"""op4: quality rules with suffix-array repetition limits.

Words are turned into numbers and a suffix array is built over the words of a
slice of documents at once (prefix doubling; a suffix that has become unique
leaves the work, so clean text drops out after a few rounds).  Documents are
told apart in the first rank, so no repeat crosses a border.  Longest common
prefixes of neighbours in the suffix array give, for every position, the
longest repeated run of words that starts there; runs of at least
``min_repeat`` words are the maximal repeats.  The union of their spans is the covered
part of the text, and the verdict limits the covered fraction and the longest
repeat.

Everything happens within a document, so this is one pass over the scan
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import text_slices

SLICE_BYTES = 512 << 10

# Bytes that separate words, and the symbols that are counted.
_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_IN_WORD = np.ones(256, np.int64)  # first byte of a code point that is not a blank
_IN_WORD[0x80:0xC0] = 0
_IN_WORD[list(_BLANKS)] = 0
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(_SYMBOLS)] = 1


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeat_lengths(words: list[list[bytes]], min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(for every word of all texts in order the longest repeated run that starts there, texts' word counts).

    Runs shorter than ``min_repeat`` are given as 0.  Two places of a run may overlap.
    """
    counts = np.fromiter(map(len, words), np.int64, len(words))
    n = int(counts.sum())
    lengths = np.zeros(n, np.int64)
    if n == 0:
        return lengths, counts
    word = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(words)), np.int64, n)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)

    def refine(active: np.ndarray, rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split the groups of equal rank by ``second``; a rank is the place of its group's first suffix."""
        first = rank[active]
        order = np.lexsort((second, first))
        a, f, s = active[order], first[order], second[order]
        place = np.arange(len(a))
        new_group = np.ones(len(a), bool)
        new_group[1:] = f[1:] != f[:-1]
        new_part = new_group.copy()
        new_part[1:] |= s[1:] != s[:-1]
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        part_at = np.maximum.accumulate(np.where(new_part, place, 0))
        rank = rank.copy()
        rank[a] = f + (part_at - group_at)
        alone = new_part & np.append(new_part[1:], True)
        return rank, a[~alone]

    # One level per doubling is kept for the LCPs, in 32 bits: no text has 2**31 words.
    rank, active = refine(np.arange(n), np.zeros(n, np.int32), text * (int(word.max()) + 1) + word)
    levels, h, repeated = [rank], 1, active
    while len(active):
        second = np.full(len(active), -1, np.int32)
        inside = active + h < ends[active]
        second[inside] = rank[active[inside] + h]
        rank, active = refine(active, rank, second)
        levels.append(rank)
        h *= 2
        if h <= min_repeat:  # only suffixes that share this many words with another matter
            repeated = active
    if not len(repeated):
        return lengths, counts
    # The part of the suffix array whose suffixes share enough words with another one, and its LCPs.
    sa = repeated[np.argsort(rank[repeated], kind="stable")]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at_a, at_b = a + lcp, b + lcp
        fits = (at_a < ends[a]) & (at_b < ends[b]) & (text[a] == text[b])
        same = np.zeros(len(a), bool)
        same[fits] = levels[k][at_a[fits]] == levels[k][at_b[fits]]
        lcp[same] += 1 << k
    lcp[lcp < min_repeat] = 0
    lengths[a] = lcp
    lengths[b] = np.maximum(lengths[b], lcp)
    return lengths, counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    edges = np.concatenate([[0], np.cumsum(counts)])
    running = np.concatenate([[0], np.cumsum(values)])
    return running[edges[1:]] - running[edges[:-1]]


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text; ``longest_repeat`` in words (0: none of ``min_repeat``)."""
    words = [t.split() for t in texts]
    lengths, counts = repeat_lengths(words, min_repeat)
    owner = np.repeat(np.arange(len(counts)), counts)
    edge = np.zeros(len(lengths) + 1, np.int64)
    starts = np.flatnonzero(lengths)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    covered = np.cumsum(edge[:-1]) > 0
    longest = np.zeros(len(counts), np.int64)
    np.maximum.at(longest, owner[starts], lengths[starts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": counts,
        "word_chars": _sums(_IN_WORD[data], sizes),
        "n_symbols": _sums(_IS_SYMBOL[data], sizes),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _sums(covered.astype(np.int64), counts),
        "longest_repeat": longest,
    }


def judge_quality(
    docs: DataFrame,
    min_words: int = 20,
    min_repeat: int = 8,
    max_repeat_pct: int = 30,
    max_covered_pct: int = 30,
    max_longest_pct: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_columns: bool = False,
    verdict_col: str = "kept",
) -> DataFrame:
    """One row per input row: ``(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    longest_repeat, base_failed, kept)``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_pct``
    percent of them in repeated runs of ``min_repeat`` words.  ``kept``: not failed,
    repeats cover at most ``max_covered_pct`` percent of the words, and the longest one
    spans at most ``max_longest_pct`` percent.  A null or empty text has no words
    and fails.  Null and repeated ids keep their rows.  With ``keep_columns`` the rows are the
    input's own columns plus the verdict under ``verdict_col`` (which replaces an input column of that name).
    """
    columns = [c for c in docs.columns if c != verdict_col] if keep_columns else [id_col]
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]

    plain = [f"c{i}" for i in range(len(columns))]  # Arrow functions take no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_BYTES):
                m = measure(texts, min_repeat)
                n, repeats = m["n_words"], m["n_repeat_words"] * 100
                failed = (n < min_words) | (repeats > max_repeat_pct * n)
                kept = ~failed & (repeats <= max_covered_pct * n) & (m["longest_repeat"] * 100 <= max_longest_pct * n)
                own = [part.column(i) for i in range(len(columns))]
                if keep_columns:
                    yield pa.record_batch([*own, pa.array(kept)], names=[*plain, "kept"])
                else:
                    found = [pa.array(m[c], pa.int64()) for c in counted]
                    yield pa.record_batch([*own, *found, pa.array(failed), pa.array(kept)], names=[*plain, *counted, "base_failed", "kept"])

    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain)], F.col(f"`{text_col}`").alias("text"))
    fields = [f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, own.schema)]
    if not keep_columns:
        fields += [f"{c} bigint" for c in counted] + ["base_failed boolean"]
    found = rows.mapInArrow(run, ", ".join([*fields, "kept boolean"]))
    return found.toDF(*columns, *([] if keep_columns else [*counted, "base_failed"]), verdict_col)
