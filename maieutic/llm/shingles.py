"""Word and shingle hashing shared by the task-side (Arrow batch) operators, over whole batches of bytes.

Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased.  The
hash of a word is a polynomial of its bytes modulo 2**64, taken from running
sums, and mixed; the hash of a shingle mixes the hashes of its words in order.
Nothing here depends on a process (no salted ``hash``), so every task, retry
and rerun gives the same numbers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)
_MULTIPLIER = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True

_STRETCH = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    tables = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of them.

    Tables of ``_STRETCH`` are kept by the worker; longer ones, for a single longer word, are not.
    """
    if n > _STRETCH + 1:
        return tuple(_power_tables(n))
    if not _powers:
        _powers.extend(_power_tables(_STRETCH + 1))
    return _powers[0], _powers[1]


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) times the power of its place; slices of these give the hash of any substring."""
    up, _ = power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping arithmetic)."""
    x = x ^ (x >> _SHIFT)
    x = x * _MULT
    return x ^ (x >> _SHIFT)


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes of all texts, each followed by a line feed
    starts: np.ndarray  # first byte of each word in ``data``
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray
    counts: np.ndarray  # words per text
    offsets: np.ndarray  # first byte of each text in ``data``


def find_words(texts: list[bytes]) -> Words:
    """The words of a batch of texts."""
    data = _LOWER[np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    starts = np.flatnonzero(before & ~blank)
    ends = np.flatnonzero(blank & ~before)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # a stretch of whole words at a time, so long texts need no long tables
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _STRETCH, "right")))
        base = starts[i]
        sums = running_sums(data[base : ends[j - 1]])
        _, down = power_tables(len(sums))
        a, b = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(data, starts, ends, hashes, counts, offsets[:-1])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (the last ``size - 1`` places wrap and mean nothing)."""
    acc = np.full(len(hashes), size, np.uint64)
    for k in range(size):
        acc = mix(acc * _STEP + np.roll(hashes, -k))
    return acc


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes sorted and distinct within each text, number of them per text).

    A text with fewer than ``size`` words, but not none, has its whole word
    sequence as its one shingle (mixed with its length, so it never equals a
    full shingle).  A text without words has the empty set.
    """
    words = find_words(texts)
    full = shingle_hashes(words.hashes, size)
    first = np.concatenate([[0], np.cumsum(words.counts)])
    sets = []
    for a, n in zip(first.tolist(), words.counts.tolist()):
        if n >= size:
            sets.append(np.unique(full[a : a + n - size + 1]))
        elif n:
            acc = np.array([n + (size << 32)], np.uint64)
            for h in words.hashes[a : a + n]:
                acc = mix(acc * _STEP + h)
            sets.append(acc)
        else:
            sets.append(full[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else full), sizes
