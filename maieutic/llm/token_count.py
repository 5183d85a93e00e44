"""op2: token counts with the whole-token shortcut.

A vocabulary string is *whole* if the tokenizer, given that string alone,
answers with exactly one token.  Which strings are whole is proved once on the
driver by encoding every vocabulary entry (``prove_whole_tokens``); the proof is
bounded by the vocabulary.  A text is cut into pre-tokens; a whole pre-token
counts as one, and only the remaining pre-tokens go through the merges of the
tokenizer, each distinct word once per slice of texts, repeated ones once per task while its memo lasts.

Pre-tokens are cut here only for texts made of code points below U+0250 whose
small letters lie there, too (not so U+0130 and 23 other capitals), where normal
form C is the identity, lower-casing is per character and the letter and number
classes are fixed.  Any other text, and
any text that holds the string of an added token, is encoded whole by the
library itself.  Both ways give the library's ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import compress
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# The splitting pattern of the public vocabulary file, with its
# Unicode classes written out for code points below U+0250.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085 "
_PIECES = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
# U+001C to U+001F are blanks for ``str.split`` but not for the pattern; U+0130 and 23 capitals lower to something beyond U+024F.
_PLAIN = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x250)) if not "\x1c" <= c <= "\x1f" and max(c.lower()) < "\u0250") + "]*")
# The pattern and normalizers that the cutting above stands for.
_EXPECTED_SPLIT = _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_EXPECTED_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_ID = attrgetter("id")

# Distinct blank-separated words a worker remembers within a task, and their characters; memory bounds only.
WORD_CACHE = 100_000
WORD_CACHE_CHARS = 4 << 20
# Bytes of text whose words are told apart at once; a memory bound only.
SLICE_BYTES = 8 << 20


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed rule, not a table)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def prove_whole_tokens(path: str) -> dict[str, int]:
    """{pre-token: id} of the vocabulary strings that, encoded alone, give one token.

    Raises if the file's splitting rule is not the one ``_PIECES`` stands for.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splits = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if splits != [_EXPECTED_SPLIT] or kinds != _EXPECTED_NORMALIZERS:
        raise ValueError(f"{os.path.basename(path)}: no pre-token rule for its normalizer and splitter")
    tokenizer = load_tokenizer(path)
    end = spec["model"].get("end_of_word_suffix") or ""
    alphabet = _byte_alphabet()
    strings = []
    for entry in spec["model"]["vocab"]:
        if not entry.endswith(end):
            continue
        raw = bytes(alphabet.get(c, 0) for c in entry[: len(entry) - len(end)])
        text = raw.decode("utf-8", "replace")
        if _PIECES.fullmatch(text) and _PLAIN.fullmatch(text):
            strings.append(text)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(strings, encoded) if len(e.ids) == 1}


class PieceTokenizer:
    """Ids of texts by pre-token; one per Python worker and vocabulary file.

    No pre-token crosses a blank, so texts are cut into blank-separated words, and the splitting pattern and the
    merges run once per distinct word of a slice of texts.  The memo keeps words that repeat for later slices.
    """

    _instances: dict[tuple[str, int], "PieceTokenizer"] = {}

    def __init__(self, path: str, whole: dict[str, int], width: int):
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.whole = whole
        self.width = width
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.shown = {b: c for c, b in _byte_alphabet().items()}
        self.forget()

    @classmethod
    def of(cls, path: str, whole: dict[str, int], width: int) -> "PieceTokenizer":
        """The worker's instance for a vocabulary file and a number of bytes per id (2 or 4); counts and ids share its memo."""
        key = (path, width)
        if key not in cls._instances:
            cls._instances[key] = cls(path, whole, width)
        return cls._instances[key]

    def forget(self) -> None:
        """Let the memo go; a task does so at its end, because Spark keeps its workers for other work."""
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def pack(self, ids: list[int]) -> bytes:
        """Ids as little-endian numbers of ``width`` bytes."""
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def plain(self, text: str) -> bool:
        """Whether a text may be cut here; any other goes to the library."""
        return _PLAIN.fullmatch(text) is not None and not (self.added and self.added.search(text))

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_word(self, word: str) -> list[int]:
        """Whole pre-tokens by the shortcut, the rest by the model's merges."""
        # Below U+0250 the letters of Python and of the pattern are the same.
        pieces = [word] if word.isalpha() else _PIECES.findall(word)
        ids: list[int] = []
        for piece in pieces:
            one = self.whole.get(piece)
            if one is not None:
                ids.append(one)
                continue
            if not (piece.isascii() and piece.isprintable()):  # printable ASCII stands for itself
                piece = "".join(map(self.shown.__getitem__, piece.encode()))
            ids += map(_ID, self.model.tokenize(piece))
        return ids

    def encode_many(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of each text, none of a null one."""
        plain = [bool(text) and self.plain(text) for text in texts]
        distinct, places, ends = _numbered_words(compress(texts, plain))
        found = list(map(self.memo.get, distinct))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.pack(self.encode_word(distinct[i]))
        self._remember(distinct, found, np.bincount(places.to_numpy(), minlength=len(distinct)) > 1)
        each = pa.array(found, pa.large_binary()).take(places)
        del distinct, found, places
        _, upto, data = each.buffers()
        upto, data = np.frombuffer(upto, np.int64)[each.offset :][ends].tolist(), memoryview(data or b"")
        cut = (bytes(data[start:end]) for start, end in zip(upto, upto[1:]))
        return [next(cut) if easy else self.pack(self.encode_whole(text)) if text else b"" for text, easy in zip(texts, plain)]

    def _remember(self, words: list[str], packed: list[bytes], repeated: np.ndarray) -> None:
        """Keep the words that repeat, as far as there is room; a full memo begins anew with them."""
        if len(self.memo) >= WORD_CACHE or self.held >= WORD_CACHE_CHARS:
            self.forget()
        for word, ids in compress(zip(words, packed), repeated.tolist()):
            if len(self.memo) >= WORD_CACHE or self.held >= WORD_CACHE_CHARS:
                break
            if word not in self.memo:
                self.memo[word] = ids
                self.held += len(word)

    def encode_packed(self, text: str) -> bytes:
        """Packed ids of a text."""
        return self.encode_many([text])[0]

    def count_many(self, texts: Sequence[str | None]) -> list[int]:
        return [len(ids) // self.width for ids in self.encode_many(texts)]

    def count(self, text: str) -> int:
        return self.count_many([text])[0]


def _numbered_words(texts: Iterable[str]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The distinct lower-cased blank-separated words of texts, the number of each word in turn, and how many words each text ends at.

    Blanks are those of ``str.split`` below U+0250; one at an end of a text gives an empty word, which has no ids.
    """
    words = pc.utf8_split_whitespace(pa.array([text.lower() for text in texts], pa.large_string()))
    numbered = words.values.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices, words.offsets.to_numpy()


def text_slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in order, some ``SLICE_BYTES`` at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield texts.slice(start, end - start).to_pylist()


def id_width(path: str, *more_ids: int) -> int:
    """Bytes per id that hold every id of a vocabulary and ``more_ids``: 2 or 4."""
    top = max(load_tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, *more_ids)
    return 2 if top < 1 << 16 else 4


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, n_bytes, n_tokens, over_limit)``, one row per input row.

    Counts are the library's, without added begin, end or special tokens.  A
    null or empty text has 0 bytes and 0 tokens; null and repeated ids keep
    their rows; a text is encoded whole, whatever its length; an empty table
    gives an empty table.  No shuffle: the work is one pass over the scan.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))  # bounded by the vocabulary
    width = id_width(tokenizer_path, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceTokenizer.of(tokenizer_path, whole.value, width)
        try:
            for batch in batches:
                tokens = [n for texts in text_slices(batch.column(1)) for n in counter.count_many(texts)]
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
                yield pa.record_batch(
                    [batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )
        finally:
            counter.forget()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
