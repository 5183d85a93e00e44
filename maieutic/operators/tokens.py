"""Token arrays for training: offsets, vocabulary, ids, labels, padding, blocks, checks.

The built-in tokenizer is a word/punctuation splitter (``\\w+`` runs and single
other non-space characters) with character offsets, a vocabulary built from
the data and lookup joins.  Operators that tokenise take a ``tokenizer`` argument: a
function from a text column to an array-of-strings column, or a ``Tokenizer``, which also says where in the text each token
stands and how tokens become text again.  A user's own one (for example a subword
tokenizer) is wrapped by ``pandas_tokenizer`` or ``offset_tokenizer`` as an Arrow-batched UDF.

Scale notes
* Token streams with offsets (``token_offsets``) are exploded after the raw rows were dealt out by their id, so
  the exchange carries each text once and the regrouping needs no further one.
* The vocabulary is a map-side combined count of all tokens.  Ids follow (count
  descending, md5, token): places come from sums per count and hash bucket, so no task
  orders the whole vocabulary.
* Lookups split by frequency: a vocabulary's ids begin with its most frequent tokens, so the entries of the first
  ``HOT_ENTRIES`` ids are met array by array in Arrow batches, without a row per token.  Only the others are exploded: the next
  ``WARM_ENTRIES`` entries are broadcast (bounded tables, both), the rare rest is joined by shuffle, where no key is hot any more.
* ``in_place`` keeps what is shuffled small: rows are dealt by their id once, the tasks hold the warm entries as well, and only the
  items behind them travel to the vocabulary and back.
* User tokenizers get a batch in slices of ``SLICE_CHARS`` characters, so a worker holds the tokens of one slice, not of a batch.
* Everything after ids (labels, padding, masks, spans, checks) is in-row
  array work with higher-order functions: no shuffle.
* Row ids must be unique where tokens are regrouped by them; a repeated id stops the query with an error
  instead of mixing two rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maieutic.functions.text_rules import BLANKS, java_regex
from maieutic.session import scratch_table

# ---------------------------------------------------------------------------
# Label sentinel and block size of the causal-LM chunking.
IGNORE_INDEX = -100
CLM_BLOCK_SIZE = 512
# ---------------------------------------------------------------------------

# Our tokenizer: optional leading whitespace, then a word or one other character.
WORD_TOKEN_PATTERN = r"\s*(\w+|[^\w\s])"
WORD_TOKEN_REGEX = java_regex(WORD_TOKEN_PATTERN)

PAD, UNK, CLS, SEP, EOS = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[EOS]"
ROLE_TAGS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
SPECIAL_TOKENS = [PAD, UNK, CLS, SEP, EOS, *ROLE_TAGS.values()]
PAD_ID, UNK_ID, CLS_ID, SEP_ID, EOS_ID = range(5)
#: Vocabulary entries that tasks hold in a lookup, and entries behind them that a broadcast join meets; all others are joined by shuffle.
HOT_ENTRIES = 10_000
WARM_ENTRIES = 100_000
#: Characters that a user's tokenizer gets at once (one longer text is a slice of its own).
SLICE_CHARS = 1 << 20
ROLE_TAG_IDS = {role: SPECIAL_TOKENS.index(tag) for role, tag in ROLE_TAGS.items()}


def _dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw rows by the hash of their id, before anything is exploded."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- W5: tokens with character offsets ---------------------------------------
def token_offsets(df: DataFrame, id_col: str, text_col: str = "text", lower: bool = True) -> DataFrame:
    """``(id, pos, token, start, end)``: one row per token, offsets in code points.

    ``end`` is the running sum of the matched piece lengths (leading
    whitespace included); ``start = end - length(token)``.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_TOKEN_REGEX), 0)
    ex = _dealt(df.select(id_col, text_col), [id_col]).select(id_col, F.posexplode(pieces).alias("pos", "_p"))
    order = Window.partitionBy(id_col).orderBy("pos")
    end = F.sum(F.length("_p")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    token = F.ltrim(F.col("_p"), F.lit(BLANKS))
    once = F.when(F.row_number().over(order) == F.col("pos") + 1, F.col("pos")).otherwise(_repeated_id(id_col).cast("int"))
    return ex.select(
        id_col,
        once.cast("int").alias("pos"),
        (F.lower(token) if lower else token).alias("token"),
        (end - F.length(token)).cast("int").alias("start"),
        end.alias("end"),
    )


def _repeated_id(*keys: str) -> Column:
    return F.raise_error(F.lit(f"two rows share one id ({', '.join(keys)}); token operators need unique ids"))


def word_tokens(text: Column, lower: bool = True) -> Column:
    """Token strings of a text as an array, in order (no offsets, no shuffle)."""
    t = F.coalesce(text, F.lit(""))
    if lower:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(WORD_TOKEN_REGEX), 1)


# --- U5: pluggable tokenizers ---------------------------------------------------
_SPANS = "array<struct<token:string,start:int,end:int>>"


def space_joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer of the user's.

    ``spans``: text column -> ``array<struct<token, start, end>>`` in text order, ``start`` and ``end`` in characters of the
    text as it is given, whatever the tokenizer normalises; a null text has no tokens.  ``join``: array of tokens -> text.
    Called like the plain function it gives the tokens alone.
    """

    spans: Callable[[Column], Column]
    join: Callable[[Column], Column] = space_joined

    def __call__(self, text: Column) -> Column:
        return F.transform(self.spans(text), lambda s: s["token"])


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_CHARS`` characters together."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_CHARS:
            yield start, i
            start, held = i, 0
        held += n
    yield start, len(sizes)


def pandas_tokenizer(fn) -> Callable[[Column], Column]:
    """A user tokenizer (``pandas.Series`` of texts -> ``Series`` of token lists) for the ``tokenizer`` arguments."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for i, j in _slices([len(t) if t else 0 for t in texts]):
                yield fn(texts.iloc[i:j].reset_index(drop=True))

    return F.pandas_udf(run, "array<string>")


def offset_tokenizer(fn, join: Callable[[Column], Column] = space_joined) -> Tokenizer:
    """A ``Tokenizer`` from a user's function of one text -> list of ``(token, start, end)``, run on Arrow batches."""

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            for i, j in _slices([len(t) if t else 0 for t in texts]):
                yield _span_lists([fn(t) if t else [] for t in texts[i:j]])

    return Tokenizer(F.arrow_udf(spans, _SPANS), join)


def _span_lists(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    """Lists of ``(token, start, end)`` as one Arrow array of lists of structs."""
    edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    columns = [pa.array([t[k] for x in found for t in x], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(columns, ["token", "start", "end"]))


def aligned(text: str, normalise: Callable[[str], str]) -> tuple[str, list[int]]:
    """A text normalised character by character, and for each resulting character the one it comes from."""
    out, origin = [], []
    for i, c in enumerate(text):
        new = normalise(c)
        out.append(new)
        origin += [i] * len(new)
    return "".join(out), origin


def _without_accents(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()


# Letters of a word, or a single other character; blanks part them.
_UNCASED = re.compile(r"[^\W_]+|[^\w\s]|_")


class _Plain(dict):
    """Normal forms by code point, found when they are first asked for (as many as there are characters at most)."""

    def __missing__(self, code: int) -> str:
        self[code] = _without_accents(chr(code))
        return self[code]


_PLAIN = _Plain()


def uncased_spans(text: str) -> list[tuple[str, int, int]]:
    """Tokens without case and accents, punctuation apart; ``start`` and ``end`` count characters of the text itself."""
    if all(len(_PLAIN[ord(c)]) == 1 for c in set(text)):  # every character stays one: places are those of the text
        return [(m[0], *m.span()) for m in _UNCASED.finditer(text.translate(_PLAIN))]
    plain, origin = aligned(text, _without_accents)
    origin.append(len(text))
    # What comes to nothing, such as a combining accent, belongs to the character before it.
    return [(m[0], origin[m.start()], max(origin[m.end() - 1] + 1, origin[m.end()])) for m in _UNCASED.finditer(plain)]


def uncased_tokenizer() -> Tokenizer:
    """Lower case, without accents, every punctuation mark a token of its own: the basic step of uncased subword models."""
    return offset_tokenizer(uncased_spans)


def library_tokenizer(path: str) -> Tokenizer:
    """A tokenizer file of the ``tokenizers`` library: its tokens, its offsets and its decoder, without special tokens.

    The file must be where the workers can read it; each worker loads it once.
    """

    def load():
        from tokenizers import Tokenizer as Library

        if path not in _LIBRARY:
            _LIBRARY[path] = Library.from_file(path)
        return _LIBRARY[path]

    def spans(texts: pd.Series) -> pd.Series:
        found = load().encode_batch([x or "" for x in texts], add_special_tokens=False)
        return pd.Series([[{"token": t, "start": a, "end": b} for t, (a, b) in zip(e.tokens, e.offsets)] for e in found])

    def join(tokens: pd.Series) -> pd.Series:
        decoder = load().decoder
        return pd.Series([None if t is None else decoder.decode(list(t)) if decoder is not None else " ".join(t) for t in tokens])

    return Tokenizer(F.pandas_udf(spans, _SPANS), F.pandas_udf(join, "string"))


_LIBRARY: dict = {}


# --- J6: vocabulary and ids ---------------------------------------------------
def _counter(batches, capacity: int):
    """Misra-Gries counts of one task: ``(token, count)`` of at most ``capacity`` tokens, and ``(null, loss)``.

    A token's count is too small by at most the loss, and a token that is missing has at most that many.
    """
    counts: dict[str, int] = {}
    loss = 0
    for batch in batches:
        values = batch.column(0).flatten().value_counts()
        for token, n in zip(values.field("values").to_pylist(), values.field("counts").to_pylist()):
            if token is not None:
                counts[token] = counts.get(token, 0) + n
        if len(counts) > 2 * capacity:
            # Everything above the capacity-th count stays, less that count.
            cut = heapq.nlargest(capacity + 1, counts.values())[-1]
            loss += cut
            counts = {t: n - cut for t, n in counts.items() if n > cut}
    yield pa.record_batch(
        [pa.array([*counts, None], pa.string()), pa.array([*counts.values(), loss], pa.int64())], names=["token", "count"]
    )


def frequent_tokens(token_arrays: DataFrame, size: int, tokens_col: str = "tokens", capacity: int | None = None) -> DataFrame:
    """``(token, count)``: candidates that hold the ``size`` most frequent tokens, with exact counts.

    One pass keeps a bounded summary per task (heavy hitters), so not all distinct tokens are shuffled; the second counts the candidates
    alone.  It is proved on the way: no token outside of them has more than the summed loss of the tasks, and the ``size``-th
    candidate must have more than that, so that ties are complete, too.  If not, the summaries are taken again four times as large; a
    summary that lost nothing is the whole count.
    """
    capacity = capacity or max(4 * size, 50_000)
    lists = token_arrays.select(tokens_col)
    while True:
        keep = capacity
        summary = lists.mapInArrow(lambda batches: _counter(batches, keep), "token string, count bigint")
        merged = scratch_table(summary.groupBy("token").agg(F.sum("count").alias("count")), "frequent")
        loss = merged.where("token IS NULL").agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        held = merged.where("token IS NOT NULL")
        if not loss:
            return held
        candidates = held.select("token")
        words = lists.select(F.explode(tokens_col).alias("token"))
        counted = scratch_table(words.join(candidates, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("count")), "counted")
        last = counted.orderBy(F.desc("count")).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
        if last["n"] == size and last["least"] > loss:
            return counted
        capacity *= 4


def build_vocab(token_arrays: DataFrame, tokens_col: str = "tokens", size: int | None = None) -> DataFrame:
    """``(token, id, is_special)``: specials first, then all tokens, or the ``size`` most frequent ones.

    Tokens are ordered by count (descending), then md5, then token.  With ``size`` only candidates are
    counted (``frequent_tokens``); the result is that of the full count.  It is written at once and read back.
    """
    if size is not None:
        counts = frequent_tokens(token_arrays, size, tokens_col)
    else:
        counts = token_arrays.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
        counts = scratch_table(counts, "token-counts", drop_shuffles=True)  # read twice below, made once
    counts = counts.select("token", "count", F.substring(F.md5("token"), 1, 3).alias("_b"))
    per_bucket = counts.groupBy("count", "_b").agg(F.count(F.lit(1)).alias("n"))
    per_count = per_bucket.groupBy("count").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_count = per_count.select("count", so_far(Window.orderBy(F.desc("count"))).alias("_above"))
    per_bucket = per_bucket.select("count", "_b", so_far(Window.partitionBy("count").orderBy("_b")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("count", "_b").orderBy(F.md5("token"), "token"))
    ranked = (
        counts.join(per_bucket.join(per_count, "count"), ["count", "_b"])
        .select("token", (F.col("_above") + F.col("_before") + place - 1 + len(SPECIAL_TOKENS)).cast("int").alias("id"))
    )
    if size is not None:
        ranked = ranked.where(F.col("id") < size + len(SPECIAL_TOKENS))
    spark = token_arrays.sparkSession
    specials = spark.createDataFrame([(t, i, True) for i, t in enumerate(SPECIAL_TOKENS)], "token string, id int, is_special boolean")
    # Lookups read it several times.
    return scratch_table(specials.unionByName(ranked.select("token", "id", F.lit(False).alias("is_special"))), "vocabulary", drop_shuffles=True)


def _list_slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches of lists in slices of about ``SLICE_CHARS`` items, which bounds what a worker holds besides a batch."""
    for lists in batches:
        for i, j in _slices(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()):
            yield lists.slice(i, j - i)


def _known_and_rare(lists: pa.Array, flat: pa.Array, found: np.ndarray) -> pa.Array:
    """Per row its ``slots`` (the number found, or -k for the k-th item without one) and its ``rare`` items, those without one.

    ``flat``: the items of all rows, ``found``: a number of each, negative where there is none.
    """
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    rare = found < 0
    seen = np.concatenate([[0], np.cumsum(rare)])
    place = seen[1:] - np.repeat(seen[edges[:-1]], np.diff(edges))
    slots = pa.array(np.where(rare, -place, found), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(edges.astype(np.int32), slots),
         pa.ListArray.from_arrays(seen[edges].astype(np.int32), flat.filter(pa.array(rare)))], ["slots", "rare"])


def _tiers(number: Column) -> tuple[Column, Column]:
    """Which entries are hot (held by the tasks) and which warm (broadcast); ids begin with the frequent tokens."""
    edge = len(SPECIAL_TOKENS) + HOT_ENTRIES
    return (number >= 0) & (number < edge), (number >= edge) & (number < edge + WARM_ENTRIES)


def _held(number: Column, in_place: bool) -> Column:
    """Which entries the tasks hold."""
    hot, warm = _tiers(number)
    return hot | warm if in_place else hot


def _regrouped(out: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``(keys, carry, _late)`` of groups with the list ``_done`` of what their rows carry; a key that two rows share is an error."""
    done = F.get("_done", 0)
    once = F.when(F.size("_done") == 1, done).otherwise(_repeated_id(*keys).cast(out.select(done).schema[0].dataType))
    out = out.select(*keys, once.alias("_done"), "_late")
    return out.select(*keys, *(F.col(f"_done.{c}").alias(c) for c in carry), "_late")


def _late_entries(rows: DataFrame, keys: Sequence[str], rare: str, by: str, table: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Meet each row's ``rare`` items with ``table`` (without its hot entries): ``(keys, carry, _late)``.

    ``_late`` is an array of ``struct<_i, _v>``, one for each item; ``_v`` holds the table's other columns, null where it lacks the item.  The
    first piece of a row takes what it carries along, so the rows are made once.  A key that two rows share is an error.
    """
    values = [c for c in table.columns if c != by]
    _, warm = _tiers(F.col("_id"))
    hot, _ = _tiers(F.col("_id"))
    pieces = rows.select(*keys, F.struct(*carry).alias("_done"), F.posexplode_outer(rare).alias("_i", "_by"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    pieces = pieces.select(*keys, F.when(first, F.col("_done")).alias("_done"), "_i", "_by")
    near = table.where(warm).select(F.col(by).alias("_by"), F.struct(*values).alias("_near"))
    pieces = pieces.join(F.broadcast(near), "_by", "left")
    # What is met already, and a row without a rare item, meets nothing; a number of its own keeps such pieces from sharing one key.
    open_ = F.col("_near").isNull() & F.col("_by").isNotNull()
    pieces = pieces.withColumn("_h", F.when(open_, F.xxhash64("_by")).otherwise(F.xxhash64(*keys, "_i")))
    far = table.where(~hot & ~warm).select(F.xxhash64(by).alias("_g"), F.col(by).alias("_key"), F.struct(*values).alias("_far"))
    met = pieces.join(far, (F.col("_h") == F.col("_g")) & (F.col("_by") == F.col("_key")), "left")
    entry = F.struct("_i", F.coalesce("_near", "_far").alias("_v"))
    # One piece of a row has what is done; a list takes it as it is, where ``first`` would copy it for every piece.
    out = met.groupBy(*keys).agg(
        F.collect_list("_done").alias("_done"),
        F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), entry))).alias("_late"),
    )
    return _regrouped(out, keys, carry)


def _late_in_place(rows: DataFrame, keys: Sequence[str], rare: str, by: str, table: DataFrame, carry: Sequence[str]) -> DataFrame:
    """What ``_late_entries`` gives for ``rows`` that are dealt by their keys: they wait there, and only their ``rare`` items travel.

    The tasks hold the warm entries, too; what is behind them goes to the table by hash and back to its row by the keys.  ``carry`` are
    arrays, no rare item is null.  Both readings of the rows use all columns, so Spark finds the same exchange in them and makes it once.
    """
    values = [c for c in table.columns if c != by]
    whole = reduce(and_, (F.size(c) >= 0 for c in carry))
    # Outer, as Spark would otherwise ask first which rows have items.
    pieces = rows.select(*keys, F.posexplode_outer(F.when(whole, F.col(rare))).alias("_i", "_by")).where(F.col("_i").isNotNull())
    far = table.where(~_held(F.col("_id"), True)).select(F.col(by).alias("_key"), *(F.col(c).alias(f"_v{c}") for c in values))
    met = pieces.join(far, F.col("_by") == F.col("_key"), "left")
    # Plain columns take less room in an exchange than structs.
    met = _dealt(met.select(*keys, "_i", *(f"_v{c}" for c in values)), keys)
    met = met.select(*keys, F.struct("_i", F.struct(*(F.col(f"_v{c}").alias(c) for c in values)).alias("_v")).alias("_late"))
    # Both sides are dealt alike, so their union is grouped where it is.
    both = rows.select(*keys, F.struct(*carry, rare).alias("_done")).unionByName(met, allowMissingColumns=True)
    out = both.groupBy(*keys).agg(F.collect_list("_done").alias("_done"), F.array_sort(F.collect_list("_late")).alias("_late"))
    return _regrouped(out, keys, carry)


def _looked_up(rows: DataFrame, keys: Sequence[str], carry: Sequence[str], tokens: str, vocab: DataFrame, in_place: bool = False) -> DataFrame:
    """Ids of each row's array of ``tokens``: ``(keys, carry, _ids)``; UNK where the vocabulary lacks one."""
    table = vocab.where(~F.col("is_special")).select("token", F.col("id").alias("_id"))
    top = table.where(_held(F.col("_id"), in_place)).toPandas()  # bounded by HOT_ENTRIES, and WARM_ENTRIES in place
    held = rows.sparkSession.sparkContext.broadcast((top["token"].tolist(), top["_id"].tolist()))

    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, ids = held.value
        names, ids = pa.array(names, pa.string()), np.array([*ids, -1], np.int64)
        for lists in _list_slices(batches):
            flat = lists.flatten().cast(pa.string())
            at = pc.fill_null(pc.index_in(flat, value_set=names, skip_nulls=True), len(names)).to_numpy(zero_copy_only=False)
            found = ids[at]
            if in_place:
                found = np.where(flat.is_null().to_numpy(zero_copy_only=False), UNK_ID, found)
            yield _known_and_rare(lists, flat, found)

    split = F.arrow_udf(known, "struct<slots:array<int>,rare:array<string>>")
    rows = rows.select(*keys, *carry, split(tokens).alias("_k")).select(*keys, *carry, F.col("_k.slots").alias("_slots"), F.col("_k.rare").alias("_rare"))
    carry = [*carry, "_slots"]
    if in_place:
        met = _late_in_place(_dealt(rows, keys), keys, "_rare", "token", table, carry)
    else:
        met = _late_entries(rows, keys, "_rare", "token", table, carry)
    late = lambda x: F.get(F.col("_late"), -x - 1)["_v"]["_id"]
    ids = F.transform("_slots", lambda x: F.when(x >= 0, x).otherwise(F.coalesce(late(x), F.lit(UNK_ID))))
    return met.select(*keys, *carry[:-1], ids.alias("_ids"))


def encode(df: DataFrame, id_col, tokens_col, vocab: DataFrame, out_col="ids", in_place: bool = False) -> DataFrame:
    """Token arrays to id arrays with UNK fallback.

    ``tokens_col`` and ``out_col`` may be lists of the same length: all parts of an
    example are then encoded in one pass.  Rows with no token get empty arrays.
    The vocabulary's hot entries are fetched at once, so it should be a written table (as ``build_vocab`` gives it).
    ``in_place`` deals the rows by their id, once, and leaves them there (``_late_in_place``): less disk than to carry them through the joins.
    """
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    parts = [tokens_col] if isinstance(tokens_col, str) else list(tokens_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    rows = df.select(*keys, F.array(*map(F.size, parts)).alias("_sizes"), F.concat(*parts).alias("_t"))
    looked = _looked_up(rows, keys, ["_sizes"], "_t", vocab, in_place)
    cuts, before = [], F.lit(0)
    for i, name in enumerate(outs):
        cuts.append(F.slice("_ids", before + 1, F.col("_sizes")[i]).alias(name))
        before = before + F.col("_sizes")[i]
    return looked.select(*keys, *cuts)


def _ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Running sums of each row's numbers."""
    for lists in batches:
        edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        sums = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        ends = sums[1:] - np.repeat(sums[edges[:-1]], np.diff(edges))
        yield pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(ends, pa.int32()))


def encode_with_offsets(df: DataFrame, id_col: str, lead_col: str, text_col: str, vocab: DataFrame,
                        tokenizer: Callable[[Column], Column] | None = None, keep: int | None = None) -> DataFrame:
    """``(id, lead, context)`` from one cut of each text: ids of ``lead_col`` and ``array<struct<id, start, end>>`` of ``text_col``.

    The built-in tokenizer cuts both (offsets are running sums over its pieces, which hold the blanks before a token);
    a ``Tokenizer`` gives its own offsets.  A plain function knows none: it cuts the lead, the built-in one the text.
    Texts are cut whole; with ``keep`` only the first so many tokens of the context are looked up and come out.
    """
    lead = (tokenizer or word_tokens)(F.col(lead_col))
    first = lambda c: c if keep is None else F.slice(c, 1, keep)
    own = isinstance(tokenizer, Tokenizer)
    if own:
        context = first(F.coalesce(tokenizer.spans(F.col(text_col)), F.array().cast(_SPANS)))
    else:
        pieces = first(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_TOKEN_REGEX), 0))
        bare = lambda p: F.ltrim(p, F.lit(BLANKS))
        context = F.transform(pieces, lambda p: F.struct(F.lower(bare(p)).alias("token"), F.length(bare(p)).alias("start"), F.length(p).alias("end")))
    rows = _dealt(df.select(id_col, lead_col, text_col), [id_col]).select(
        id_col, F.coalesce(lead, F.array().cast("array<string>")).alias("_l"), context.alias("_c")
    )
    ends = F.col("_c.end") if own else F.arrow_udf(_ends, "array<int>")(F.col("_c.end"))
    rows = rows.select(
        id_col, F.size("_l").alias("_lead"), F.concat("_l", "_c.token").alias("_t"), F.col("_c.start").alias("_start"), ends.alias("_end")
    )
    looked = _looked_up(rows, [id_col], ["_lead", "_start", "_end"], "_t", vocab)
    # Without offsets of its own, ``_start`` is a token's length so far.
    start = F.col("_start") if own else F.zip_with("_end", "_start", lambda e, n: e - n)
    known = F.arrays_zip(F.slice("_ids", F.col("_lead") + 1, F.size("_ids")).alias("id"), start.alias("start"), F.col("_end").alias("end"))
    return looked.select(id_col, F.slice("_ids", F.lit(1), F.col("_lead")).alias("lead"), known.alias("context"))


def decode(df: DataFrame, id_col: str, ids_col: str, vocab: DataFrame, out_col: str = "text",
           skip_special: bool = True, tokenizer: Tokenizer | None = None, in_place: bool = False) -> DataFrame:
    """Id arrays back to text (J5): joined by spaces, or by the ``join`` of a ``Tokenizer``.

    An id that the vocabulary lacks reads as UNK; special tokens (UNK too) are dropped when asked.
    ``in_place`` is for rows that ``encode`` has dealt by their id: they are not shuffled again.
    """
    table = vocab.select(F.col("id").alias("_id"), F.col("token").alias("_token"), "is_special")
    top = table.where(_held(F.col("_id"), in_place)).orderBy("_id").toPandas()  # bounded by HOT_ENTRIES, and WARM_ENTRIES in place
    held = df.sparkSession.sparkContext.broadcast((top["_id"].tolist(), top["_token"].tolist(), top["is_special"].tolist()))
    edge = len(SPECIAL_TOKENS) + HOT_ENTRIES + WARM_ENTRIES

    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = np.array(held.value[0], np.int64)
        for lists in _list_slices(batches):
            flat = lists.flatten().cast(pa.int32())
            plain = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
            yield _known_and_rare(lists, flat, np.where(np.isin(plain, ids), plain, -1))

    def tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids, names, special = held.value
        # Behind them one for the numbers that the held part lacks.
        ids, names, special = np.array([*ids, edge], np.int64), pa.array([*names, UNK], pa.string()), np.array([*special, True], bool)
        for slots, late in batches:
            # Entries of the vocabulary, then the late ones of all rows: an entry that is missing counts as special and reads as UNK.
            more = late.flatten()
            every = pa.concat_arrays([names, pc.fill_null(pc.struct_field(more, "_token").cast(pa.string()), UNK)])
            drop = np.concatenate([special, pc.fill_null(pc.struct_field(more, "is_special"), True).to_numpy(zero_copy_only=False)])
            sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
            late_sizes = late.value_lengths().to_numpy(zero_copy_only=False)
            at = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(len(ids) + np.cumsum(late_sizes) - late_sizes, sizes)
            at = np.where(at >= 0, np.searchsorted(ids, at), base - at - 1)
            stays = ~drop[at] if skip_special else np.ones(len(at), bool)
            count = np.concatenate([[0], np.cumsum(stays)])
            edges = count[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            yield pa.ListArray.from_arrays(edges, every.take(pa.array(at[stays])))

    def tokens_in_place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids = np.array(held.value[0], np.int64)

        def slotted(lists: pa.Array) -> pa.Array:
            flat = lists.flatten().cast(pa.int32())
            plain = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
            late = (plain < 0) | (plain >= edge)
            # A null is no late item; it reads like a number that the held part lacks.
            lacking = flat.is_null().to_numpy(zero_copy_only=False) | ~(late | np.isin(plain, ids))
            return _known_and_rare(lists, flat, np.where(lacking, edge, np.where(late, -1, plain))).field("slots")

        for lists, late in batches:
            slices = _slices(lists.value_lengths().to_pylist())
            yield from tokens((slotted(lists.slice(i, j - i)), late.slice(i, j - i)) for i, j in slices)

    ids = F.coalesce(ids_col, F.array().cast("array<int>"))
    entries = table.select("_id", "_token", "is_special")
    if in_place:
        # Told apart without Python, behind which rows that are dealt by their id would count as dealt no more.
        rows = df.select(id_col, ids.alias("_slots"))
        rows = rows.select(id_col, "_slots", F.filter("_slots", lambda x: ~_held(x, True)).alias("_rare"))
        met = _late_in_place(rows, [id_col], "_rare", "_id", entries, ["_slots"])
    else:
        rows = df.select(id_col, F.arrow_udf(known, "struct<slots:array<int>,rare:array<int>>")(ids).alias("_k"))
        rows = rows.select(id_col, F.col("_k.slots").alias("_slots"), F.col("_k.rare").alias("_rare"))
        met = _late_entries(rows, [id_col], "_rare", "_id", entries, ["_slots"])
    join = tokenizer.join if tokenizer is not None else space_joined
    found = F.arrow_udf(tokens_in_place if in_place else tokens, "array<string>")("_slots", F.transform("_late", lambda x: x["_v"]))
    return met.select(id_col, join(found).alias(out_col))


# --- R1-R7: labels, truncation, padding, masks ---------------------------------
def lit_int_array(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def truncate(arr: Column, n: int) -> Column:
    """First ``n`` items."""
    return F.slice(arr, 1, n)


def char_prefix(text: Column, n: int) -> Column:
    """First ``n`` characters (code points) of a text (K8)."""
    return F.substring(text, 1, n)


def pad_right(arr: Column, n: int, value: int) -> Column:
    """Right-pad to ``n`` with ``value`` (R4); longer arrays stay as they are."""
    return F.concat(arr, lit_int_array(F.lit(n) - F.size(arr), value))


def prompt_answer_example(q_ids: Column, a_ids: Column, max_length: int, pad_id: int = PAD_ID) -> Column:
    """Causal-LM example with loss on the answer only.

    ``input_ids = q + a``, ``labels = [-100] * |q| + a``, both cut to
    ``max_length`` (each part first, as the tokenizer call does, then the
    concatenation); mask of ones; then right padding with pad / 0 / -100.
    """
    q = truncate(q_ids, max_length)
    a = truncate(a_ids, max_length)
    ids = truncate(F.concat(q, a), max_length)
    labels = truncate(F.concat(lit_int_array(F.size(q), IGNORE_INDEX), a), max_length)
    mask = lit_int_array(F.size(ids), 1)
    return F.struct(
        pad_right(ids, max_length, pad_id).alias("input_ids"),
        pad_right(mask, max_length, 0).alias("attention_mask"),
        pad_right(labels, max_length, IGNORE_INDEX).alias("labels"),
    )


def answer_labels(labels: Column) -> Column:
    """Supervised label ids only."""
    return F.filter(labels, lambda x: x != IGNORE_INDEX)


def masked_view(ids: Column, labels: Column, pad_id: int = PAD_ID) -> Column:
    """Keep supervised ids, replace the others with ``pad_id``."""
    return F.zip_with(ids, labels, lambda t, lab: F.when(lab != IGNORE_INDEX, t).otherwise(F.lit(pad_id)))


# --- W3: supervised spans -------------------------------------------------------
def target_spans(labels: Column) -> Column:
    """Maximal runs of supervised labels as ``array<struct<start, end>>``, end exclusive."""
    n = F.size(labels)
    idx = F.sequence(F.lit(0), n - 1)
    sup = lambda i: F.get(labels, i) != IGNORE_INDEX
    starts = F.filter(idx, lambda i: sup(i) & ((i == 0) | ~F.coalesce(sup(i - 1), F.lit(False))))
    ends = F.filter(idx, lambda i: sup(i) & ((i == n - 1) | ~F.coalesce(sup(i + 1), F.lit(False))))
    spans = F.arrays_zip(starts.alias("start"), F.transform(ends, lambda e: e + 1).alias("end"))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


# --- W4: fixed blocks -------------------------------------------------------------
def clm_blocks(ids: Column, block_size: int = CLM_BLOCK_SIZE) -> Column:
    """Whole blocks of ``block_size`` ids, tail dropped; fewer ids -> no block."""
    n_blocks = F.floor(F.size(ids) / block_size).cast("int")
    return F.when(
        n_blocks > 0,
        F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(ids, i * block_size + 1, block_size)),
    ).otherwise(F.array().cast("array<array<int>>"))


# --- P13, A16, A17: supervision checks and counts --------------------------------------
def supervision_counts(ids: Column, labels: Column, unk_id: int = UNK_ID, pad_id: int = PAD_ID) -> Column:
    """Per example: total / target / masked token counts, UNK counts, check outcome."""
    total = F.size(ids).cast("bigint")
    target = F.size(answer_labels(labels)).cast("bigint")
    reason = (
        F.when(total == 0, F.lit("0 tokens"))
        .when(target == 0, F.lit("no target tokens"))
        .when(target >= total, F.lit("all tokens are targets"))
    )
    return F.struct(
        total.alias("total_tokens"),
        target.alias("target_tokens"),
        (total - target).alias("masked_tokens"),
        F.size(F.filter(ids, lambda x: x == unk_id)).cast("bigint").alias("unk_full"),
        F.size(F.filter(masked_view(ids, labels, pad_id), lambda x: x == unk_id)).cast("bigint").alias("unk_masked"),
        reason.isNull().alias("valid"),
        reason.alias("reason"),
    )


# --- R8-R11: pair encoding for span QA --------------------------------------------------
def encode_pair(q_ids: Column, ctx_ids: Column, max_length: int | None = None) -> Column:
    """``[CLS] q [SEP] ctx [SEP]`` (R10, R11); with ``max_length`` the context is cut to fit and all is padded to it.

    The context starts at position ``size(q) + 2`` and keeps
    ``max_length - size(q) - 3`` tokens.  NULL for a question that leaves no room for context
    (see ``no_room``).
    """
    room = (F.lit(max_length) if max_length is not None else F.size(q_ids) + F.size(ctx_ids) + 3) - F.size(q_ids) - 3
    ctx = F.slice(ctx_ids, 1, F.greatest(room, F.lit(0)).cast("int"))
    ids = F.concat(F.array(F.lit(CLS_ID)), q_ids, F.array(F.lit(SEP_ID)), ctx, F.array(F.lit(SEP_ID)))
    mask = lit_int_array(F.size(ids), 1)
    if max_length is not None:
        ids, mask = pad_right(ids, max_length, PAD_ID), pad_right(mask, max_length, 0)
    pair = F.struct(
        ids.alias("input_ids"),
        mask.alias("attention_mask"),
        (F.size(q_ids) + 2).cast("int").alias("context_start"),
        F.size(ctx).cast("int").alias("context_len"),
    )
    return pair if max_length is None else F.when(room > 0, pair)


def no_room(q_ids: Column, max_length: int) -> Column:
    """Whether a question leaves no room for any context (the row's ``encode_pair`` is NULL)."""
    return F.size(q_ids) + 3 >= max_length


def first_index(arr: Column, value: int) -> Column:
    """0-based index of the first ``value`` (R8); -1 when absent."""
    return (F.array_position(arr, F.lit(value)) - 1).cast("int")


def sequence_counts(df: DataFrame, ids_col: str = "input_ids", labels_col: str = "labels") -> DataFrame:
    """Corpus totals of the supervision counts (A16, A17), one row."""
    s = supervision_counts(F.col(ids_col), F.col(labels_col))
    x = df.select(s.alias("s"))
    return x.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sum("s.total_tokens").alias("total_tokens"),
        F.sum("s.target_tokens").alias("target_tokens"),
        F.sum("s.masked_tokens").alias("masked_tokens"),
        F.sum("s.unk_full").alias("unk_full"),
        F.sum("s.unk_masked").alias("unk_masked"),
        F.sum(F.when(F.col("s.valid"), 0).otherwise(1)).cast("bigint").alias("n_invalid"),
    )


# --- R12: assistant-only labels over a whole dialogue -------------------------------------
def assistant_only_labels(
    turn_ids: DataFrame,
    id_col: str = "conv_id",
    ids_col: str = "ids",
    max_length: int = 4096,
    chunk: int = 256,
) -> DataFrame:
    """Token ids and labels of a tagged dialogue, loss on assistant content only.

    ``turn_ids``: ``(id, turn, role, ids)`` with the content ids of each
    message.  Each known role contributes its tag token then its content; an
    unknown role contributes nothing.  Labels are -100 except on assistant
    content.  EOS closes the sequence (label -100); the result is cut to
    ``max_length``.  Ordered re-assembly is two-level, as in ``dialogue``.
    """
    role = F.col("role")
    tag = None
    for r, i in ROLE_TAG_IDS.items():
        tag = F.when(role == r, F.lit(i)) if tag is None else tag.when(role == r, F.lit(i))
    empty = F.array().cast("array<int>")
    content = F.when(tag.isNotNull(), F.col(ids_col)).otherwise(empty)
    seg_ids = F.concat(F.when(tag.isNotNull(), F.array(tag)).otherwise(empty), content)
    seg_labels = F.when(role == "assistant", F.concat(F.array(F.lit(IGNORE_INDEX)), content)).otherwise(
        lit_int_array(F.size(seg_ids), IGNORE_INDEX)
    )
    segs = turn_ids.select(id_col, "turn", seg_ids.alias("_i"), seg_labels.alias("_l"))
    c = F.floor(F.col("turn") / chunk).alias("_chunk")
    level1 = segs.groupBy(id_col, c).agg(F.array_sort(F.collect_list(F.struct("turn", "_i", "_l"))).alias("_s"))
    level1 = level1.select(
        id_col, "_chunk",
        F.flatten(F.transform("_s", lambda x: x["_i"])).alias("_i"),
        F.flatten(F.transform("_s", lambda x: x["_l"])).alias("_l"),
    )
    level2 = level1.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_i", "_l"))).alias("_s"))
    ids = F.concat(F.flatten(F.transform("_s", lambda x: x["_i"])), F.array(F.lit(EOS_ID)))
    labels = F.concat(F.flatten(F.transform("_s", lambda x: x["_l"])), F.array(F.lit(IGNORE_INDEX)))
    return level2.select(id_col, truncate(ids, max_length).alias("input_ids"),
                         truncate(labels, max_length).alias("labels"))
