"""JSON arrays of any size, read by byte ranges.

Spark's JSON reader gives a whole array file to one task, because where an element begins depends on all quotes and
brackets before it.  Here a file is read by the splittable text reader with ``,`` as its line separator, so each
task has some byte ranges, and a range is made of pieces between commas:

1. **State of a range.**  Whether a range begins inside a string is unknown, so its effect is taken for both
   answers: does it hold an odd number of quotes, and how much deeper does it end.  One row per range.
2. **Prefix combination.**  In file order, quotes add up modulo 2, and of the two depths the one applies that fits
   the quotes before.  That is a running sum over rows of ranges, not of data.
3. **Elements.**  With its state a range cuts its own text at commas of depth 1 outside of strings.  What lies before
   the first and after the last cut are fragments, at most two a range; they are put together in
   file order, and all other elements leave their task as they are.

The scans read the same ranges; a range whose state was not taken is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STATE = pa.schema([
    ("file", pa.string()), ("key", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("mark", pa.string()), ("odd", pa.int32()),
    ("deeper_if_outside", pa.int64()), ("deeper_if_inside", pa.int64()), ("lowest_if_outside", pa.int64()), ("lowest_if_inside", pa.int64()),
])
_STATE_DDL = (
    "file string, key bigint, block bigint, bytes bigint, mark string, odd int, deeper_if_outside bigint, deeper_if_inside bigint, "
    "lowest_if_outside bigint, lowest_if_inside bigint"
)
# JSON's blanks, ASCII blanks of texts, and the byte order mark that may precede a file's text.
_JSON_BLANKS = b" \t\r\n"
_PYTHON_BLANKS = b" \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f"
_MARK = b"\xef\xbb\xbf"


def _pieces(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """``(key, block, piece[, file])`` in file order within each range; ``key`` stands for the file."""
    file = F.col("_metadata.file_path")
    columns = [F.xxhash64(file).alias("key"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece")]
    return spark.read.option("lineSep", ",").text(path).select(*columns, *([file.alias("file")] if named else []))


def _text_of(pieces: pa.Array) -> np.ndarray:
    """Bytes of the pieces, each followed by its comma."""
    pieces = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    held = pieces.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return np.insert(data, offsets[1:] - offsets[0], ord(","))


def _quotes(text: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that open or close a string; a quote after an odd run of backslashes is part of it.

    Text is cut at commas only, so no run of backslashes is cut off from its quote.
    """
    quotes = text == ord('"')
    slashes = text == ord("\\")
    if slashes.any():
        at = np.nonzero(quotes)[0]
        last_other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(text))))
        before = np.where(at > 0, last_other[at - 1], -1)
        quotes[at[(at - 1 - before) % 2 == 1]] = False
    return quotes


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(key, block, rows) of each range that the batch holds a part of."""
    keys, blocks = (np.asarray(batch.column(c)) for c in (0, 1))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
    starts = np.nonzero(fresh)[0].tolist()
    for i, j in zip(starts, [*starts[1:], len(keys)]):
        yield int(keys[i]), int(blocks[i]), batch.slice(i, j - i)


_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1


def _range_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: dict = {}
    for batch in batches:
        for key, block, rows in _runs(batch):
            if (key, block) != (now.get("key"), now.get("block")):
                if now:
                    yield pa.RecordBatch.from_pylist([now], schema=_STATE)
                now = dict.fromkeys(_STATE.names, 0) | dict(file=rows.column(3)[0].as_py(), key=key, block=block, mark=None)
            text = _text_of(rows.column(2))
            parity = (np.cumsum(_quotes(text)) + now["odd"]) & 1
            step = _STEP[text]
            for name, side in (("outside", 0), ("inside", 1)):
                depth = now[f"deeper_if_{name}"] + np.cumsum(np.where(parity == side, step, 0))
                now[f"deeper_if_{name}"] = int(depth[-1])
                now[f"lowest_if_{name}"] = min(now[f"lowest_if_{name}"], int(depth.min()))
            now["odd"] = int(parity[-1])
            if now["mark"] is None:
                seen = text.tobytes()
                if not now["bytes"] and not block:
                    seen = seen.removeprefix(_MARK)
                seen = seen.lstrip(_JSON_BLANKS)
                # A lone comma may be the one that ends the pieces, not the file's own.
                if seen not in (b"", b","):
                    now["mark"] = seen[:1].decode("latin-1")
            now["bytes"] += len(text)
    if now:
        yield pa.RecordBatch.from_pylist([now], schema=_STATE)


def range_states(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, block, at, outside, depth, mark, ok)`` per byte range: the state it begins in, and whether its file is a balanced array.

    ``at`` is the place in the file where the range's text begins, ``mark`` the file's first character that is not blank.
    """
    found = _pieces(spark, path, named=True).mapInArrow(_range_states, _STATE_DDL)
    whole = Window.partitionBy("key")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = found.select("*", (sum_before("odd") % 2 == 0).alias("outside"), sum_before("bytes").alias("at"))
    side = lambda name: F.when(F.col("outside"), F.col(f"{name}_if_outside")).otherwise(F.col(f"{name}_if_inside")).alias(name)
    known = known.select("file", "key", "block", "at", "outside", "odd", "mark", side("deeper"), side("lowest"))
    known = known.withColumn("depth", sum_before("deeper"))
    first = F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("block"))).over(whole)
    balanced = (F.sum("deeper").over(whole) == 0) & (F.sum("odd").over(whole) % 2 == 0) & (F.min(F.col("depth") + F.col("lowest")).over(whole) >= 0)
    return known.select(
        "file", "key", "block", "at", "outside", "depth", first.alias("mark"), F.coalesce(balanced & (first == "["), F.lit(False)).alias("ok")
    )


_ELEMENT = "key bigint, at bigint, whole boolean, opens boolean, first boolean, last boolean, element binary"


def _cutter(held):
    """Elements of ranges whose states ``held`` broadcasts.

    ``whole``: begins and ends in its range.  Of the others, ``opens`` marks the fragment an element begins with.  ``first`` and
    ``last``: next to the array's brackets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, skipped = held.value
        now: dict = {}
        out: list[tuple] = []
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())

        def add(last: bool, ends: bool) -> None:
            element = b"".join(now["rest"])
            out.append((now["key"], now["at"] + now["number"], now["begun"] and ends, now["begun"], now["first"], last, element))
            now["number"] += 1
            now["rest"], now["begun"], now["first"] = [], True, False

        def give() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.record_batch(columns, names=[f.split()[0] for f in _ELEMENT.split(", ")])

        def finish() -> None:
            """The rest of a range belongs to an element that a later range ends."""
            if now and now["depth"] > 0:
                add(False, False)

        for batch in batches:
            for key, block, rows in _runs(batch):
                if key in skipped:
                    continue
                if (key, block) != (now.get("key"), now.get("block")):
                    finish()
                    if (key, block) not in start:
                        raise RuntimeError(f"byte range {block} was not there when states were taken; read the files again")
                    at, outside, depth = start[key, block]
                    now.update(key=key, block=block, at=at, odd=int(not outside), depth=depth, number=0, rest=[], begun=False, first=False)
                text = _text_of(rows.column(2))
                parity = (np.cumsum(_quotes(text)) + now["odd"]) & 1
                step = np.where(parity == 0, _STEP[text], 0)
                depth = now["depth"] + np.cumsum(step)
                # Cuts: the outermost bracket opens, a comma right inside of it, the bracket closes.
                opens, closes = (step == 1) & (depth == 1), (step == -1) & (depth == 0)
                commas = (parity == 0) & (text == ord(",")) & (depth == 1)
                raw, low = text.tobytes(), 0
                for c in np.nonzero(opens | closes | commas)[0].tolist():
                    if opens[c]:
                        now.update(rest=[], begun=True, first=True)  # only blanks before
                    else:
                        # An array that a brace closes: with it, the last element is no JSON, as it should not be.
                        now["rest"].append(raw[low : c + (raw[c : c + 1] == b"}")])
                        add(bool(closes[c]), True)
                    low = c + 1
                now.update(odd=int(parity[-1]), depth=int(depth[-1]))
                if now["depth"] > 0:
                    now["rest"].append(raw[low:])
                if len(out) >= 4096:
                    yield give()
        finish()
        if out:
            yield give()

    return run


def array_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements ``(file, at, element)``, files ``(file, mark, ok)``) of the JSON files under ``path``.

    Elements are the texts between the commas of the outermost array, blanks around them taken off; ``file`` numbers the
    files by path, ``at`` ascends in file order.  Files that are not one balanced array give no elements: ``mark`` is their first
    character (null: blank), ``ok`` false.  An empty array has no elements; a comma without anything after it leaves an empty one.

    The states of all ranges go to the tasks: about a hundred bytes for each range of ``spark.sql.files.maxPartitionBytes``,
    a millionth of the data.
    """
    rows = range_states(spark, path).collect()
    start = {(r["key"], r["block"]): (r["at"], r["outside"], r["depth"]) for r in rows if r["ok"]}
    files = sorted({(r["file"], r["key"], r["mark"], r["ok"]) for r in rows}, key=lambda f: f[0])
    held = spark.sparkContext.broadcast((start, {key for _, key, _, ok in files if not ok}))

    found = _pieces(spark, path).mapInArrow(_cutter(held), _ELEMENT)
    text = lambda c: F.btrim(c.cast("string"), F.lit(_JSON_BLANKS.decode()))
    whole = found.where("whole").select("key", "at", "first", "last", text(F.col("element")).alias("element"))
    # At most two fragments a range.  Those of one element follow each other, and only the first of them opens it.
    parts = found.where("NOT whole")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("key").orderBy("at"))
    parts = parts.withColumn("number", number).groupBy("key", "number").agg(
        F.array_sort(F.collect_list(F.struct("at", "element"))).alias("p"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last")
    )
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["element"])), ""))  # bytes: a cut may part a character
    parts = parts.select("key", F.col("p")[0]["at"].alias("at"), "first", "last", text(joined).alias("element"))
    listed = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "file int, path string, key bigint, mark string, ok boolean")
    elements = whole.unionByName(parts).where("NOT (first AND last AND element = '')")
    elements = elements.join(listed.select("file", "key"), "key").select("file", "at", "element")
    return elements, listed.select("file", "path", "mark", "ok")


def schema_of_elements(elements: DataFrame) -> str | None:
    """Schema of the elements as DDL, as the JSON reader infers it; None without elements.

    Decimals become doubles, and what is null everywhere or of several kinds a string.  (Whole numbers beyond 64 bits become doubles, too.)
    """
    found = elements.agg(F.schema_of_variant_agg(F.try_parse_json("element")).alias("s")).first()["s"]
    if found is None or not found.startswith("OBJECT<"):
        return None
    # Type names stand behind a colon or an opening bracket, field names do not.
    kinds = re.sub(r"(?<=[<:])( ?)OBJECT<", r"\1STRUCT<", found.replace("OBJECT<", "STRUCT<", 1))
    kinds = re.sub(r"(?<=[<:])( ?)DECIMAL\(\d+,\s*\d+\)", r"\1DOUBLE", kinds)
    return re.sub(r"(?<=[<:])( ?)(?:VOID|VARIANT)\b(?![`:])", r"\1STRING", kinds)


def read_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The elements of JSON array files as rows; a file that is no balanced array is an error.

    Without a schema one more scan infers it.  An element that does not fit its schema gives a row of nulls where it does not.
    """
    elements, files = array_elements(spark, path)
    broken = files.where("NOT ok AND mark IS NOT NULL").first()
    if broken is not None:
        raise ValueError(f"{broken['path']}: not a complete JSON array")
    if schema is None:
        schema = schema_of_elements(elements)
        if schema is None:
            return elements.select(F.col("element").alias("value"))
    return elements.select(F.from_json("element", schema).alias("e")).select("e.*")


def first_marks(spark: SparkSession, path: str, block: int = 4096) -> dict[str, str]:
    """{file: its first character that is not blank, or ''}; reads from each file only as far as that character.

    The driver opens the files through Hadoop's file systems one after the other, so any store that Spark reads will do.
    """
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for name in spark.read.text(path).inputFiles():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = file.getFileSystem(conf).open(file)
        codec = codecs.getCodec(file)
        stream = codec.createInputStream(stream) if codec is not None else stream
        try:
            seen, mark = bytes(stream.readNBytes(block)), b""
            head = seen.removeprefix(_MARK)
            while seen and not (mark := head.lstrip(_PYTHON_BLANKS)[:1]):
                head = seen = bytes(stream.readNBytes(block))
            out[name] = mark.decode("latin-1")
        finally:
            stream.close()
    return out
