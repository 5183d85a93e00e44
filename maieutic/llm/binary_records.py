"""op10: token ids in length-delimited binary records, with a separate offset index.

File format (little-endian), any number of files per shard folder::

    file    = magic "MTR1", uint32 shard, uint32 chunk, record*, 0x0A
    record  = uint64 n, uint32 masked crc32 of those 8 bytes, n payload bytes, uint32 masked crc32 of the payload
    payload = uint8 flags (1: has an id), uint8 width (2 or 4), int64 id, ids of that width
    masked  = (crc >> 15 | crc << 17) + 0xA282EAD8 modulo 2**32

Documents are range-partitioned and sorted by id (rows of one id by the beginning of their text), so ascending (shard, chunk,
offset) is ascending id order.  A shard is one task's partition and is cut into
files of about ``chunk_bytes``.  Files are written by Spark's text writer (one row
per file, whose line end is the closing 0x0A) and read by Spark's binary reader, so
any store that Spark reads and writes will do, and a lost executor only repeats
its tasks.

The index has one row per record: file, byte offset, length, number of ids and the
number of ids before it in the whole corpus.  It is made by reading the written files back,
which also checks every checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maieutic.llm.token_count import PieceTokenizer, id_width, prove_whole_tokens, text_slices

# The checksum mask and the file mark.
_MASK = 0xA282EAD8
_MAGIC = b"MTR1"
_HEAD = "<4sII"
_LENGTH = "<Q"
_WORD = "<I"
_PAYLOAD = "<BBq"

CHUNK_BYTES = 16 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record; ``ids`` are already serialised in ``width`` bytes each."""
    payload = struct.pack(_PAYLOAD, doc_id is not None, width, doc_id or 0) + ids
    length = struct.pack(_LENGTH, len(payload))
    return b"".join((length, struct.pack(_WORD, masked_crc(length)), payload, struct.pack(_WORD, masked_crc(payload))))


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, id, ids) of each record of a file; raises on any damage."""
    magic, _, _ = struct.unpack_from(_HEAD, content)
    if magic != _MAGIC or content[-1:] != b"\n":
        raise ValueError("not a record file, or cut short")
    at, end = struct.calcsize(_HEAD), len(content) - 1
    while at < end:
        if at + 12 > end:
            raise ValueError(f"record at {at} is cut short")
        head = content[at : at + 8]
        (n,) = struct.unpack(_LENGTH, head)
        if struct.unpack_from(_WORD, content, at + 8)[0] != masked_crc(head) or at + 16 + n > end:
            raise ValueError(f"record at {at}: bad length")
        payload = content[at + 12 : at + 12 + n]
        if struct.unpack_from(_WORD, content, at + 12 + n)[0] != masked_crc(payload):
            raise ValueError(f"record at {at}: bad checksum")
        has_id, width, doc_id = struct.unpack_from(_PAYLOAD, payload)
        ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_PAYLOAD))
        yield at, n + 16, (doc_id if has_id else None), ids
        at += n + 16


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Encode every whole text, append ``end_id``, and write the records under ``<path>/data``.

    A null or empty text gives a record of the end id alone; null ids come first and
    are flagged as absent; rows with equal ids are ordered by the first 64 characters of the text; an empty table gives a readable, empty data
    folder.  Ids take 2 bytes where the vocabulary allows it, else 4.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))  # bounded by the vocabulary
    width = id_width(tokenizer_path, end_id)
    last = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, chunk = TaskContext.get().partitionId(), 0
        encoder = PieceTokenizer.of(tokenizer_path, whole.value, width)
        parts, size = [struct.pack(_HEAD, _MAGIC, shard, chunk)], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["shard", "body"])

        try:
            for batch in batches:
                encoded = (ids for texts in text_slices(batch.column(1)) for ids in encoder.encode_many(texts))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                    parts.append(frame(doc_id, ids + last, width))
                    size += len(parts[-1])
                    if size >= chunk_bytes:
                        yield flush()
                        chunk += 1
                        parts, size = [struct.pack(_HEAD, _MAGIC, shard, chunk)], 0
            if size:
                yield flush()
        finally:
            encoder.forget()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    # Rows of one id (or of none) may be most of a table: their texts' beginnings part them among shards, and where these
    # are equal, too, the partition they come from.
    rows = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("part", F.spark_partition_id())
    order = ["id", "head", "part"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("id", "text")
    files = ordered.mapInArrow(run, "shard int, body binary").select("shard", F.col("body").cast("string"))
    # One row a file, so a file is never larger than a chunk and its last document.
    files.write.option("maxRecordsPerFile", 1).partitionBy("shard").text(f"{path}/data")


_RECORD = "shard int, chunk int, file string, offset bigint, length bigint, id bigint, n_tokens bigint, before bigint, ids_crc32 bigint"


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: one row per record, with its place, its number of ids, the number of ids before it in
    its file, and the crc32 of its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in _RECORD.split(", ")]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                _, shard, chunk = struct.unpack_from(_HEAD, content)
                rows, before = [], 0
                for offset, length, doc_id, ids in records(content):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((shard, chunk, name, offset, length, doc_id, len(ids), before, crc))
                    before += len(ids)
                columns = list(zip(*rows)) or [()] * len(fields)
                yield pa.record_batch(
                    [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[f for f, _ in fields]
                )

    return _files(spark, path).select("path", "content").mapInArrow(run, _RECORD)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/data")


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Write ``<path>/index`` and return it: ``(id, start, n_tokens, ids_crc32, shard, chunk, file, offset, length)``.

    ``start`` is the number of ids of all records before.  It is a sum of three
    running totals: shards, files of a shard, records of a file; the only single-task window is over one
    row per shard.
    """
    scan_path = f"{path}/scan"
    scan_records(spark, path).write.parquet(scan_path)
    found = spark.read.parquet(scan_path)
    per_file = found.groupBy("shard", "chunk").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    in_shard = per_file.withColumn("file_start", before(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    per_shard = per_file.groupBy("shard").agg(F.sum("n").alias("n"))
    per_shard = per_shard.withColumn("shard_start", before(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    places = in_shard.join(per_shard.select("shard", "shard_start"), "shard").select(
        "shard", "chunk", (F.col("file_start") + F.col("shard_start")).alias("first")
    )
    index = found.join(places, ["shard", "chunk"]).select(
        "id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "chunk", "file", "offset", "length"
    )
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """``(id, ids)`` of every record; with a ``seed`` in a shuffled order that depends on it alone.

    A shuffled read takes its order from the index (a seeded hash of each record's place) and fetches the ids
    from the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, at, i, ids.tolist()) for at, _, i, ids in records(content.as_py())]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                    names=["file", "offset", "id", "ids"],
                )

    read = _files(spark, path).select("path", "content").mapInArrow(run, "file string, offset bigint, id bigint, ids array<int>")
    if seed is None:
        return read.select("id", "ids")
    order = spark.read.parquet(f"{path}/index").select(
        "file", "offset", F.xxhash64(F.lit(seed), "shard", "chunk", "offset").alias("place")
    )
    return read.join(order, ["file", "offset"]).orderBy("place", "file", "offset").select("id", "ids")
