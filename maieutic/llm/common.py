"""Helpers shared by the operators: shared-folder tables and text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maieutic.session import scratch_path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores in front as long as an input column is called so (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys (64-bit numbers) that are broadcast at most; 8 MB of them.
BROADCAST_KEYS = 1_000_000


def with_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is one of the distinct ``keys``.

    The keys are written and counted: up to ``BROADCAST_KEYS`` of them go to the rows, beyond that both sides are
    shuffled by key.
    """
    keys = written(keys.select(column), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into slices of about ``max_bytes`` of text, with the texts as UTF-8 (null: empty).

    A single longer text is a slice of its own, so a worker never holds more
    than one such slice besides its input batch.
    """
    texts = [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield batch.slice(start, len(texts) - start), texts[start:]
