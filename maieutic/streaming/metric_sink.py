"""An exactly-once log of metric rows as a data source for streams and batches.

A stream in append mode writes to it directly; one in update mode, which Python data sources do not take, from ``foreachBatch``
with the number of the batch (``start_metric_log_stream``).  One stream writes to a log.

Each task of a micro-batch writes one Parquet file under ``<path>/rows``, under a name of its own, and the driver then commits
the batch by one small file ``<path>/commits/<batch>.json`` that lists them.  Readers take the files of
committed batches only, so a batch is there whole or not at all:

* a batch that fails is aborted: its files are deleted, and those that a lost machine leaves behind are in no commit;
* a batch that Spark replays after a restart finds its commit, keeps it and deletes the files written again.

Of rows with the same keys (run, step, metric) the one of the latest batch counts, as in update mode a trigger hands
over the changed rows whole.  Files go through Arrow's file systems, so ``path`` may lie in any store that Arrow knows
(local or shared folders, HDFS, S3, GCS), the same one for all machines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "metric_log"
ROWS, COMMITS = "rows", "commits"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/").rstrip("/")
    store, inside = arrow_fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


class MetricLogWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """On a worker: all rows of the task in one file; no rows, no file."""
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written("", 0)
        store, root = _place(self.path)
        name = f"{uuid.uuid4().hex}.parquet"
        store.create_dir(f"{root}/{ROWS}", recursive=True)
        table = pa.Table.from_batches(batches)
        with store.open_output_stream(f"{root}/{ROWS}/{name}") as out:
            pq.write_table(table, out)
        return Written(name, table.num_rows)

    def commit(self, messages, batchId: int) -> None:
        """On the driver: the batch is there from the moment its commit is, which is moved to its place whole."""
        store, root = _place(self.path)
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        target = f"{root}/{COMMITS}/{batchId:020}.json"
        if store.get_file_info(target).type == arrow_fs.FileType.File:
            self.abort(messages, batchId)  # replayed: what is committed stays
            return
        files = sorted(m.file for m in messages if m is not None and m.rows)
        draft = f"{root}/{COMMITS}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": files}).encode())
        store.move(draft, target)

    def abort(self, messages, batchId: int) -> None:
        store, root = _place(self.path)
        for m in messages:
            if m is not None and m.rows:
                file = f"{root}/{ROWS}/{m.file}"
                if store.get_file_info(file).type == arrow_fs.FileType.File:
                    store.delete_file(file)


class MetricLogBatchWriter(DataSourceArrowWriter):
    """One numbered batch, with the stream writer's commit."""

    def __init__(self, path: str, batch: int):
        self.inner, self.batch = MetricLogWriter(path), batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.inner.write(iterator)

    def commit(self, messages) -> None:
        self.inner.commit(messages, self.batch)

    def abort(self, messages) -> None:
        self.inner.abort(messages, self.batch)


class MetricLog(DataSource):
    """``format("metric_log")`` with ``path`` and, for a batch, its number ``batch``; any columns."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise NotImplementedError("a metric log is read by read_metric_log")

    def streamWriter(self, schema, overwrite: bool) -> MetricLogWriter:
        return MetricLogWriter(self.options["path"])

    def writer(self, schema, overwrite: bool) -> MetricLogBatchWriter:
        if overwrite:
            raise ValueError("a metric log is appended to")
        return MetricLogBatchWriter(self.options["path"], int(self.options["batch"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricLog)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write and commit batch ``batch``; one that is committed already stays as it is."""
    rows.write.format(FORMAT).mode("append").option("path", path).option("batch", str(batch)).save()


def read_metric_log(spark: SparkSession, path: str, keys: Sequence[str] = ("run_id", "step", "metric")) -> DataFrame:
    """The rows of committed batches, of each key the latest; an error where nothing is committed yet.

    Commits are listed by Spark and joined with the files' rows by name, so neither list passes through the driver.
    """
    commits = spark.read.schema("batch bigint, files array<string>").json(f"{path}/{COMMITS}/[0-9]*.json")
    files = commits.select("batch", F.explode("files").alias("_file"))
    rows = spark.read.parquet(f"{path}/{ROWS}")
    columns = rows.columns
    known = rows.select("*", F.col("_metadata.file_name").alias("_file")).join(files, "_file")
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return known.withColumn("_at", latest).where("_at = 1").select(*columns)
