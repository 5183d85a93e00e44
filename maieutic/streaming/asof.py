"""Forward as-of attach of pending evaluations to the next log record (J9), on a table and on a stream.

An evaluation result waits until the next log record of its run and is
attached to it once; a newer result replaces a waiting one.  So each log
record receives the *last* metric event at or before it that came after the
previous log record.

Skew-safe plan (no window over a whole run, nor over a busy hour): events are
counted per (run, hour), and an hour with many events is cut into as many equal time slices as
it takes to have about ``events_per_slice`` in each.  The next log inside a
slice comes from a window partitioned by ``(run, slice)``; metrics whose slice
has no later log take the first log of the next slice that has one, found
with a window over the per-slice summary (one row per run and slice).
The final "last metric per log" is a partial max aggregate.

On a stream the same rule is a state per run (``attach_next_log_stream``): events wait in slices of
event time until the watermark has passed their slice, then they are taken in order, so late rows find
their place; the evaluation that waits for its log is kept between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def attach_next_log(
    events: DataFrame,
    run_col: str,
    ts_col: str,
    id_col: str,
    kind_col: str,
    metric_kind: str,
    log_kind: str,
    bucket_seconds: int = 3600,
    events_per_slice: int = 100_000,
) -> DataFrame:
    """``(run, log_id, metric_id)``: which metric event each log record carries.

    Events are ordered by ``(ts, id)`` within a run (``id`` breaks ties, so
    positions are unique); metric events after the last log stay pending.
    """
    ev = events.where(F.col(kind_col).isin(metric_kind, log_kind)).select(
        F.col(run_col).alias("_run"),
        F.struct(F.col(ts_col).alias("ts"), F.col(id_col).alias("id")).alias("_key"),
        (F.col(kind_col) == F.lit(log_kind)).alias("_is_log"),
        F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / (bucket_seconds * 1_000_000)).alias("_bucket"),
    )
    width = bucket_seconds * 1_000_000
    busy = ev.groupBy("_run", "_bucket").agg(F.ceil(F.count(F.lit(1)) / events_per_slice).alias("_slices"))
    micros = F.unix_micros(F.col("_key.ts").cast("timestamp"))
    part = F.floor((micros - F.col("_bucket") * width) * F.col("_slices") / width)
    ev = ev.join(busy, ["_run", "_bucket"]).withColumn("_bucket", F.struct(F.col("_bucket").alias("hour"), part.alias("part"))).drop("_slices")
    log_key = F.when(F.col("_is_log"), F.col("_key"))
    w_local = (Window.partitionBy("_run", "_bucket").orderBy("_key")
               .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    local = ev.withColumn("_next_local", F.min(log_key).over(w_local))

    summary = ev.groupBy("_run", "_bucket").agg(F.min(log_key).alias("_first_log"))
    w_next = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    summary = summary.select("_run", "_bucket", F.min("_first_log").over(w_next).alias("_next_bucket_log"))

    metrics = local.where(~F.col("_is_log")).join(summary, ["_run", "_bucket"])
    metrics = metrics.select("_run", "_key", F.coalesce("_next_local", "_next_bucket_log").alias("_log"))
    attached = metrics.where(F.col("_log").isNotNull()).groupBy("_run", "_log").agg(F.max("_key").alias("_metric"))
    return attached.select(
        F.col("_run").alias(run_col),
        F.col("_log.id").alias("log_id"),
        F.col("_metric.id").alias("metric_id"),
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Attach(StatefulProcessor):
    """State of one run: events per slice that the watermark has not passed, and the metric that waits for a log.

    A slice has one timer, which fires when the watermark reaches its end; Spark fires timers in the order of their times.
    """

    def __init__(self, id_type: str, slice_ms: int, names: tuple[str, str, str]):
        self.id_type, self.slice_ms, self.names = id_type, slice_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint", f"events array<struct<ts:bigint,id:{self.id_type},is_log:boolean>>")
        self.pending = handle.getValueState("pending", f"id {self.id_type}")

    def _end(self, part: int) -> int:
        return (part + 1) * self.slice_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh: dict[int, set] = {}
        for batch in rows:
            for ts, event_id, is_log in zip(batch["ts"].tolist(), batch["id"].tolist(), batch["is_log"].tolist()):
                part = ts // (1000 * self.slice_ms)
                if self._end(part) > passed:  # an earlier slice is done with: too late
                    fresh.setdefault(part, set()).add((ts, event_id, bool(is_log)))
        for part, events in fresh.items():
            held = self.waiting.getValue((part,)) if self.waiting.containsKey((part,)) else None
            if held is None:
                self.handle.registerTimer(self._end(part))
            else:
                events |= {(e[0], e[1], e[2]) for e in held[0]}  # a repeated event is one event
            self.waiting.updateValue((part,), (sorted(events),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        part = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        events = sorted((e[0], e[1], e[2]) for e in self.waiting.getValue((part,))[0])
        self.waiting.removeKey((part,))
        before = self.pending.get() if self.pending.exists() else None
        metric = before[0] if before is not None else None
        out = []
        for _, event_id, is_log in events:
            if not is_log:
                metric = event_id
            elif metric is not None:
                out.append((key[0], event_id, metric))
                metric = None
        if metric is not None:
            self.pending.update((metric,))
        elif before is not None:
            self.pending.clear()
        if out:
            yield pd.DataFrame(out, columns=list(self.names))

    def close(self) -> None:
        pass


def attach_next_log_stream(
    events: DataFrame,
    run_col: str,
    ts_col: str,
    id_col: str,
    kind_col: str,
    metric_kind: str,
    log_kind: str,
    delay: str = "10 minutes",
    slice_seconds: int = 60,
) -> DataFrame:
    """``attach_next_log`` on a stream: ``(run, log_id, metric_id)`` rows, each once, to be written in append mode.

    A log record's row appears when the watermark (``delay`` behind the newest event) has passed its slice of
    ``slice_seconds``.  Rows may come late by ``delay`` and in any order, and may repeat; what comes later still is left
    out.  Events without a run, a time or an id are left out.  State per run: the events of the slices that are open, and one
    waiting metric.  The state store must be RocksDB; where the session names none, it is set here.
    """
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, ROCKSDB)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (run_col, id_col)}
    rows = events.where(F.col(kind_col).isin(metric_kind, log_kind)).dropna(subset=[run_col, ts_col, id_col])
    at = F.col(ts_col).cast("timestamp")
    rows = rows.withColumn("_at", at).withWatermark("_at", delay).select(
        F.col(run_col).alias("run"), F.unix_micros("_at").alias("ts"), F.col(id_col).alias("id"), (F.col(kind_col) == log_kind).alias("is_log"), "_at"
    )
    out = f"`{run_col}` {kinds[run_col]}, log_id {kinds[id_col]}, metric_id {kinds[id_col]}"
    processor = _Attach(kinds[id_col], slice_seconds * 1000, (run_col, "log_id", "metric_id"))
    return rows.groupBy("run").transformWithStateInPandas(processor, out, "Append", "EventTime")
