"""Behaviour metrics per training step, batch or Structured Streaming.

The same DataFrame code runs on a static table and on a stream of step
events ``(run_id, step, prompt_id, response_id, text[, ts])``:

* X1 ``every``: evaluate only at ``step > 0`` and ``step % every == 0``.
* X2 one evaluation per step and response: rows are reduced to their fixed-width
  features first, then deduplicated by key (texts are not shuffled); on a stream
  with event time ``dropDuplicatesWithinWatermark`` bounds the state.
* X3 metrics per ``(run_id, step)``: the A11 aggregate (partial + final).
* X4 a fixed evaluation subset: chosen by key hash (stable across
  micro-batches, no cache), applied as a left-semi join.
* X5 metric rows under a ``custom/`` prefix, written by ``foreachBatch``: each (run, step) that
  a trigger touched replaces its own partition, so other steps stay readable and a
  replayed batch leaves the same table.  ``start_metric_log_stream`` writes them to a log with a commit per batch instead
  (``metric_sink``): readers never see half a batch, and nothing is overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maieutic.operators.behavior import behavior_features, behavior_metrics_long, feature_metrics
from maieutic.operators.sampling import sample_n
from maieutic.streaming import metric_sink

METRIC_PREFIX = "custom/"


def eval_steps(df: DataFrame, every: int, step_col: str = "step") -> DataFrame:
    """Rows of evaluated steps only."""
    return df.where((F.col(step_col) > 0) & (F.col(step_col) % every == 0))


def dedupe_steps(df: DataFrame, keys: Sequence[str] = ("run_id", "step", "response_id"),
                 watermark_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Each (run, step, response) once."""
    if watermark_col is not None and df.isStreaming:
        return df.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def eval_subset_ids(prompts: DataFrame, max_samples: int, key: str = "prompt_id", seed: int = 42) -> DataFrame:
    """The fixed subset of prompt ids (hash order, at most ``max_samples``)."""
    return sample_n(prompts.select(key).distinct(), max_samples, [key], seed)


def restrict_to_subset(df: DataFrame, subset_ids: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Keep rows whose prompt is in the subset (a semi-join; Spark broadcasts a small subset by itself)."""
    return df.join(subset_ids.select(key), key, "left_semi")


def step_metrics(df: DataFrame, every: int, text_col: str = "text",
                 group_cols: Sequence[str] = ("run_id", "step"),
                 dedupe_keys: Sequence[str] = ("run_id", "step", "response_id"),
                 subset_ids: DataFrame | None = None, subset_key: str = "prompt_id",
                 watermark_col: str | None = None, delay: str = "10 minutes", percentile: str = "exact") -> DataFrame:
    """X1 + X2 + X3 (and X4 with ``subset_ids``) on a static or streaming DataFrame.

    ``percentile="sketch"`` bounds the state that the 95th percentile of a step needs (see ``behavior.p95_length``).
    """
    rows = eval_steps(df, every)
    if subset_ids is not None:
        rows = restrict_to_subset(rows, subset_ids, subset_key)
    keys = list(dict.fromkeys([*group_cols, *dedupe_keys, *([watermark_col] if watermark_col else [])]))
    features = behavior_features(rows.select(*keys, text_col), text_col).drop(text_col)
    return feature_metrics(dedupe_steps(features, dedupe_keys, watermark_col, delay), list(group_cols), percentile=percentile)


def prefixed_metric_rows(metrics: DataFrame, id_cols: Sequence[str] = ("run_id", "step"),
                         prefix: str = METRIC_PREFIX) -> DataFrame:
    """``(ids..., metric, value)`` with the metric names under ``prefix``."""
    long = behavior_metrics_long(metrics, id_cols)
    return long.withColumn("metric", F.concat(F.lit(prefix), F.col("metric")))


def start_step_metrics_stream(events: DataFrame, every: int, sink_path: str, checkpoint_path: str,
                              text_col: str = "text", trigger_once: bool = False,
                              subset_ids: DataFrame | None = None, subset_key: str = "prompt_id",
                              watermark_col: str | None = None, delay: str = "10 minutes"):
    """Run ``step_metrics`` on a stream and keep the prefixed metric table at ``sink_path``.

    Update output mode: a trigger hands over the (run, step) rows it changed, whole, and
    each replaces its partition of the sink.  With ``watermark_col`` the deduplication state is bounded by ``delay``.
    ``checkpoint_path`` belongs in the shared checkpoint folder.
    """
    agg = step_metrics(events, every, text_col, subset_ids=subset_ids, subset_key=subset_key,
                       watermark_col=watermark_col, delay=delay)

    def write(batch_df: DataFrame, _epoch: int) -> None:
        rows = prefixed_metric_rows(batch_df).repartition("run_id", "step")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "step").parquet(sink_path)

    writer = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_path)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_metric_log_stream(events: DataFrame, every: int, log_path: str, checkpoint_path: str, trigger_once: bool = False, **options):
    """Run ``step_metrics`` on a stream into an exactly-once metric log; ``options`` are those of ``step_metrics``."""
    metric_sink.register(events.sparkSession)

    def append(batch_df: DataFrame, batch: int) -> None:
        metric_sink.append_batch(prefixed_metric_rows(batch_df), log_path, batch)

    writer = step_metrics(events, every, **options).writeStream.outputMode("update").foreachBatch(append)
    writer = writer.option("checkpointLocation", checkpoint_path)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
