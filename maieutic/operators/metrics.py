"""A user's own metric over groups of any size (U4).

A metric is an object with four methods, as for a mergeable aggregate::

    init() -> state
    update(state, frame) -> state        frame: pandas, some rows of one group
    merge(state, other) -> state
    finish(state) -> dict                one value per result column

Two phases: every task updates one state per group over its Arrow batches and sends the states, not the rows; the states of a
group are merged, first those of some tasks at a time, then the rest.  So rows are not shuffled, and a group that holds
most of a table is no different from others.  Built-in aggregates are faster where they can state a metric.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GROUPS_HELD = 10_000  # groups a task holds states of before it sends them
_MERGED_AT_ONCE = 64  # tasks whose states are merged in the first step


class Metric(Protocol):
    def init(self) -> Any: ...

    def update(self, state: Any, frame: pd.DataFrame) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> dict: ...


class RowSums:
    """A metric that is arithmetic on sums over rows: ``rows(frame)`` gives the values to sum, ``result(sums)`` the outcome."""

    def __init__(self, rows: Callable[[pd.DataFrame], pd.DataFrame], result: Callable[[pd.Series], dict]):
        self.rows, self.result = rows, result

    def init(self):
        return None

    def update(self, state, frame):
        return self.merge(state, self.rows(frame).sum())

    def merge(self, state, other):
        return other if state is None else state if other is None else state + other

    def finish(self, state):
        return self.result(state)


def metric_report(df: DataFrame, metric: Metric, result: StructType | str, group_cols: Sequence[str] = (),
                  columns: Sequence[str] | None = None) -> DataFrame:
    """``(group columns, result columns)``: the metric of each group; without rows no row.

    ``result`` is the schema (DDL or a struct) of the dict that ``finish`` returns, ``columns`` the columns that ``update`` reads (default:
    all).  A null group value is a group of its own.  States must be picklable; their size should not grow with the rows.
    """
    groups = list(group_cols)
    read = list(dict.fromkeys([*groups, *(columns or df.columns)]))
    keys = [F.col(c) for c in groups]
    group_ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in groups)
    partial_ddl = ", ".join(x for x in (group_ddl, "_state binary, _from int") if x)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        states: dict[tuple, Any] = {}

        def sent() -> pd.DataFrame:
            rows = [(*k, pickle.dumps(s), task) for k, s in states.items()]
            states.clear()
            return pd.DataFrame(rows, columns=[*groups, "_state", "_from"])

        for frame in frames:
            if not len(frame):
                continue
            parts = frame.groupby(groups, dropna=False, sort=False) if groups else [((), frame)]
            for key, part in parts:
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = metric.update(states[key] if key in states else metric.init(), part)
            if len(states) > GROUPS_HELD:
                yield sent()
        if states:
            yield sent()

    def merged(frame: pd.DataFrame):
        state = None
        for i, raw in enumerate(frame["_state"]):
            state = pickle.loads(raw) if not i else metric.merge(state, pickle.loads(raw))
        return state

    def merge_some(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(_state=[pickle.dumps(merged(frame))])[[*groups, "_state"]]

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1][groups].assign(**{k: [v] for k, v in metric.finish(merged(frame)).items()})[[*groups, *names]]

    names = StructType.fromDDL(result).names if isinstance(result, str) else result.names
    result_ddl = result if isinstance(result, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.fields)
    states = df.select(*read).mapInPandas(partial, partial_ddl)
    some = states.groupBy(*keys, (F.col("_from") / _MERGED_AT_ONCE).cast("int")).applyInPandas(
        merge_some, ", ".join(x for x in (group_ddl, "_state binary") if x))
    return some.groupBy(*keys).applyInPandas(finish, ", ".join(x for x in (group_ddl, result_ddl) if x))


# --- the span-QA report as such a metric ---------------------------------------------------------
SPAN_QA_RESULT = "n_examples bigint, start_accuracy double, end_accuracy double, exact_match double, valid_span_ratio double, f1 double"


def _span_qa_rows(frame: pd.DataFrame) -> pd.DataFrame:
    ps, pe, ts, te = (frame[c].astype("int64") for c in ("pred_start", "pred_end", "start_label", "end_label"))
    p, t = (pe - ps + 1).clip(lower=0), (te - ts + 1).clip(lower=0)
    common = (pe.where(pe < te, te) - ps.where(ps > ts, ts) + 1).clip(lower=0)
    empty = (p == 0) | (t == 0)
    f1 = (2.0 * common / (p + t).where(~empty, 1)).where(~empty, ((p == 0) & (t == 0)).astype(float))
    return pd.DataFrame({"n": 1, "start": ps == ts, "end": pe == te, "both": (ps == ts) & (pe == te), "valid": ps <= pe, "f1": f1}).astype(float)


def _span_qa_result(s: pd.Series) -> dict:
    n = s["n"]
    return {"n_examples": int(n), "start_accuracy": s["start"] / n, "end_accuracy": s["end"] / n, "exact_match": s["both"] / n,
            "valid_span_ratio": s["valid"] / n, "f1": round(s["f1"] / n, 9)}


def span_qa_metric() -> RowSums:
    """The span-QA report (A14) stated as a user's metric: over ``pred_start, pred_end, start_label, end_label``."""
    return RowSums(_span_qa_rows, _span_qa_result)
