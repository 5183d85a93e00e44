"""The query catalogue: one entry per operator of the inventory.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` over the whole
driver tables (or data Spark derives from them), and, where the operator can
be stated in SQL, the equivalent DuckDB query over the same parquet views.
Column names and types are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: add ``fn`` under ``name``; ``oracle`` is its DuckDB SQL, if any."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from maieutic.plans import (  # noqa: F401
        q_behavior,
        q_compare,
        q_dialogue,
        q_io,
        q_loss,
        q_registry,
        q_sampling,
        q_span_qa,
        q_stream,
        q_tokens,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
