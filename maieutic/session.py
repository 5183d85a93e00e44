"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job here relies on.  AQE re-plans shuffles at run time
# (coalesces small partitions, splits skewed join partitions); the UI is off
# because nothing may open a port beyond what Spark needs internally.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_LOCAL_FOLDERS: dict[str, str] = {}


def get_session(
    master: str | None = None,
    app_name: str = "maieutic",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the defaults above.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, streaming state and written tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    local session (tests) gets a temp folder of its own; on a cluster, whose
    machines do not share one, this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="maieutic-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls give the same one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Spark then removes a query's shuffle files when it ends (4.1 on; others leave them to the driver's garbage collection).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_table(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a lost executor costs a re-read.

    ``drop_shuffles``: its shuffle files go as soon as it is written, as nothing reads them any more.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true" if drop_shuffles else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
