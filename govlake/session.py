"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings. Months and dates are UTC by definition of the data model;
# AQE re-plans joins from measured sizes and splits skewed join partitions, also where that
# costs another shuffle (a user or site may own a third of all rows).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many narrow rows at once, and never more bytes than this: a plan reads these settings when it
    # runs, whatever was set when it was built.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

# Settings fixed when a session starts: no call-site capture per Column while plans are built.
STARTUP_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings on a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "govlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the runtime settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STARTUP_CONF, **conf}.items():
        builder = builder.config(key, value)
    return apply_runtime_conf(builder.getOrCreate())


# Folders made for sessions on one machine that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the session names.

    Only a session on one machine (tests) may name none; it gets a folder of its own. On a
    cluster each executor would write to its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="govlake-checkpoint-")
    return _LOCAL_FOLDERS[context.applicationId]


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/govlake-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's scratch folder in the shared folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the application's finished queries left in the shared folder.

    Frames that jobs returned read from there, so call it when their results are written.
    """
    from govlake.sources import files

    files.remove(spark, _scratch_root(spark))
