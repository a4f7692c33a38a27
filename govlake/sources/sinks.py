"""Table sinks on plain parquet: append-only logs, and tables whose partitions are rebuilt from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake import schemas
from govlake.operators.intervals import INTERVAL, edit_intervals
from govlake.operators.usage import add_usage
from govlake.sources import files

# Below a stored rollup: the deltas of every batch, by month. Readers of the months don't list it.
_LOG = "_log"
# The batch of a rollup that is loaded as a whole.
LOADED = -1


def append(df: DataFrame, path: str) -> None:
    """Append-only log (edit history, violations, guideline audit)."""
    df.write.mode("append").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup; a filter on ``period`` prunes the months."""
    return spark.read.schema(schemas.USAGE).parquet(path)


def write_usage(spark: SparkSession, path: str, usage: DataFrame) -> None:
    """Load a rollup that exists already, as the first batch."""
    upsert_usage(spark, path, usage, LOADED)


def upsert_usage(spark: SparkSession, path: str, delta: DataFrame, batch_id: int) -> None:
    """Add a delta to the stored rollup.

    The delta goes to the log under its batch id, and the months it touches are rebuilt from
    the log and replaced; other months are neither read nor written. Both steps give the same
    result when they are done again, so a batch that broke off or comes twice is simply run again.
    """
    batch = f"{path}/{_LOG}/batch_id={batch_id}"
    before = _months(spark, batch)
    delta.write.mode("overwrite").partitionBy("period").parquet(batch)
    months = sorted({*before, *_months(spark, batch)})
    if months:
        logged = spark.read.schema(schemas.USAGE + ", batch_id BIGINT").parquet(f"{path}/{_LOG}").where(F.col("period").isin(months))
        _replace(add_usage(logged.drop("batch_id"), logged.drop("batch_id").where(F.lit(False))), path)


def _months(spark: SparkSession, path: str) -> list[str]:
    return [name.removeprefix("period=") for name in files.names(spark, path) if name.startswith("period=")]


def _replace(usage: DataFrame, path: str) -> None:
    """Replace the months present in ``usage``; adaptive execution sizes the tasks."""
    (
        usage.repartition("period", "user_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("period").parquet(path)
    )


def remove_months(spark: SparkSession, path: str, before: str) -> None:
    """Remove the months before one, from the log first, so that none can be rebuilt."""
    log = f"{path}/{_LOG}"
    for folder in [*(f"{log}/{name}" for name in files.names(spark, log)), path]:
        for month in _months(spark, folder):
            if month < before:
                files.remove(spark, f"{folder}/period={month}")


# Shards of a stored edit history: what a batch of edits makes the table rebuild.
SHARDS = 16


def record_edits(spark: SparkSession, path: str, edits: DataFrame, batch_id: int) -> None:
    """Add a batch of edits to a stored history and rebuild the intervals of the abilities it touches.

    The log keeps every edit under its batch id; the intervals of a shard follow from its log
    alone, so batches may come in any order, late, or twice. Other shards are neither read nor written.
    """
    batch = f"{path}/{_LOG}/batch_id={batch_id}"
    sharded = edits.withColumn("shard", F.pmod(F.xxhash64("ability_id"), F.lit(SHARDS)).cast("int"))
    sharded.write.mode("overwrite").partitionBy("shard").parquet(batch)
    touched = files.numbered(spark, batch, "shard=")
    if touched:
        logged = spark.read.schema(schemas.PROMPT_EDITS + ", batch_id BIGINT, shard INT").parquet(f"{path}/{_LOG}")
        rebuilt = edit_intervals(logged.where(F.col("shard").isin(touched)), ["shard", "ability_id"])
        rebuilt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """The stored intervals of all abilities."""
    return spark.read.schema(INTERVAL + ", shard INT").parquet(path).drop("shard")


def write_usage_delta(usage: DataFrame, path: str, batch_id: int) -> None:
    """Store one micro-batch of a stream; a replayed batch replaces itself."""
    usage.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_usage_deltas(spark: SparkSession, path: str) -> DataFrame:
    """All stored micro-batches added up."""
    deltas = spark.read.schema(schemas.USAGE + ", batch_id BIGINT").parquet(path).drop("batch_id")
    return add_usage(deltas, deltas.where(F.lit(False)))
