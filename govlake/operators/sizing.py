"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.session import scratch_path

# Rows of driver values are local relations, whose number the optimizer knows.
MAX_BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects; compressed files and generated rows can be far larger."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_local(df: DataFrame) -> bool:
    """Whether a frame is made of driver values alone."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return all(leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size()))


def small_side(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A join side with a broadcast hint if it is a small table of driver values.

    Every other side is left as it is: adaptive execution sees the real size of what was
    shuffled and broadcasts it, or splits skewed keys. Nothing is evaluated to find out.
    """
    return F.broadcast(df) if is_local(df) and planned_bytes(df) <= max_bytes else df


def settled(df: DataFrame, label: str) -> DataFrame:
    """A written copy in the shared folder: evaluated once, its size known to the planner.

    For sides that are used several times or joined to something far larger, such as one
    row per site or ability.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, bytes_per_core: int = 32 << 20) -> DataFrame:
    """Give every core a share of an input too small to come in that many splits.

    For stages whose work per row is heavy. Inputs of real size are read in enough splits
    and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if planned_bytes(df) < cores * bytes_per_core else df
