"""Ordered look-back over keys of any size.

A window over a key puts all rows of that key into one task. Here each key is cut into
buckets along the order: rows are compared within their bucket, and what a bucket
inherits comes from a far smaller frame with one row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above a whole number."""
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start, in micros, of the time bucket a timestamp falls in."""
    return cut(F.unix_micros(ts), seconds * 1_000_000)


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                  rows_per_bucket: int = 100_000) -> DataFrame:
    """Add the ``value`` of the row before, per key in the order of an integer column."""
    keys = list(keys)
    bucketed = df.withColumn("_bucket", cut(F.col(order), rows_per_bucket))
    ends = bucketed.groupBy(*keys, "_bucket").agg(F.max_by(value, F.col(order)).alias("_end"))
    inherited = ends.select(
        *keys, "_bucket",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_inherited"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        bucketed.withColumn("_within", F.lag(value).over(within))
        .join(inherited, [*keys, "_bucket"], "left")
        .withColumn(name, F.coalesce("_within", "_inherited"))
        .drop("_bucket", "_within", "_inherited")
    )


def with_latest(left: DataFrame, versions: DataFrame, keys: Sequence[str], left_ts: str, version_ts: str,
                version_id: str, columns: Sequence[str], name: str, bucket_seconds: int = 60) -> DataFrame:
    """Add, as a struct, the version in force at ``left_ts`` (null when there is none).

    A version is in force from its own time on until the next one of the same key;
    equal times are ordered by ``version_id``.
    """
    keys = list(keys)
    kept = left.columns
    version = F.struct(version_ts, version_id, *columns)
    order = F.struct(F.col(version_ts).alias("ts"), F.col(version_id).alias("id"))
    rows = versions.select(
        *keys, F.col(version_ts).alias("_ts"), version.alias("_version"), order.alias("_order"), F.lit(0).alias("_kind")
    ).unionByName(
        left.select(*keys, F.col(left_ts).alias("_ts"), F.struct(*kept).alias("_row"), F.lit(1).alias("_kind")),
        allowMissingColumns=True,
    ).withColumn("_bucket", time_bucket(F.col("_ts"), bucket_seconds))

    ends = rows.where("_kind = 0").groupBy(*keys, "_bucket").agg(F.max_by("_version", "_order").alias("_end"))
    asked = rows.where("_kind = 1").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_asked"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    inherited = (
        asked.unionByName(ends, allowMissingColumns=True)
        .withColumn("_inherited", F.last("_end", ignorenulls=True).over(earlier))
        .where("_asked is not null").select(*keys, "_bucket", "_inherited")
    )

    so_far = (
        Window.partitionBy(*keys, "_bucket").orderBy("_ts", "_kind", "_order")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_within", F.last("_version", ignorenulls=True).over(so_far))
        .where(F.col("_kind") == 1)
        .join(inherited, [*keys, "_bucket"], "left")
        .select("_row.*", F.coalesce("_within", "_inherited").alias(name))
    )
