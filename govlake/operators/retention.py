"""Retention of the request log and of the usage rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from govlake.functions.dates import cutoff_period
from govlake.operators.events import observed


def retention_days(configured: int, current: int) -> int:
    """Configured days when positive, else what the host uses."""
    return configured if configured > 0 else current


def log_retained(log: DataFrame, now: Column, configured_days: int, current_days: int) -> DataFrame:
    """Log rows young enough to keep."""
    days = retention_days(configured_days, current_days)
    return log.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def log_swept(log: DataFrame, now: Column, configured_days: int, current_days: int) -> tuple[DataFrame, Observation]:
    """The rows to keep, and an observation of how many were kept and removed, which is filled
    when the rows are written. A row without a time is not kept."""
    days = retention_days(configured_days, current_days)
    kept = F.coalesce(F.col("ts") >= now - F.make_dt_interval(F.lit(days)), F.lit(False))
    marked, seen = observed(log.withColumn("_kept", kept), {"kept": F.count_if("_kept"), "removed": F.count_if(~F.col("_kept"))})
    return marked.where("_kept").drop("_kept"), seen


def usage_retained(usage: DataFrame, today: Column, months: int = 24) -> DataFrame:
    """Rollup rows that survive the sweep; 0 or fewer months keeps everything."""
    if months <= 0:
        return usage
    return usage.where(F.col("period") >= cutoff_period(today, months))


def usage_swept(usage: DataFrame, today: Column, months: int = 24) -> DataFrame:
    """One row: the cutoff month and how many rollup rows the sweep removes."""
    cutoff = cutoff_period(today, months)
    removed = F.count_if(F.col("period") < cutoff) if months > 0 else F.lit(0).cast("bigint")
    return usage.agg(removed.alias("removed")).select(cutoff.alias("cutoff"), "removed")
