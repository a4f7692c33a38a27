"""Monthly spend caps: who is over, and which requests that stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions.money import micros_of
from govlake.functions.requests import is_ability_capability
from govlake.operators.ordered import time_bucket
from govlake.operators.sizing import settled
from govlake.operators.usage import spend_by_user


def over_budget_users(usage: DataFrame, cap_usd: str | float) -> DataFrame:
    """Users and months whose spend reached the cap; none when the cap is 0 or less."""
    cap = micros_of(cap_usd)
    return spend_by_user(usage).where(F.lit(cap > 0) & (F.col("spent_micros") >= cap))


def budget_gate(checks: DataFrame, usage: DataFrame, cap_usd: str | float, period: str) -> DataFrame:
    """Capability checks against the spend of one month.

    ``checks`` has user_id, capability, exempt and granted; only ability capabilities of
    users who are over and not exempt turn into a denial, all else keeps ``granted``.
    """
    over = over_budget_users(usage.where(F.col("period") == period), cap_usd).select(
        "user_id", F.lit(True).alias("_over")
    )
    denied = (
        F.coalesce("_over", F.lit(False)) & is_ability_capability(F.col("capability"))
        & ~F.coalesce("exempt", F.lit(False))
    )
    return checks.join(over, "user_id", "left").select(
        *[c for c in checks.columns if c != "granted"],
        F.when(denied, F.lit(False)).otherwise(F.col("granted")).alias("granted"),
    )


def budget_crossings(costed: DataFrame, cap_usd: str | float, exempt_users: DataFrame | None = None,
                     bucket_seconds: int = 60) -> DataFrame:
    """The request at which each user reached the cap in each month.

    Spend never falls, so there is at most one per user and month. Time buckets are summed
    first; only the bucket in which the cap is reached is looked at request by request.
    Exempt users (user_id) are taken out when at most one row per user and month is left.
    """
    cap = micros_of(cap_usd)
    spend = costed.where((F.col("usd_micros") > 0) & F.lit(cap > 0))
    spend = spend.select(
        "user_id", "period", time_bucket(F.col("ts"), bucket_seconds).alias("_bucket"), "ts", "request_id", "usd_micros"
    )
    so_far = Window.partitionBy("user_id", "period").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossed = (
        spend.groupBy("user_id", "period", "_bucket").agg(F.sum("usd_micros").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
        .where((F.col("_before") < cap) & (F.col("_before") + F.col("_sum") >= cap))
        .select("user_id", "period", "_bucket", "_before")
    )
    if exempt_users is not None:
        crossed = crossed.join(exempt_users.select("user_id"), "user_id", "left_anti")
    # One row per user and month: settled, it is met without shuffling all spend once more.
    crossed = settled(crossed, "crossed-buckets")
    running = (
        Window.partitionBy("user_id", "period", "_bucket").orderBy("ts", "request_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        spend.join(crossed, ["user_id", "period", "_bucket"])
        .withColumn("spent_micros", F.col("_before") + F.sum("usd_micros").over(running))
        .where((F.col("spent_micros") >= cap) & (F.col("spent_micros") - F.col("usd_micros") < cap))
        .select("user_id", "period", F.col("ts").alias("crossed_at"),
                F.col("request_id").alias("crossing_id"), "spent_micros")
    )


def over_at_request(requests: DataFrame, crossings: DataFrame) -> DataFrame:
    """Add ``over_budget``: the cap was reached by an earlier request of the month."""
    crossed = crossings.select("user_id", "period", F.struct("crossed_at", "crossing_id").alias("_crossed"))
    later = F.struct(F.col("ts"), F.col("request_id")) > F.struct("_crossed.crossed_at", "_crossed.crossing_id")
    return requests.join(crossed, ["user_id", "period"], "left").select(
        *requests.columns, F.coalesce(F.col("_crossed").isNotNull() & later, F.lit(False)).alias("over_budget")
    )


def budget_replay(costed: DataFrame, cap_usd: str | float, exempt_users: DataFrame | None = None,
                  bucket_seconds: int = 60) -> DataFrame:
    """Every request with the answer the cap would have given at that moment."""
    return over_at_request(costed, budget_crossings(costed, cap_usd, exempt_users, bucket_seconds))
