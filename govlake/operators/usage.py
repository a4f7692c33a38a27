"""Cost per request and the monthly usage rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import money
from govlake.functions.requests import period
from govlake.operators.sizing import small_side

USAGE_KEYS = ("user_id", "period", "provider", "model")
COUNTERS = ("requests", "tokens_in", "tokens_out", "usd_micros")


def request_cost(events: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``period`` and ``usd_micros`` (0 unless the call succeeded)."""
    if prices is None:
        priced = money.price_micros(F.col("tokens_input"), F.col("tokens_output"))
        joined = events
    else:
        joined = events.join(small_side(prices), ["provider", "model"], "left")
        priced = money.price_micros(
            F.col("tokens_input"), F.col("tokens_output"), F.col("rate_in"), F.col("rate_out")
        )
    spent = F.when(F.col("status") == "success", priced).otherwise(F.lit(0).cast("bigint"))
    return joined.withColumn("period", period(F.col("ts"))).withColumn("usd_micros", spent).select(
        *events.columns, "period", "usd_micros"
    )


def usage_rollup(costed: DataFrame) -> DataFrame:
    """Successful calls per user, month, provider and model."""
    return costed.where("status = 'success'").groupBy(*USAGE_KEYS).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_input").alias("tokens_in"),
        F.sum("tokens_output").alias("tokens_out"),
        F.sum("usd_micros").alias("usd_micros"),
        F.max("ts").alias("updated_at"),
    )


def add_usage(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert: counters add up, the later ``updated_at`` stays."""
    return state.unionByName(delta).groupBy(*USAGE_KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.max("updated_at").alias("updated_at")
    )


def usage_by_user(usage: DataFrame, month: str | None = None) -> DataFrame:
    """Spend report of one month (the current one when none is named), highest first."""
    wanted = F.lit(month) if month else F.date_format(F.current_timestamp(), "yyyy-MM")
    return (
        usage.where(F.col("period") == wanted)
        .groupBy("user_id")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS])
        .select("user_id", "requests", "tokens_in", "tokens_out", money.usd_double(F.col("usd_micros")).alias("usd_spent"))
        .orderBy(F.col("usd_spent").desc(), "user_id")
    )


def top_spenders(usage: DataFrame, month: str, k: int) -> DataFrame:
    return usage_by_user(usage, month).limit(k)


def spend_by_user(usage: DataFrame) -> DataFrame:
    """Spend per user and month."""
    return usage.groupBy("user_id", "period").agg(F.sum("usd_micros").alias("spent_micros"))


def usage_subtotals(usage: DataFrame) -> DataFrame:
    """Spend by month, by month and provider, and by month, provider and model."""
    return usage.rollup("period", "provider", "model").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.grouping_id().alias("level")
    )
