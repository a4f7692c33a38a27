"""Usage rollup and spend alerts on a stream of request events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions.limiter import MICROS
from govlake.functions.money import micros_of
from govlake.functions.requests import period
from govlake.operators.ordered import time_bucket
from govlake.operators.requests import shape_requests
from govlake.operators.usage import request_cost, usage_rollup
from govlake.session import scratch_path
from govlake.sources.sinks import read_usage_deltas, write_usage_delta
from govlake.streaming.keyed import SlotRule, drain_slots
from govlake.streaming.run import stateful, to_batches

# How long after an event it may be delivered, once or again.
HORIZON = "7 days"


def once(exchange: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Each event of a stream once, by request_id; events without an id all count.

    Ids are kept for ``horizon`` of event time, so the state is as large as the traffic of that
    time. What comes later than that behind the latest event is not taken any more.
    """
    marked = exchange.withWatermark("ts", horizon).withColumn("_once", F.coalesce(F.col("request_id").cast("string"), F.uuid()))
    return marked.dropDuplicatesWithinWatermark(["_once"]).drop("_once")


def stream_usage(exchange: DataFrame, path: str | None = None, checkpoint: str | None = None, horizon: str = HORIZON) -> DataFrame:
    """Drain an exchange stream into rollup deltas and return them added up.

    Each micro-batch is rolled up on its own and stored under its batch id, so a batch
    that is replayed after a failure overwrites itself and counts once. Sums don't mind the
    order, so events within the horizon count whenever they come.
    """
    spark = exchange.sparkSession
    root = scratch_path(spark, "usage")
    path, checkpoint = path or f"{root}/deltas", checkpoint or f"{root}/checkpoint"

    def write(batch: DataFrame, n: int) -> None:
        write_usage_delta(usage_rollup(request_cost(shape_requests(batch))), path, n)

    with stateful(spark):
        query = to_batches(once(exchange, horizon), write, checkpoint)
    query.awaitTermination()
    return read_usage_deltas(spark, path)


SPEND_KEYS = ("user_id", "period")


def spend_slots(costed: DataFrame, slot_seconds: int = 60) -> DataFrame:
    """Spend per event with its user, month, time and time slot; null if it costs nothing.

    A filter on the cost would be pushed to the source, where every part of it is worked out
    on its own: that takes several times as long as the cost itself.
    """
    slot = time_bucket(F.col("ts"), slot_seconds)
    return costed.where("user_id IS NOT NULL").select(
        "user_id", period(F.timestamp_micros(slot)).alias("period"), "ts", slot.alias("slot"),
        F.when(F.col("usd_micros") > 0, F.col("usd_micros")).alias("value"),
    )


def month_end(slot: int) -> int:
    """The first moment, in micros, after the month of a slot."""
    day = datetime.fromtimestamp(slot // MICROS, timezone.utc)
    after = datetime(day.year + day.month // 12, day.month % 12 + 1, 1, tzinfo=timezone.utc)
    return int(after.timestamp()) * MICROS


def month_spend(slot_seconds: int = 60) -> SlotRule:
    """Continue the month's spend per user until the month is over."""
    def fold(slot: int, spent: int, memory: list[int]) -> tuple[list[int], list[int]]:
        total = sum(memory) + spent
        return [total], [total]

    return SlotRule(SPEND_KEYS, "user_id BIGINT, period STRING", slot_seconds * MICROS, fold, lambda last, memory: month_end(last))


def spend_alerts(costed: DataFrame, cap_usd: str | float, exempt_users: DataFrame | None = None, delay: str = "60 seconds",
                 slot_seconds: int = 60, root: str | None = None, log: DataFrame | None = None) -> DataFrame:
    """Drain costed events: one row per user and month, the slot in which spend reached the cap.

    ``exempt_users`` (user_id) raise no alert. Redelivered events must be gone (``once``).
    Events without a user belong to nobody's budget. ``log`` is the log of the same events as a
    table, against which late events and open slots are settled.
    """
    cap = micros_of(cap_usd)
    logged = None if log is None else spend_slots(log, slot_seconds).drop("ts")
    spent = drain_slots(spend_slots(costed, slot_seconds), month_spend(slot_seconds), delay, root, logged)
    spent = spent.select(*SPEND_KEYS, "slot", "value", F.get("folded", F.lit(0)).alias("spent_micros"))
    alerts = spent.where(F.lit(cap > 0) & (F.col("spent_micros") >= cap) & (F.col("spent_micros") - F.col("value") < cap))
    if exempt_users is not None:
        alerts = alerts.join(exempt_users.select("user_id"), "user_id", "left_anti")
    return alerts.select("user_id", "period", "slot", "spent_micros")
