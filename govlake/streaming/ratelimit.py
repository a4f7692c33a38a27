"""Rate-limit decisions on a stream, equal to the batch replay of the same events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions.limiter import MICROS, advance, fresh
from govlake.operators.ratelimit import KEYS, enabled, key_columns, tick_of
from govlake.policy import DEFAULT_RATE_WINDOWS, RateWindow
from govlake.streaming.keyed import SlotRule, drain_slots

KEY_SCHEMA = "user_id BIGINT, ability_id STRING"

# Callers that are not logged in share user 0, so its abilities have states of their own.
APART = "CASE WHEN user_id = 0 THEN ability_id ELSE '' END"


def ticks(requests: DataFrame, tick_seconds: int = 1) -> DataFrame:
    """One row per request: its key, as in the batch replay, its time and its clock tick."""
    return requests.select(
        *key_columns(), "ts", tick_of(F.col("ts"), tick_seconds).alias("slot"), F.lit(1).cast("bigint").alias("value")
    )


def counters(windows: Sequence[RateWindow], tick_seconds: int = 1) -> SlotRule:
    """Continue the counters of every key until the last of them has expired."""
    pairs = [(w.ttl_seconds * MICROS, w.limit) for w in enabled(windows)]
    if not pairs:
        raise ValueError("no rate window is enabled")

    def fold(tick: int, requests: int, memory: list[int]) -> tuple[list[int], list[int]]:
        counts, expires = (memory[:len(pairs)], memory[len(pairs):]) if memory else fresh(pairs)
        passed = advance(tick, requests, pairs, counts, expires)
        return counts + expires, passed

    return SlotRule(KEYS, KEY_SCHEMA, tick_seconds * MICROS, fold, lambda last, memory: max(memory[len(pairs):], default=0), APART)


def stream_rate_limits(requests: DataFrame, windows: Sequence[RateWindow] = DEFAULT_RATE_WINDOWS, delay: str = "60 seconds",
                       tick_seconds: int = 1, root: str | None = None, log: DataFrame | None = None) -> DataFrame:
    """Drain a request stream: per key and clock tick, requests, how many were allowed and
    how many each window rejected.

    A tick is decided when the watermark, ``delay`` behind the latest request, has passed it.
    ``log`` is the log of the same requests as a table: with it, keys that had requests after
    the watermark, or whose last ticks are still open, are decided from the log.
    """
    logged = None if log is None else ticks(log, tick_seconds).drop("ts")
    folded = drain_slots(ticks(requests, tick_seconds), counters(windows, tick_seconds), delay, root, logged)
    before = F.concat(F.array("value"), F.slice("folded", F.lit(1), F.size("folded") - 1))
    return folded.select(
        *KEYS, F.col("slot").alias("tick"), F.col("value").alias("requests"), F.element_at("folded", -1).alias("allowed"),
        F.zip_with(before, "folded", lambda a, b: a - b).alias("rejected"),
    )
