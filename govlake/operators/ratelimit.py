"""Replay of the per-user, per-ability rate limits over a request log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions.limit_buckets import FRESH, Bucket, Table
from govlake.functions.limiter import MICROS, fold_sorted
from govlake.operators.ordered import time_bucket
from govlake.operators.sizing import settled
from govlake.policy import DEFAULT_RATE_WINDOWS, RateWindow

KEYS = ("user_id", "ability_id")

# Status and message of a rejected request.
REJECTED_STATUS = 429
REJECTED_MESSAGE = "AI rate limit exceeded (%d per %s)."


def enabled(windows: Sequence[RateWindow]) -> list[RateWindow]:
    """Windows with a positive limit; the others are not checked."""
    return [w for w in windows if w.limit > 0]


def tick_of(ts: Column, tick_seconds: int = 1) -> Column:
    """Clock reading in micros, cut to whole ticks (the limiter's clock counts seconds)."""
    return time_bucket(ts, tick_seconds)


def key_columns(user_name: str = KEYS[0], ability_name: str = KEYS[1]) -> list[Column]:
    """The key of a request; callers that are not logged in share user 0."""
    return [
        F.coalesce("user_id", F.lit(0).cast("bigint")).alias(user_name),
        F.coalesce("ability_id", F.lit("")).alias(ability_name),
    ]


def tick_counts(requests: DataFrame, tick_seconds: int = 1) -> DataFrame:
    """Requests per key and tick: all the counters need to know."""
    return requests.groupBy(*key_columns(*KEYS), tick_of(F.col("ts"), tick_seconds).alias("tick")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def fold_ticks(ticks: DataFrame, windows: Sequence[RateWindow]) -> DataFrame:
    """Add ``passed``: how many requests of the tick pass each enabled window.

    Each partition holds whole keys in tick order and is read as a stream of batches, so
    a task never holds a key in memory.
    """
    pairs = [(w.ttl_seconds * MICROS, w.limit) for w in enabled(windows)]
    ordered = ticks.select(*KEYS, "tick", "requests").repartition(*KEYS).sortWithinPartitions(*KEYS, "tick")
    schema = "user_id BIGINT, ability_id STRING, tick BIGINT, requests BIGINT, passed ARRAY<BIGINT>"
    return ordered.mapInArrow(lambda batches: fold_sorted(batches, KEYS, pairs), schema)


# Length of a bucket in times to live: what can enter a bucket is a small part of its ticks.
BUCKET_TTLS = 16
KEY_SCHEMA = "user_id BIGINT, ability_id STRING"


def fold_buckets(ticks: DataFrame, windows: Sequence[RateWindow], bucket_ttls: int = BUCKET_TTLS) -> DataFrame:
    """The result of ``fold_ticks``, with every key cut into buckets of time that are folded apart.

    What passes a window doesn't depend on the windows after it, so they are taken one after
    the other. For each, a task turns a bucket into the table of its counter's transitions, a
    second chains the tables of a key (a lookup for each bucket), and a third decides a bucket
    from the counter that enters it. A task holds the numbers of one bucket, as arrays, or one of
    the short tables of a key; a bucket has no more rows than it has ticks.
    """
    start = ticks.select(*KEYS, "tick", "requests", F.col("requests").alias("left"))
    at = settled(start, "ticks")
    for window in enabled(windows):
        at = settled(_fold_window(at, window.ttl_seconds * MICROS, window.limit, bucket_ttls), "decided")
    passed = [F.col(f"passed_{i}") for i in range(len(enabled(windows)))]
    return at.select(*KEYS, "tick", "requests", F.array(*passed).alias("passed"))


def _fold_window(at: DataFrame, ttl: int, limit: int, bucket_ttls: int) -> DataFrame:
    """Rows of ticks with what passes one more window; ``left`` is what has passed those before.

    What passes is a column for each window, since a list for each tick takes many times its numbers.
    """
    keys, width = list(KEYS), bucket_ttls * ttl
    bucketed = at.withColumn("bucket", F.floor(F.col("tick") / F.lit(width)))
    arrays = ["times", "time_counts", "time_expires", "count_counts", "count_expires"]

    def table(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(["tick", "left"]).sort_by("tick")
        made = Bucket(rows["tick"].to_numpy(), rows["left"].to_numpy(), ttl, limit).table(key[-1].as_py() * width)
        lists = [pa.array([getattr(made, name)], pa.list_(pa.int64())) for name in arrays]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *lists], [*keys, "bucket", *arrays])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaving = None, FRESH
        for batch in batches:
            entering = []
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for row, key in enumerate(own):
                if key != current:
                    current, leaving = key, FRESH
                entering.append(leaving)
                made = Table(*(batch.column(name)[row].values.to_numpy() for name in arrays))
                leaving = made.leave(*leaving, limit)
            counters = [pa.array([counter[i] for counter in entering], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keys, "bucket"]], *counters], names=[*keys, "bucket", "count", "expires"])

    def decide(rows: pa.Table, entering: pa.Table) -> pa.Table:
        rows = rows.sort_by("tick")
        asked = rows["left"].to_numpy()
        passed = np.zeros(len(rows), np.int64)
        some = asked > 0
        if some.any():
            count, expires = entering["count"][0].as_py(), entering["expires"][0].as_py()
            passed[some] = Bucket(rows["tick"].to_numpy()[some], asked[some], ttl, limit).passed(count, expires)
        return rows.select([*keys, "tick", "requests", *before]).append_column("left", pa.array(passed))

    before = [c for c in at.columns if c.startswith("passed_")]
    lists = ", ".join(f"{name} ARRAY<BIGINT>" for name in arrays)
    asking = bucketed.where("left > 0").select(*keys, "bucket", "tick", "left")
    tables = asking.groupBy(*keys, "bucket").applyInArrow(table, f"{KEY_SCHEMA}, bucket BIGINT, {lists}")
    # A task reads the tables of a key one after the other.
    ordered = tables.repartition(*keys).sortWithinPartitions(*keys, "bucket")
    entries = ordered.mapInArrow(chain, f"{KEY_SCHEMA}, bucket BIGINT, count BIGINT, expires BIGINT")
    columns = ", ".join(f"{c} BIGINT" for c in ["tick", "requests", *before, "left"])
    decided = bucketed.groupBy(*keys, "bucket").cogroup(entries.groupBy(*keys, "bucket")).applyInArrow(decide, f"{KEY_SCHEMA}, {columns}")
    return decided.withColumn(f"passed_{len(before)}", F.col("left"))


def decision(rank: Column, passed: Column, windows: Sequence[RateWindow]) -> Column:
    """``allowed``, or the name of the window that turns the request away."""
    verdict = F.when(F.lit(False), F.lit(""))
    for i, window in enumerate(enabled(windows)):
        verdict = verdict.when(rank > F.get(passed, F.lit(i)), F.lit(window.name))
    return verdict.otherwise(F.lit("allowed"))


def rejection_message(window_name: Column, windows: Sequence[RateWindow]) -> Column:
    """Message of a rejected request, null for allowed ones."""
    message = F.when(F.lit(False), F.lit(""))
    for window in enabled(windows):
        message = message.when(window_name == window.name, F.lit(REJECTED_MESSAGE % (window.limit, window.name)))
    return message.otherwise(F.lit(None).cast("string"))


def rate_limit_replay(requests: DataFrame, windows: Sequence[RateWindow] = DEFAULT_RATE_WINDOWS,
                      tick_seconds: int = 1, hot_ticks: int | None = None) -> DataFrame:
    """Add ``rate_decision`` to every request (request_id, user_id, ability_id, ts, ...).

    Keys are walked in one task each. With ``hot_ticks`` keys of more ticks than that are cut
    into buckets of time that are folded apart, with the same result.
    """
    if not enabled(windows):
        return requests.withColumn("rate_decision", F.lit("allowed"))
    hidden = [f"_{k}" for k in KEYS]
    ticks = tick_counts(requests, tick_seconds)
    if hot_ticks is None:
        folded = fold_ticks(ticks, windows)
    else:
        ticks = settled(ticks, "ticks")
        hot = ticks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_ticks).select(*KEYS)
        hot = settled(hot, "hot-keys")
        walked = fold_ticks(ticks.join(hot, list(KEYS), "left_anti"), windows)
        folded = walked.unionByName(fold_buckets(ticks.join(hot, list(KEYS), "left_semi"), windows))
    folded = folded.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("tick").alias("_tick"), "passed")
    in_tick = Window.partitionBy(*hidden, "_tick").orderBy("ts", "request_id")
    ranked = requests.select("*", *key_columns(*hidden), tick_of(F.col("ts"), tick_seconds).alias("_tick")).withColumn(
        "_rank", F.row_number().over(in_tick)
    )
    return ranked.join(folded, [*hidden, "_tick"]).select(
        *requests.columns, decision(F.col("_rank"), F.col("passed"), windows).alias("rate_decision")
    )


def window_counts(requests: DataFrame, duration: str, limit: int) -> DataFrame:
    """Requests per key and calendar window, and whether they exceed a limit."""
    return requests.groupBy(*key_columns(*KEYS), F.window("ts", duration).alias("_window")).agg(
        F.count(F.lit(1)).alias("requests")
    ).select(
        *KEYS, F.col("_window.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("exceeded")
    )
