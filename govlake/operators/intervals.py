"""The edit history as intervals of validity, and look-ups in them.

An edit is in force from its own time to that of the next edit of the same ability. Times and
the state in force are rows of their own, so a look-up reads the interval a call falls into and
not the log. Equal times are ordered by edit id; all but the last of them are in force for
no time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions import templates as tp
from govlake.operators.ordered import time_bucket

# The end of what is still in force.
OPEN_END = (1 << 63) - 1
INTERVAL = "ability_id STRING, edit_id BIGINT, from_us BIGINT, to_us BIGINT, live BOOLEAN, mode STRING, template STRING, updated_by BIGINT"


def edit_intervals(edits: DataFrame, keys: Sequence[str] = ("ability_id",)) -> DataFrame:
    """(keys, edit_id, from_us, to_us, live, mode, template, updated_by); an edit that comes twice counts once."""
    following = Window.partitionBy(*keys).orderBy("updated_at", "edit_id")
    live = F.col("action") == "put"
    once = edits.dropDuplicates([*keys, "edit_id"])
    return once.select(
        *keys, "edit_id", F.unix_micros("updated_at").alias("from_us"),
        F.coalesce(F.unix_micros(F.lead("updated_at").over(following)), F.lit(OPEN_END)).alias("to_us"), live.alias("live"),
        F.when(live, tp.known_mode(F.col("mode"))).alias("mode"), F.when(live, F.col("template")).alias("template"), "updated_by",
    )


def interval_current(intervals: DataFrame) -> DataFrame:
    """The overrides in force now."""
    return intervals.where((F.col("to_us") == OPEN_END) & F.col("live")).select("ability_id", "mode", "template", "updated_by", F.timestamp_micros("from_us").alias("updated_at"))


def interval_asof(calls: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("ability_id",), bucket_seconds: int = 3600) -> DataFrame:
    """Each call with the override that was live when it was made.

    Calls and intervals meet by key and time bucket, so a key with very many calls is spread
    over its buckets. Intervals that last are laid out over the buckets calls are in, at most
    from the first to the last of all calls; a call finds one interval, or none.
    """
    keys = list(keys)
    width = bucket_seconds * 1_000_000
    first, last = calls.agg(F.min(time_bucket(F.col("ts"), bucket_seconds)), F.max(time_bucket(F.col("ts"), bucket_seconds))).first()
    asked = calls.withColumn("_bucket", time_bucket(F.col("ts"), bucket_seconds))
    if first is None:
        first, last = 0, 0
    begin = F.greatest("from_us", F.lit(first))
    end = F.least(F.col("to_us") - 1, F.lit(last + width - 1))
    cut = intervals.where("live AND from_us < to_us").withColumns({"_begin": begin, "_end": end}).where("_begin <= _end")
    laid = cut.withColumn("_bucket", F.explode(F.sequence(
        F.col("_begin") - F.pmod("_begin", F.lit(width)), F.col("_end") - F.pmod("_end", F.lit(width)), F.lit(width)
    ))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_at"), "from_us", "to_us", "edit_id", "mode", "template")
    at = F.unix_micros("ts")
    met = (F.col("_bucket") == F.col("_at")) & (at >= F.col("from_us")) & (at < F.col("to_us"))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_{k}"))
    return asked.join(laid, met, "left").select(*calls.columns, "edit_id", "mode", "template")
