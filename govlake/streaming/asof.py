"""The override in force at every call, with calls and edits both arriving as streams.

Calls and edits of an ability are collected by buckets of time, which come out once the
watermark of both streams has passed them, so every edit of a bucket is known. Within a bucket the
calls after an edit are one run; only the run before the first edit depends on what was
before. Keyed state holds the last version of each ability and gives it to these runs, bucket
by bucket. So a task of state sees runs, not calls or edits, an ability is taken apart into
its buckets, and an edit that a later one has replaced is forgotten with its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govlake.functions import templates as tp
from govlake.operators.prompts import prompt_asof
from govlake.session import scratch_path
from govlake.streaming.run import stateful, to_table

PARTS = 8
BUCKET_SECONDS = 60
EVENT = "at BIGINT, request_id BIGINT, is_call BOOLEAN, edit_id BIGINT, live BOOLEAN, mode STRING, template STRING"
VERSION = ("edit_id", "live", "mode", "template")
RUN = ("ability_id STRING, part INT, bucket BIGINT, known BOOLEAN, last BOOLEAN, edit_id BIGINT, live BOOLEAN, mode STRING, "
       "template STRING, calls ARRAY<BIGINT>")
MET = "ability_id STRING, edit_id BIGINT, live BOOLEAN, mode STRING, template STRING, calls ARRAY<BIGINT>"
RESULT = "request_id BIGINT, ability_id STRING, edit_id BIGINT, mode STRING, template STRING"

# Stands for a null id where arrays of numbers can't hold one.
NO_ID = -(1 << 63)


def bucket_runs(batch: pa.RecordBatch, parts: int, bucket_micros: int) -> pa.RecordBatch:
    """Runs of calls from rows of (ability_id, bucket, events).

    A run is the calls between an edit and the next one, or before the first one of the bucket
    (not ``known``). The ``last`` edit of a bucket is there without calls, too. Runs that need or change
    what is remembered are of part 0, the others are dealt over the parts by bucket.
    """
    events = batch.column("events")
    flat = events.flatten()
    at, is_call, edit_id = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "is_call", "edit_id"))
    group = np.repeat(np.arange(batch.num_rows), events.value_lengths().to_numpy())
    order = np.lexsort((edit_id, is_call, at, group))
    group, is_call = group[order], is_call[order]
    new_group = np.append(True, group[1:] != group[:-1])[:len(group)]
    starts = np.flatnonzero(new_group | ~is_call)
    calls = np.add.reduceat(is_call.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    known = ~is_call[starts]
    last = known & np.append(group[starts][1:] != group[starts][:-1], True)[:len(starts)]
    kept = (calls > 0) | last
    starts, calls, known, last = starts[kept], calls[kept], known[kept], last[kept]
    rows = pa.array(group[starts])
    bucket = batch.column("bucket").take(rows)
    number = bucket.to_numpy(zero_copy_only=False) // bucket_micros
    part = np.where(known & ~last & (parts > 1), 1 + number % max(parts - 1, 1), 0)
    version = flat.take(pa.array(order[starts], mask=~known))
    ids = flat.field("request_id").take(pa.array(order[is_call]))
    offsets = pa.array(np.append(0, np.cumsum(calls)).astype(np.int32))
    columns = [batch.column("ability_id").take(rows), pa.array(part.astype(np.int32)), bucket, pa.array(known), pa.array(last),
               pa.array(np.where(known, edit_id[order[starts]], NO_ID)), version.field("live").fill_null(False),
               *[pa.StructArray.flatten(version)[version.type.get_field_index(name)] for name in ("mode", "template")],
               pa.ListArray.from_arrays(offsets, ids)]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in RUN.split(", ")])


class VersionInForce(StatefulProcessor):
    """A list state of the last version of each ability."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.versions = handle.getListState("versions", "edit_id BIGINT, live BOOLEAN, mode STRING, template STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chained = []
        for batch in rows:
            passing = batch["known"] & ~batch["last"]
            if passing.any():
                yield batch.loc[passing, ["ability_id", *VERSION, "calls"]]
            if not passing.all():
                chained.append(batch.loc[~passing, ["ability_id", "bucket", "known", *VERSION, "calls"]])
        if not chained:
            return
        # All that is closed of the ability: one run before the first edit and one after the last a bucket.
        runs = pd.concat(chained, ignore_index=True).sort_values(["bucket", "known"], ignore_index=True)
        remembered = next(iter(self.versions.get()), None)
        versions = runs[list(VERSION)].astype(object)
        versions.loc[-1] = [NO_ID, False, None, None] if remembered is None else list(remembered)
        known = runs["known"].to_numpy()
        source = np.maximum.accumulate(np.where(known, np.arange(len(runs)), -1))
        met = versions.loc[source].reset_index(drop=True).astype({"edit_id": "int64", "live": "bool"})
        met.insert(0, "ability_id", runs["ability_id"])
        met["calls"] = runs["calls"]
        if known.any():
            self.versions.put([tuple(versions.loc[source[-1]])])
        yield met[[len(ids) > 0 for ids in met["calls"]]]

    def close(self) -> None:
        pass


def asof_stream(calls: DataFrame, edits: DataFrame, delay: str = "60 seconds", parts: int = PARTS,
                bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Stream of (request_id, ability_id, edit_id, mode, template) from streams of calls
    (request_id, ability_id, ts) and of edits; each may be ``delay`` out of order.

    A call comes out when the watermark has passed its bucket.
    """
    width = bucket_seconds * 1_000_000
    nothing = F.lit(None)
    asked = calls.withWatermark("ts", delay).select(
        "ability_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("request_id", F.lit(NO_ID)).alias("request_id"), F.lit(True).alias("is_call"),
        F.lit(0).cast("bigint").alias("edit_id"), F.lit(False).alias("live"), *[nothing.cast("string").alias(c) for c in ("mode", "template")],
    )
    made = edits.withWatermark("updated_at", delay).select(
        "ability_id", F.col("updated_at").alias("ts"), F.unix_micros("updated_at").alias("at"), F.lit(NO_ID).alias("request_id"),
        F.lit(False).alias("is_call"), F.coalesce("edit_id", F.lit(NO_ID)).alias("edit_id"),
        F.coalesce(F.col("action") == "put", F.lit(False)).alias("live"), tp.known_mode(F.col("mode")).alias("mode"), "template",
    )
    event = F.struct(*[field.split()[0] for field in EVENT.split(", ")])
    closed = asked.unionByName(made).groupBy("ability_id", F.window("ts", f"{bucket_seconds} seconds").alias("_window")).agg(
        F.collect_list(event).alias("events")
    ).select("ability_id", F.unix_micros("_window.start").alias("bucket"), "events")
    runs = closed.mapInArrow(lambda batches: (bucket_runs(batch, parts, width) for batch in batches if batch.num_rows), RUN)
    met = runs.groupBy("ability_id", "part").transformWithStateInPandas(VersionInForce(), MET, "Append", "None")

    def shown(column: str) -> Column:
        return F.when(F.col("live"), F.col(column)).alias(column)

    shown_calls = met.select(F.explode("calls").alias("request_id"), "ability_id", shown("edit_id"), shown("mode"), shown("template"))
    return shown_calls.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("request_id", "edit_id")})


def stream_prompt_asof(calls: DataFrame, edits: DataFrame, delay: str = "60 seconds", root: str | None = None,
                       call_log: DataFrame | None = None, edit_log: DataFrame | None = None) -> DataFrame:
    """Drain both streams into a table below ``root`` and return it.

    An edit that comes after the watermark isn't seen by calls that are out already, so ``delay``
    has to cover the disorder. With logs of the same calls and edits, calls that are not in the table (they came after the
    watermark, or it has not passed them yet) are looked up in the logs.
    """
    spark = calls.sparkSession
    root = root or scratch_path(spark, "asof")
    with stateful(spark):
        query = to_table(asof_stream(calls, edits, delay), f"{root}/table", f"{root}/checkpoint")
    query.awaitTermination()
    found = spark.read.schema(RESULT).parquet(f"{root}/table")
    if call_log is None or edit_log is None:
        return found
    found = found.where("request_id IS NOT NULL")  # calls without an id are all looked up
    rest = call_log.select("request_id", "ability_id", "ts").join(found.select("request_id"), "request_id", "left_anti")
    return found.unionByName(prompt_asof(rest.select("request_id", "ability_id", "ts"), edit_log).drop("ts"))
