"""Counts of governance events that come with the job that writes them.

Metrics are observed on the rows as they pass to the sink, in batch and on streams, so
counting what was stopped, blocked or removed costs no scan of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The gates of the replay, by what ``stopped_by`` begins with.
GATES = ("feature", "rate", "role", "model", "budget")


def replay_metrics() -> dict[str, Column]:
    """Events of a governance replay: requests, those each gate stopped, blocked answers, spend."""
    gate = F.split_part("stopped_by", F.lit(":"), F.lit(1))
    stopped = {f"stopped_by_{name}": F.count_if(gate == name) for name in GATES}
    return {
        "requests": F.count(F.lit(1)), "stopped": F.count("stopped_by"), **stopped,
        "output_blocked": F.count_if("output_blocked"), "usd_micros": F.coalesce(F.sum("usd_micros"), F.lit(0)),
    }


def moderation_metrics() -> dict[str, Column]:
    """Events of moderated answers: answers, and those with a violation."""
    return {"answers": F.count(F.lit(1)), "blocked": F.count("violation")}


def observed(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and the observation that holds the metrics once they have been written."""
    seen = Observation()
    return df.observe(seen, *[value.alias(name) for name, value in metrics.items()]), seen


def observed_stream(stream: DataFrame, name: str, metrics: Mapping[str, Column]) -> DataFrame:
    """The same stream with metrics in the progress of every micro-batch, under a name."""
    return stream.observe(name, *[value.alias(key) for key, value in metrics.items()])


def stream_totals(query: StreamingQuery, name: str) -> dict[str, int]:
    """Observed counts of the micro-batches in the query's progress, added up."""
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for key, value in (row.asDict() if row is not None else {}).items():
            totals[key] = totals.get(key, 0) + (value or 0)
    return totals
