"""From the raw provider exchange to the request event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.functions import requests as rq


def shape_requests(exchange: DataFrame, parse_usage_metadata: bool = False) -> DataFrame:
    """One event per exchange; failed calls have no response and count no tokens.

    Host, body and count texts are columns of their own, so that each is read once per row.
    """
    parsed = exchange.withColumn("_response", rq.parse_response(F.col("response_body")))
    return _events(parsed, rq.model(F.col("request_body")), *rq.token_texts(F.col("_response"), parse_usage_metadata))


def shape_parsed(parsed: DataFrame, parse_usage_metadata: bool = False) -> DataFrame:
    """The same events from exchanges whose bodies are VARIANT values (``sources.raw``)."""
    model = F.coalesce(F.try_variant_get("request", "$.model", "string"), F.lit(""))
    return _events(parsed, model, *rq.variant_token_texts(F.col("response"), parse_usage_metadata))


def _events(parsed: DataFrame, model: Column, sent: Column, received: Column) -> DataFrame:
    read = parsed.withColumn("_host", rq.host(F.col("uri"))).withColumns({"_model": model, "_sent": sent, "_received": received})
    return read.select(
        "request_id", "ts", F.coalesce("user_id", F.lit(0).cast("bigint")).alias("user_id"),
        rq.ability_of_route(F.col("route")).alias("ability_id"),
        rq.provider_of_host(F.col("_host")).alias("provider"),
        F.col("_model").alias("model"),
        rq.duration_ms(F.col("ts"), F.col("end_ts")).alias("duration_ms"),
        rq.token_count(F.col("_sent")).alias("tokens_input"),
        rq.token_count(F.col("_received")).alias("tokens_output"),
        rq.status(F.col("error_message")).alias("status"),
        "error_message", "uri",
    )


def governed(requests: DataFrame) -> DataFrame:
    """Requests on governed routes, with the ability each one invokes."""
    return requests.where(rq.is_governed(F.col("route"))).withColumn(
        "ability_id", rq.ability_of_route(F.col("route"))
    )


def dedupe(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Drop redelivered events; the rollup is additive and would count them twice."""
    return events.dropDuplicates([key])
