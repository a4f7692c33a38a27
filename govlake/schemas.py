"""Explicit input schemas; nothing is inferred."""

from __future__ import annotations

SAMPLE_TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}

EXCHANGE = (
    "request_id BIGINT, ts TIMESTAMP, end_ts TIMESTAMP, user_id BIGINT, route STRING, uri STRING, "
    "request_body STRING, response_body STRING, error_message STRING"
)

REQUEST_EVENT = (
    "request_id BIGINT, ts TIMESTAMP, user_id BIGINT, ability_id STRING, provider STRING, model STRING, "
    "duration_ms BIGINT, tokens_input BIGINT, tokens_output BIGINT, status STRING, error_message STRING, uri STRING"
)

USAGE = (
    "user_id BIGINT, period STRING, provider STRING, model STRING, requests BIGINT, tokens_in BIGINT, "
    "tokens_out BIGINT, usd_micros BIGINT, updated_at TIMESTAMP"
)

PRICES = "provider STRING, model STRING, rate_in DECIMAL(12,9), rate_out DECIMAL(12,9)"

PROMPT_EDITS = (
    "edit_id BIGINT, ability_id STRING, action STRING, mode STRING, template STRING, "
    "updated_by BIGINT, updated_at TIMESTAMP"
)
