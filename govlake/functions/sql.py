"""The governance rules as SQL functions, for users who write queries in SQL alone.

Each function is the SQL form of a column rule of this package, made from the same fixed values;
``register`` defines them for the session. Spark inlines them, so plans are those of the rules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from govlake.functions import pii, requests
from govlake.functions.text import _NUMBER_PREFIX
from govlake.policy import DEFAULT_RATE_IN, DEFAULT_RATE_OUT, PII_PATTERNS


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _provider() -> str:
    host = "coalesce(try_parse_url(uri, 'HOST'), '')"
    cases = " ".join(f"WHEN contains({host}, {quoted(f)}) THEN {quoted(name)}" for f, name in requests.PROVIDER_HOSTS.items())
    return f"CASE {cases} ELSE {host} END"


def _lenient(text: str) -> str:
    """Number at the start of a text, truncated; anything else is 0."""
    number = f"regexp_extract({text}, {quoted(_NUMBER_PREFIX)}, 1)"
    return (f"coalesce(try_cast({text} AS BIGINT), try_cast(try_cast({number} AS DOUBLE) AS BIGINT), "
            f"CASE WHEN {text} = 'true' THEN 1L END, CASE WHEN {text} IS NOT NULL THEN 0L END, 0L)")


def _tokens(first: str, second: str) -> str:
    body = f"from_json(response_body, {quoted(requests._RESPONSE_SCHEMA)}).usage"
    return _lenient(f"coalesce({body}.{first}, {body}.{second})")


def _price() -> str:
    """In decimals: micro-USD of both sides, rounded half away from zero."""
    sides = " + ".join(
        f"coalesce({tokens}, 0L)::DECIMAL(19,0) * ((coalesce({rate}, {default}::DECIMAL(12,9)) * 1000000000)::BIGINT)::DECIMAL(18,0)"
        for tokens, rate, default in (("tokens_in", "rate_in", DEFAULT_RATE_IN), ("tokens_out", "rate_out", DEFAULT_RATE_OUT))
    )
    return f"round(({sides}) * 0.000001::DECIMAL(6,6), 0)::DECIMAL(38,0)::BIGINT"


def _redacted(patterns: Mapping[str, str]) -> str:
    text = "text"
    for label, pattern in patterns.items():
        mark = f"[REDACTED:{label}]".replace("\\", "\\\\").replace("$", "\\$")
        text = f"regexp_replace({text}, {quoted(pii.java_pattern(pattern))}, {quoted(mark)})"
    return text


def definitions(patterns: Mapping[str, str] = PII_PATTERNS) -> dict[str, str]:
    """Signature and body of each function, by name."""
    return {
        "gov_provider": f"(uri STRING) RETURNS STRING RETURN {_provider()}",
        "gov_model": f"(request_body STRING) RETURNS STRING RETURN coalesce(from_json(request_body, {quoted(requests._REQUEST_SCHEMA)}).model, '')",
        "gov_tokens_in": f"(response_body STRING) RETURNS BIGINT RETURN {_tokens('prompt_tokens', 'input_tokens')}",
        "gov_tokens_out": f"(response_body STRING) RETURNS BIGINT RETURN {_tokens('completion_tokens', 'output_tokens')}",
        "gov_status": "(error_message STRING) RETURNS STRING RETURN CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END",
        "gov_period": "(ts TIMESTAMP) RETURNS STRING RETURN date_format(ts, 'yyyy-MM')",
        "gov_price_micros": f"(tokens_in BIGINT, tokens_out BIGINT, rate_in DECIMAL(12,9) DEFAULT NULL, rate_out DECIMAL(12,9) DEFAULT NULL) RETURNS BIGINT RETURN {_price()}",
        "gov_redact": f"(text STRING) RETURNS STRING RETURN {_redacted(patterns)}",
    }


def register(spark: SparkSession, patterns: Mapping[str, str] = PII_PATTERNS) -> list[str]:
    """Define the functions for the session; the names of those defined."""
    made = definitions(patterns)
    for name, definition in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return list(made)
