"""Expressions that read one logged provider exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlake.functions.text import lenient_bigint

# Host fragments in the order they are tried, and the provider each names.
PROVIDER_HOSTS = {
    "openai.com": "openai",
    "anthropic.com": "anthropic",
    "googleapis.com": "google",
    "azure.com": "azure",
}

# The governed route namespace and the capability prefix.
ROUTE_NAMESPACE = "wp-abilities/v1"
CAPABILITY_PREFIX = "wp_ability_"

_REQUEST_SCHEMA = "model STRING"
_RESPONSE_SCHEMA = (
    "usage STRUCT<prompt_tokens: STRING, input_tokens: STRING, completion_tokens: STRING, output_tokens: STRING>, "
    "usageMetadata STRUCT<promptTokenCount: STRING, candidatesTokenCount: STRING>"
)


def host(uri: Column) -> Column:
    return F.coalesce(F.try_parse_url(uri, F.lit("HOST")), F.lit(""))


def provider_of_host(name: Column) -> Column:
    """Provider a host belongs to, else the host itself."""
    named = F.when(F.lit(False), name)
    for fragment, provider_name in PROVIDER_HOSTS.items():
        named = named.when(name.contains(fragment), F.lit(provider_name))
    return named.otherwise(name)


def provider(uri: Column) -> Column:
    """Provider named by the host of a URI, else the host itself, else ''."""
    return provider_of_host(host(uri))


def model(request_body: Column) -> Column:
    return F.coalesce(F.from_json(request_body, _REQUEST_SCHEMA)["model"], F.lit(""))


def parse_response(response_body: Column) -> Column:
    """The token fields of a response body, null where it does not have them."""
    return F.from_json(response_body, _RESPONSE_SCHEMA)


def token_texts(response: Column, parse_usage_metadata: bool = False) -> tuple[Column, Column]:
    """Texts of the input and output counts of a parsed response.

    Each falls back on its own from the first field name to the second.
    ``parse_usage_metadata`` also reads ``usageMetadata`` bodies.
    """
    usage = response["usage"]
    sent = [usage["prompt_tokens"], usage["input_tokens"]]
    received = [usage["completion_tokens"], usage["output_tokens"]]
    if parse_usage_metadata:
        sent.append(response["usageMetadata"]["promptTokenCount"])
        received.append(response["usageMetadata"]["candidatesTokenCount"])
    return F.coalesce(*sent), F.coalesce(*received)


def variant_token_texts(response: Column, parse_usage_metadata: bool = False) -> tuple[Column, Column]:
    """``token_texts`` of a response body that is a VARIANT."""
    def field(path: str) -> Column:
        return F.try_variant_get(response, f"$.{path}", "string")

    sent, received = ["usage.prompt_tokens", "usage.input_tokens"], ["usage.completion_tokens", "usage.output_tokens"]
    if parse_usage_metadata:
        sent.append("usageMetadata.promptTokenCount")
        received.append("usageMetadata.candidatesTokenCount")
    return F.coalesce(*map(field, sent)), F.coalesce(*map(field, received))


def token_count(text: Column) -> Column:
    return F.coalesce(lenient_bigint(text), F.lit(0).cast("bigint"))


def tokens(response_body: Column, parse_usage_metadata: bool = False) -> Column:
    """Struct (tokens_input, tokens_output); both 0 when the body does not tell."""
    sent, received = token_texts(parse_response(response_body), parse_usage_metadata)
    return F.struct(token_count(sent).alias("tokens_input"), token_count(received).alias("tokens_output"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, truncated."""
    return F.call_function("div", F.unix_micros(end) - F.unix_micros(start), F.lit(1000).cast("bigint"))


def status(error_message: Column) -> Column:
    return F.when(error_message.isNotNull(), "error").otherwise("success")


def is_governed(route: Column) -> Column:
    return F.coalesce(route.contains(ROUTE_NAMESPACE), F.lit(False))


def ability_of_route(route: Column) -> Column:
    """``/wp-abilities/v1/ai/x/run`` gives ``ai/x``."""
    tail = F.regexp_replace(route, f"^/{ROUTE_NAMESPACE}/", "")
    return F.regexp_replace(tail, r"/(?:run|describe)[^\n]*$", "")


def ability_of_capability(capability: Column) -> Column:
    """``wp_ability_ai_x_y`` gives ``ai/x-y``."""
    name = F.substring(capability, F.lit(len(CAPABILITY_PREFIX) + 1), F.length(capability))
    return F.regexp_replace(F.replace(name, F.lit("_"), F.lit("-")), "^ai-", "ai/")


def is_ability_capability(capability: Column) -> Column:
    return F.coalesce(capability.startswith(CAPABILITY_PREFIX), F.lit(False))


def period(ts: Column) -> Column:
    """UTC month of a timestamp, given the session time zone is UTC."""
    return F.date_format(ts, "yyyy-MM")
