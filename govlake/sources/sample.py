"""The engine's input tables derived from the sample tables.

Only deterministic arithmetic is used, so another SQL engine can build the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions.guidelines import META_PREFIX
from govlake.policy import ABILITIES, DEFAULT_ROLE_MAP, POLICY_DEFAULTS, RateWindow
from govlake.sources.tables import local_rows, sample_table

SITES = 40
CAP_USD = "0.10"
RATE_WINDOWS = (RateWindow("hour", 3_600, 1), RateWindow("day", 86_400, 2))
SHARED_WINDOWS = (RateWindow("hour", 3_600, 3), RateWindow("day", 86_400, 20))
BANNED = ("", "Erblest", "ouche", "TION DE", "never said")
DISABLED = ("AI/Image-Generation", "ai/summarization!")
ROLE_MAP = {**DEFAULT_ROLE_MAP, "ai/editorial-notes": [], "ai/title-generation": ["administrator", "editor", "author"]}
ALLOWLIST = (("text", "openai", "m-0"), ("text", "anthropic", "m-1"), ("text", "google", "m-2"),
             ("vision", "openai", "m-1"))
PRICES = (("openai", "m-1", "0.0025", "0.010"), ("anthropic", "m-0", "0.00075", "0.0055"))


def pick(index: Column, values) -> Column:
    """The text at a 0-based index."""
    quoted = ", ".join(f"'{v}'" for v in values)
    return F.get(F.expr(f"array({quoted})"), index.cast("int"))


def _prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _ability(index: Column) -> Column:
    return pick(index, ABILITIES)


def _ability_index() -> Column:
    half = F.floor(F.col("event_id") / 2)
    return F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(half % 12)


def _micros_later(ts: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def exchange_of(events: DataFrame) -> DataFrame:
    """Raw provider calls; half of the traffic is on one ability."""
    k = F.col("k")
    sent = F.floor(F.col("value") * 10).cast("string")
    got = F.floor(F.col("value") * 2).cast("string")
    body = (
        F.when(k % 5 == 1, F.concat(F.lit('{"usage":{"input_tokens":'), sent, F.lit(',"output_tokens":'), got, F.lit("}}")))
        .when(k % 5 == 2, F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), sent, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"usage":{"prompt_tokens":'), sent, F.lit(',"completion_tokens":'), got, F.lit("}}")))
    )
    failed = F.col("event_type") == "error"
    return events.withColumn("k", _prop_k()).select(
        F.col("event_id").alias("request_id"), "ts",
        _micros_later(F.col("ts"), k * F.lit(7_000)).alias("end_ts"),
        "user_id",
        F.concat(F.lit("/wp-abilities/v1/"), _ability(_ability_index()), F.lit("/run")).alias("route"),
        pick(k % 5, (
            "https://api.openai.com/v1/responses", "https://api.anthropic.com/v1/messages",
            "https://generativelanguage.googleapis.com/v1/models", "https://acme.openai.azure.com/openai/v1",
            "https://llm.internal.example/v1",
        )).alias("uri"),
        F.when(k % 25 == 24, F.lit("not json")).when(k % 5 == 3, F.lit("{}"))
        .otherwise(F.concat(F.lit('{"model":"m-'), (k % 3).cast("string"), F.lit('"}'))).alias("request_body"),
        F.when(~failed, body).alias("response_body"),
        F.when(failed, F.lit("timeout")).alias("error_message"),
    )


def exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange_of(sample_table(spark, sf_dir, "events"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = pick(F.col("user_id") % 5, ("administrator", "editor", "author", "contributor", "subscriber"))
    return sample_table(spark, sf_dir, "events").select("user_id").distinct().select(
        "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_login"),
        F.when(F.col("user_id") % 10 == 3, F.array(role, F.lit("editor"))).otherwise(F.array(role)).alias("roles"),
        (F.col("user_id") % 5 == 0).alias("manage_options"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(sample_table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """Prompted calls with their payload."""
    ability = _ability(_ability_index())
    return events.select(
        F.col("event_id").alias("request_id"), "ts", "user_id", (F.col("user_id") % SITES).alias("site_id"),
        ability.alias("ability_id"),
        F.concat(F.lit(" \tDefault for "), ability, F.lit(".\n ")).alias("instruction"),
        F.create_map(
            F.lit("post_id"), F.floor(F.col("event_id") / 8).cast("string"),
            F.lit("Tone"), F.concat(F.lit("{ability} $1 "), F.col("event_type")),
        ).alias("payload"),
    )


def prompt_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_edits_of(sample_table(spark, sf_dir, "events"))


def prompt_edits_of(events: DataFrame) -> DataFrame:
    tail = pick(F.col("event_id") % 3, (
        "{post_title} {unknown} {current_date}", "{TONE} as {user_role}: {guidelines_copy}",
        "{ability} by {User_Login} for {site_name} {a-b}",
    ))
    return events.select(
        F.col("event_id").alias("edit_id"),
        _ability(F.col("user_id") % 12).alias("ability_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("action"),
        pick(_prop_k() % 4, ("prepend", "append", "replace", "bogus")).alias("mode"),
        F.concat(F.lit("T"), F.col("event_id").cast("string"), F.lit(" "), tail).alias("template"),
        F.col("user_id").alias("updated_by"), F.col("ts").alias("updated_at"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content under review, with four kinds of block markup."""
    text = F.col("text")
    paragraph = F.concat(F.lit("<!-- wp:paragraph -->\n<p>"), text, F.lit("</p>\n<!-- /wp:paragraph -->"))
    group = F.concat(
        F.lit('<!-- wp:group {"layout":{"type":"flex"}} -->\n<!-- wp:paragraph -->\n<p>'), text,
        F.lit('</p>\n<!-- /wp:paragraph -->\n<!-- wp:image {"id":7} /-->\n<!-- /wp:group -->'),
    )
    card = F.lit("<!-- wp:acme/card /-->")
    kind = F.col("doc_id") % 4
    return sample_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), (F.col("doc_id") % SITES).alias("site_id"),
        F.concat(F.lit("On "), F.md5("text")).alias("post_title"),
        pick(F.col("doc_id") % 2, ("post", "page")).alias("post_type"),
        pick(F.col("doc_id") % 3, ("draft", "publish", "publish")).alias("post_status"),
        F.when(kind == 0, text).when(kind == 1, paragraph).when(kind == 2, group).otherwise(card).alias("post_content"),
    )


def _guideline_date() -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return _micros_later(start, (F.col("doc_id") * 7 % 1000) * F.lit(3_600_000_000))


def guideline_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), (F.col("doc_id") % SITES).alias("site_id"),
        F.when(F.col("doc_id") % 7 == 6, "wp_content_guideline").otherwise("wp_guideline").alias("post_type"),
        pick(F.col("doc_id") % 5, ("publish", "draft", "publish", "trash", "publish")).alias("post_status"),
        _guideline_date().alias("post_date"),
        F.when(F.col("doc_id") % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("content"))).alias("terms"),
    )


def guideline_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows of the guideline posts: duplicates, empty and padded values included."""
    doc = F.col("doc_id")
    rows = [
        (META_PREFIX + "site", F.concat(F.lit("\n Read as "), F.md5("text"), F.lit(" "))),
        (META_PREFIX + "copy", F.concat(F.lit("Tone "), F.col("lang"), F.lit("."))),
        (META_PREFIX + "copy", F.lit("ignored")),
        (META_PREFIX + "images", F.when(doc % 4 == 0, F.lit("")).otherwise(F.col("lang"))),
        (META_PREFIX + "additional", F.concat(F.lit(" \n"), F.col("source"), F.lit("\t "))),
        (META_PREFIX + "block_core_paragraph", F.lit("Short sentences.")),
        (META_PREFIX + "block_core_image", F.when(doc % 2 == 0, F.concat(F.lit("Alt text "), F.col("lang"))).otherwise(F.lit("   "))),
        (META_PREFIX + "block_acme_card_wide", F.concat(F.lit("Card "), doc.cast("string"))),
        ("_edit_lock", F.lit("1")),
    ]
    packed = F.array(*[
        F.struct((doc * 10 + i).alias("meta_id"), F.lit(key).alias("meta_key"), value.alias("meta_value"))
        for i, (key, value) in enumerate(rows)
    ])
    return sample_table(spark, sf_dir, "documents").select(doc.alias("post_id"), F.inline(packed))


def guideline_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No, one or two revisions per guideline post."""
    number = F.explode(F.expr("CASE doc_id % 3 WHEN 0 THEN array() WHEN 1 THEN array(0) ELSE array(0, 1) END"))
    numbered = sample_table(spark, sf_dir, "documents").select("doc_id", number.alias("n"))
    return numbered.select(
        (F.col("doc_id") * 100 + F.col("n")).alias("revision_id"), F.col("doc_id").alias("post_id"),
        _micros_later(_guideline_date(), F.col("n") * F.lit(86_400_000_000)).alias("post_modified"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs_of(sample_table(spark, sf_dir, "conversations"))


def outputs_of(conversations: DataFrame) -> DataFrame:
    """Provider answers to moderate; the text sits under one of four keys."""
    key = pick((F.col("conv_id") + F.col("turn")) % 4, ("result", "output", "text", "content"))
    body = F.concat(
        F.lit('{"meta":{"text":"nested"},"'), key, F.lit('":'),
        F.when(F.col("conv_id") % 11 == 0, F.lit("7")).otherwise(
            F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)),
        F.lit("}"),
    )
    return conversations.where("role = 'assistant'").select("conv_id", "turn", body.alias("body"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option changes per site, one unknown option among them."""
    return sample_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"),
        pick(F.col("event_id") % 10, (*POLICY_DEFAULTS, "vault_enabled")).alias("key"),
        _prop_k().cast("string").alias("value"), F.col("event_id").alias("version"),
    )


def registered_abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities registered per site, most of them again and again, some without a label or a
    default; every third site registers none below ``ai/``."""
    group = F.when(F.col("user_id") % 3 == 0, "core/").otherwise("ai/")
    number = F.col("event_id").cast("string")
    return sample_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site_id"), F.concat(group, F.col("event_type")).alias("ability_id"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.initcap("event_type"), F.lit(" "), number)).alias("label"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Version "), number)).alias("description"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("Do "), number)).alias("default_instruction"),
        F.col("event_id").alias("pos"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site: those of users and those of posts."""
    owners = sample_table(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"))
    return owners.union(sample_table(spark, sf_dir, "documents").select(F.col("doc_id") % SITES)).distinct()


def role_map(spark: SparkSession) -> DataFrame:
    return local_rows(spark, ROLE_MAP.items(), "ability_id STRING, roles ARRAY<STRING>")


def allowlist(spark: SparkSession) -> DataFrame:
    return local_rows(spark, ALLOWLIST, "capability STRING, provider STRING, model STRING")


def prices(spark: SparkSession) -> DataFrame:
    raw = local_rows(spark, PRICES, "provider STRING, model STRING, rate_in STRING, rate_out STRING")
    return raw.select("provider", "model", F.col("rate_in").cast("decimal(12,9)").alias("rate_in"),
                      F.col("rate_out").cast("decimal(12,9)").alias("rate_out"))


def abilities(spark: SparkSession) -> DataFrame:
    rows = [(i, a, label) for i, (a, label) in enumerate(ABILITIES.items())]
    return local_rows(spark, rows, "pos INT, ability_id STRING, label STRING")


def capability_kind(ability: Column) -> Column:
    return (
        F.when(ability == "ai/image-generation", "image").when(ability == "ai/alt-text-generation", "vision").otherwise("text")
    )
