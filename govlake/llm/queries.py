"""One query per corpus operator over its whole table, and the SQL counterparts."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm import (
    decontaminate, importance, language_id, line_dedup, merkle, packing, pii, quality_rules, sharding, simhash,
    token_counts, tool_calls, variants,
)
from govlake.llm.common import table
from govlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).withColumn(
        "failed_rules", F.array_join("failed_rules", ",")
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
        "n_url", "n_account",
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", "text")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sample_tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas as they might stand behind a table of plain turns.

    Each assistant turn is a call that depends on the assistant turn before, each turn by a
    user is the result of the turn before it. Some turns make a second call that the first
    one needs. By turn and conversation some calls have a wrong type or a missing field, or
    arguments that are no JSON.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn, kind = F.col("turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    text = F.col("text")
    forms = [
        ("search", F.struct(text.alias("query"), turn.alias("limit"))),
        ("summarise", F.struct(text.alias("text"), F.length(text).alias("max_words"))),
        ("translate", F.struct(F.lit("fr").alias("to"), text.alias("text"))),
        ("search", F.struct(text.alias("query"), turn.cast("string").alias("limit"))),
        ("summarise", F.struct(text.alias("note"), F.lit(5).alias("max_words"))),
    ]
    name, arguments = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (tool, form) in enumerate(forms):
        name = F.when(kind == number, F.lit(tool)).otherwise(name)
        arguments = F.when(kind == number, F.to_json(form)).otherwise(arguments)
    broken = F.length(text) % 17 == 0
    prepared, before = kind == 2, F.concat(call_id(turn), F.lit("-first"))
    calls = rows.where("role = 'assistant'").select(
        "conv_id", call_id(turn).alias("call_id"), "turn", name.alias("name"),
        F.when(broken, F.concat(F.lit("!"), arguments)).otherwise(arguments).alias("arguments"),
        F.when(prepared, F.array(call_id(turn - 2), before)).otherwise(F.array(call_id(turn - 2))).alias("depends_on"),
    )
    first = rows.where((F.col("role") == "assistant") & prepared).select(
        "conv_id", before.alias("call_id"), "turn", F.lit("look").alias("name"), F.lit("{ }").alias("arguments"),
        F.array().cast("array<string>").alias("depends_on"),
    )
    calls = calls.unionByName(first)
    results = rows.where("role = 'user' and turn > 0").select(
        "conv_id", call_id(turn - 1).alias("call_id"), "turn", text.alias("content")
    )
    fields = [("search", "query", "string", True), ("search", "limit", "integer", False), ("summarise", "text", "string", True),
              ("summarise", "max_words", "number", False), ("translate", "text", "string", True), ("translate", "to", "string", True)]
    schemas = conversations.sparkSession.createDataFrame(fields, "name string, field string, type string, required boolean")
    return calls, results, schemas


@query
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link_tool_calls(*sample_tool_calls(table(spark, sf_dir, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", ","))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id's checksum 3 divides claim a text in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), claimed_text=F.when(tampered, lowered)))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by way of a new cache, which holds every distinct text afterwards."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
