"""Tool-call linking: calls and results by identifier, in topological order, validated, canonical.

Calls and results meet in an equality join on (conversation, identifier). Calls are put in
an order that keeps to their turns except where a call needs one that stands no earlier.
Arguments are parsed as variants and held against the tool's schema row by row. Records are serialised
as JSON with sorted keys and no white space. Everything is DataFrame expressions; no
conversation is ever gathered in a row or a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import own_columns, stored, with_rank

KEYS = ["conv_id", "call_id"]
TURNS_PER_BUCKET = 4096


def _first_of(rows: DataFrame, columns: list[str], count: str) -> DataFrame:
    """One row per identifier, the first in the order of its columns, and how many there were."""
    least = F.min(F.struct(*columns))
    return rows.where("call_id is not null").groupBy(*KEYS).agg(least.alias("_first"), F.count(F.lit(1)).alias(count)).select(
        *KEYS, *[F.col(f"_first.{c}").alias(c) for c in columns], count
    )


def call_order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, hops): a key that is greater than the key of every dependency.

    A call's key is (its turn, 0) unless a call it needs has that key or a greater one; then
    it comes one hop behind the last of those. So calls stay in their turn as far as their
    dependencies allow it, and only those that have to wait are looked at again: a round per
    hop, not per link of a chain that runs along the turns. Each round is written to the
    shared folder. Dependencies on calls that don't exist are ignored. Where calls wait for
    each other in a circle, which shows when there are more hops than calls that ever
    waited, the calls of the circle (and calls between two circles) have no row and count as
    missing to calls behind them; the others that waited start again from their own turn.
    """
    edges = calls.select(*KEYS, F.explode("depends_on").alias("needs")).where("needs is not null").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = stored(edges.join(known, ["conv_id", "needs"], "left_semi"), "call-edges")
    start = calls.select(*KEYS, F.col("turn").alias("at"), F.lit(0).alias("hops"), F.lit(False).alias("waited"))
    keys = start
    while True:
        needed = keys.select("conv_id", F.col("call_id").alias("needs"), F.struct("at", (F.col("hops") + 1).alias("hops")).alias("after"))
        late = edges.join(needed, ["conv_id", "needs"]).groupBy(*KEYS).agg(F.max("after").alias("after"))
        raised = keys.join(late, KEYS).where(F.struct("at", "hops") < F.col("after"))
        raised = stored(raised.select(*KEYS, "after.at", "after.hops", F.lit(True).alias("waited")), "call-keys")
        if raised.isEmpty():
            return keys.select(*KEYS, "at", "hops")
        keys = stored(keys.join(raised.select(*KEYS), KEYS, "left_anti").unionByName(raised), "call-keys")
        waiting = keys.where("waited").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        circles = keys.join(waiting, "conv_id").where("hops > n").select("conv_id").distinct()
        if not circles.isEmpty():
            back = stored(keys.where("waited").join(circles, "conv_id", "left_semi").select(*KEYS), "call-circles")
            again = start.join(back, KEYS, "left_semi").join(_circles(edges.join(back, KEYS, "left_semi")), KEYS, "left_anti")
            keys = stored(keys.join(back, KEYS, "left_anti").unionByName(again), "call-keys")


def _circles(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id) of the calls in circles or between two: what is left when calls that
    need none of the others and calls that none of the others needs are taken out, round by round.
    """
    edges = stored(edges, "call-circles")
    left = edges.count()
    while True:
        needing = edges.select("conv_id", F.col("call_id").alias("needs")).distinct()
        needed = edges.select("conv_id", F.col("needs").alias("call_id")).distinct()
        edges = stored(edges.join(needing, ["conv_id", "needs"], "left_semi").join(needed, KEYS, "left_semi"), "call-circles")
        before, left = left, edges.count()
        if left == before:
            return edges.select(*KEYS).distinct()


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    names = {"STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
             "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object", "VOID": "null"}
    out = F.lit("other")
    for start, name in names.items():
        out = F.when(kind.startswith(start), F.lit(name)).otherwise(out)
    return out


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``arguments_v`` (variant, null if not JSON), ``errors`` (sorted) and ``valid``.

    ``schemas`` has one row per field: name, field, type (a JSON type), required. A number
    may be an integer. Errors: not_json, not_object, unknown_tool, missing:f, type:f, unknown:f.
    """
    field = F.struct("field", F.struct("type", F.coalesce("required", F.lit(False)).alias("required")).alias("rule"))
    rows = schemas.where("name is not null and field is not null").groupBy("name", "field").agg(
        F.min("type").alias("type"), F.max("required").alias("required")
    )
    specs = rows.groupBy("name").agg(F.map_from_entries(F.collect_list(field)).alias("_spec"))
    parsed = calls.withColumn("arguments_v", F.try_parse_json("arguments")).join(specs, "name", "left")
    given = F.transform_values(F.from_json("arguments", "map<string,variant>"), lambda k, v: F.coalesce(_json_type(v), F.lit("null")))
    is_object = F.schema_of_variant("arguments_v").startswith("OBJECT")
    parsed = parsed.withColumn("_given", F.when(is_object, given))
    wrong = lambda type_, found: (found != type_) & ~((type_ == "number") & (found == "integer"))
    by_rule = F.transform(
        F.map_entries("_spec"),
        lambda e: F.when(
            ~F.map_contains_key("_given", e["key"]), F.when(e["value"]["required"], F.concat(F.lit("missing:"), e["key"]))
        ).when(wrong(e["value"]["type"], F.element_at("_given", e["key"])), F.concat(F.lit("type:"), e["key"])),
    )
    unknown = F.transform(
        F.map_keys("_given"), lambda k: F.when(~F.map_contains_key("_spec", k), F.concat(F.lit("unknown:"), k))
    )
    errors = (
        F.when(F.col("arguments_v").isNull(), F.array(F.lit("not_json")))
        .when(F.col("_given").isNull(), F.array(F.lit("not_object")))
        .when(F.col("_spec").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(F.array_sort(F.filter(F.concat(by_rule, unknown), lambda e: e.isNotNull())))
    )
    return parsed.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("_spec", "_given")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier of a conversation that has a call or a result.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of ids);
    ``results``: conv_id, call_id, turn, content; other columns are not carried. Of repeated
    calls or results with one identifier the first by turn counts; ``n_calls`` and
    ``n_results`` tell how many there were. Rows without an identifier are left out; a
    null conversation is one like any other but links nothing. Status: linked, early (the
    result stands before its call), unanswered, orphan (no call). ``position`` is the place
    in a topological order of the conversation's calls (see ``call_order``, then by turn and
    id); calls of a circle have none, nor have orphans. ``hops`` tells how many calls
    a call waits for behind its turn. ``line`` is the canonical JSON of the record.
    """
    calls = own_columns(calls, "conv_id", "call_id", "turn", "name", "arguments", "depends_on")
    results = own_columns(results, "conv_id", "call_id", "turn", "content")
    calls = stored(_first_of(calls, ["turn", "name", "arguments", "depends_on"], "n_calls"), "calls")
    results = _first_of(results, ["turn", "content"], "n_results").withColumnRenamed("turn", "result_turn")
    ordered = calls.select(*KEYS, "turn").join(call_order(calls), KEYS)
    # Turns are dealt into buckets, so that no long conversation is sorted in one task.
    bucket = F.floor(F.coalesce("at", F.lit(-1)) / TURNS_PER_BUCKET)
    ordered = with_rank(ordered, ["conv_id"], ["at", "hops", "turn", "call_id"], bucket, "position").select(*KEYS, "hops", "position")
    checked = validate(calls, schemas).join(ordered, KEYS, "left")
    linked = checked.join(results, KEYS, "full")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    )
    line = F.to_json(F.struct(
        F.col("arguments_v").alias("arguments"), F.array_sort(F.array_distinct("depends_on")).alias("depends_on"), F.col("call_id").alias("id"),
        "name", F.col("content").alias("result"),
    ))
    return linked.select(
        *KEYS, "turn", "result_turn", "name", "hops", "position", status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "valid", "errors", line.alias("line"),
    )
