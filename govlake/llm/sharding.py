"""Balanced label propagation: documents to shards of equal counts, linked ones together.

Documents with equal texts form a unit (a group larger than ``unit_rows`` is dealt into
several by a hash of the id). Units are linked through hubs: the text they share and every
longer line they share. In each round a hub votes for the shard that holds most of its
documents, a unit wants the shard its hubs give most weight, and moves from one shard to
another are admitted up to a quota: what moves the other way, and what the target still has
room for. The admitted share of a direction is a threshold on a hash, so no round sorts or
gathers anything larger than a table of shard pairs.

The last step makes the counts exact: each shard keeps its first documents up to its quota,
linked units before those that nothing ties to it, and the others fill the gaps of the shards
that have too few. Ranks come from counts per bucket
and a row number inside a bucket. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import own_columns, stored, with_rank

N_SHARDS = 24
# Rounds go on until less than this share of the documents may move, and end in any case after so many.
MOVED_SHARE = 0.0001
ROUNDS = 16
MIN_LINE_CHARS = 40
# Documents of equal text that move as one; buckets that ranks are counted in.
UNIT_ROWS = 4096
BUCKETS = 256


def _units(docs: DataFrame, unit_rows: int) -> DataFrame:
    """doc_id, size, text_crc32, text_key, unit and the hubs (line hashes) of every document."""
    text = F.coalesce("text", F.lit(""))
    longer = F.filter(F.split(text, "\n"), lambda line: F.length(line) >= MIN_LINE_CHARS)
    return own_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_key"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("spread")), F.lit(1 << 20)).alias("spread"),
        F.array_distinct(F.transform(longer, lambda line: F.xxhash64(line))).alias("lines"),
    )


def propagate(members: DataFrame, weights: DataFrame, n_shards: int, rounds: int) -> DataFrame:
    """(unit, shard) when few units move any more, after ``rounds`` at the latest; ``members`` are (hub, unit), ``weights`` (unit, w)."""
    shards = stored(weights.select("unit", "w", F.pmod(F.xxhash64("hub0"), F.lit(n_shards)).cast("int").alias("shard")), "shards")
    total = shards.agg(F.sum("w")).first()[0] or 0
    room = total / n_shards * 1.02
    for number in range(rounds):
        held = members.join(shards, "unit")
        tally = held.groupBy("hub", "shard").agg(F.sum("w").alias("w"))
        # Votes count for less the more documents a hub has; a tie goes to the smaller shard number.
        votes = tally.groupBy("hub").agg(
            F.max_by("shard", F.struct("w", -F.col("shard"))).alias("vote"), F.sum("w").alias("all"), F.max("w").alias("most")
        ).select("hub", "vote", (F.col("most") / F.col("all")).alias("weight"))
        # Written first, so that the join below may split a hub with very many members.
        votes = stored(votes, "votes")
        wanted = members.join(votes, "hub").groupBy("unit", "vote").agg(F.sum("weight").alias("weight"))
        wanted = wanted.groupBy("unit").agg(F.max_by("vote", F.struct("weight", -F.col("vote"))).alias("wish"))
        wishes = stored(
            shards.join(wanted, "unit", "left").select("unit", "w", "shard", F.coalesce("wish", "shard").alias("wish")), "wishes"
        )
        # One row per pair of shards: what wants to move, and the share of it that may.
        flow = wishes.groupBy("shard", "wish").agg(F.sum("w").alias("w"))
        stock = flow.groupBy("shard").agg(F.sum("w").alias("stock")).collect()
        gaps = {r["shard"]: max(0.0, room - r["stock"]) for r in stock}
        moves = {(r["shard"], r["wish"]): r["w"] for r in flow.where("shard != wish").collect()}
        asked = {t: sum(w for (_, to), w in moves.items() if to == t) for t in range(n_shards)}
        share = {
            (a, b): min(1.0, (moves.get((b, a), 0) + gaps.get(b, room) * w / asked[b]) / w) for (a, b), w in moves.items()
        }
        if sum(w * share[pair] for pair, w in moves.items()) <= MOVED_SHARE * total:
            break
        table = F.create_map(*[x for (a, b), s in share.items() for x in (F.lit(a * n_shards + b), F.lit(s))])
        luck = F.pmod(F.xxhash64("unit", F.lit(number)), F.lit(1 << 20)) / F.lit(1 << 20)
        admitted = (F.col("wish") != F.col("shard")) & (luck < F.coalesce(table[F.col("shard") * n_shards + F.col("wish")], F.lit(0.0)))
        shards = stored(wishes.select("unit", "w", F.when(admitted, F.col("wish")).otherwise(F.col("shard")).alias("shard")), "shards")
    return shards.select("unit", "shard")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard and slot of every document.

    Counts of shards differ by one at most; slots are gapless from 0 in each shard. A null
    text has no bytes (size 8) and is equal to an empty one. Repeated rows are placed each by
    itself, next to each other. An empty table stays empty; other columns are not carried.
    """
    rows = stored(_units(docs, unit_rows), "documents")
    groups = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    # Groups of over unit_rows documents, so at most one for each unit_rows documents. Written
    # first: its size is then known to the planner, and the join needn't bring a group together.
    large = stored(groups.where(F.col("n") > unit_rows).select("text_key", F.ceil(F.col("n") / unit_rows).alias("parts")), "large")
    rows = stored(
        rows.join(large, "text_key", "left").withColumn("unit", F.xxhash64("text_key", F.floor(F.col("spread") * F.coalesce("parts", F.lit(1)) / (1 << 20)))),
        "units",
    )
    weights = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("w"), F.first("text_key").alias("hub0"))
    lines = rows.select("unit", F.explode(F.concat(F.array("text_key"), "lines")).alias("hub")).distinct()
    shared = lines.groupBy("hub").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).where("least != most").select("hub")
    shared = stored(shared, "shared")
    members = stored(lines.join(shared, "hub"), "members")
    linked = members.select("unit", F.lit(True).alias("linked")).distinct()
    labels = propagate(members, weights, n_shards, rounds).join(linked, "unit", "left")

    placed = stored(
        rows.join(labels, "unit").select("doc_id", "size", "text_crc32", "text_key", "unit", "spread", "shard", F.coalesce("linked", F.lit(False)).alias("linked")), "placed"
    )
    n_docs = placed.count()
    quota = F.lit(n_docs // n_shards) + (F.col("shard") < n_docs % n_shards).cast("int")
    # Units without a link come last in their shard, so they are the first to go where it is too full.
    bucket = F.pmod("unit", F.lit(BUCKETS // 2)) + F.when(F.col("linked"), 0).otherwise(BUCKETS // 2)
    order = ["unit", "spread", "doc_id"]
    ranked = stored(with_rank(placed, ["shard"], order, bucket, "rank", few_buckets=True).withColumn("stays", F.col("rank") < quota), "ranked")
    kept = ranked.where("stays").withColumn("slot", F.col("rank"))
    # Gaps, in the order of shards, are filled by the documents that found no place, in order.
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for shard in range(n_shards):
        have, want = held.get(shard, 0), n_docs // n_shards + (shard < n_docs % n_shards)
        if want > have:
            starts.append((shard, at, have))
            at += want - have
    moved = ranked.where("not stays").drop("rank", "stays").withColumn("_from", F.col("shard")).withColumn("_all", F.lit(0))
    moved = with_rank(moved, ["_all"], ["_from", *order], F.col("_from") * BUCKETS + bucket, "rank", few_buckets=True)
    if starts:
        gaps = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("bigint").alias("start"), F.lit(h).cast("bigint").alias("have")) for s, a, h in starts])
        gap = F.element_at(F.filter(gaps, lambda g: g["start"] <= F.col("rank")), -1)
        moved = moved.withColumn("_gap", gap).select(
            "doc_id", "size", "text_crc32", "text_key", F.col("_gap.shard").alias("shard"),
            (F.col("_gap.have") + F.col("rank") - F.col("_gap.start")).alias("slot"),
        )
    else:
        moved = moved.withColumn("slot", F.col("rank"))
    columns = ["doc_id", "size", "text_crc32", "text_key", "shard", "slot"]
    return kept.select(*columns).unionByName(moved.select(*columns))
