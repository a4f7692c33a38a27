"""The rollup in buckets by user."""

import pytest
from pyspark.sql import functions as F

from govlake.operators import budget, requests, usage
from govlake.sources import colocated, sample


@pytest.fixture(scope="module")
def rolled(spark):
    costed = usage.request_cost(requests.shape_requests(sample.exchange(spark, "/root/testdata/sf0.001"))).cache()
    even = F.col("request_id") % 2 == 0
    return tuple(usage.usage_rollup(part).cache() for part in (costed, costed.where(even), costed.where(~even)))


def rows(frame):
    return sorted((tuple(r) for r in frame.select(*usage.USAGE_KEYS, *usage.COUNTERS, "updated_at").collect()), key=repr)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_upserts_equal_the_rollup(spark, rolled):
    whole, first, second = rolled
    table = colocated.store(first, 8)
    upserted = colocated.upsert(spark, table, second)
    assert rows(upserted.read(spark)) == rows(whole) and rows(table.read(spark)) == rows(first)
    again = colocated.upsert(spark, upserted, second.where("false"))
    assert rows(again.read(spark)) == rows(whole)
    nameless = first.limit(1).withColumn("user_id", F.lit(None).cast("bigint"))
    twice = colocated.upsert(spark, colocated.upsert(spark, again, nameless), nameless)
    assert [r[4] for r in rows(twice.read(spark)) if r[0] is None] == [nameless.first()["requests"]] * 2
    # Every version keeps the buckets: a user is in one file.
    files = twice.read(spark).where("user_id IS NOT NULL").select("user_id", F.input_file_name().alias("file")).distinct().groupBy("user_id").count()
    assert files.agg(F.max("count")).first()[0] == 1


def test_the_state_is_not_shuffled(spark, rolled, without_broadcast):
    whole, first, second = rolled
    table = colocated.store(first, 8)
    spend = plan(usage.spend_by_user(table.read(spark)))
    assert "Exchange" not in spend
    second = spark.createDataFrame(second.collect(), second.schema)  # so that the plan shows no more than the join
    checks = second.select("user_id", F.lit("wp_ability_x").alias("capability"), F.lit(False).alias("exempt"), F.lit(True).alias("granted"))
    gate = plan(budget.budget_gate(checks, table.read(spark), "0.05", "2024-01"))
    assert gate.count("Exchange") == 1 and "Exchange" not in gate[gate.index("HashAggregate"):]
    with colocated._settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__shuffle__partitions="8"):
        found = plan(colocated.added(table.read(spark), second))
    assert found.count("Exchange") == 1 and "Bucketed: true" in found


def test_gate_from_buckets_equals_the_gate(spark, rolled):
    whole, _, _ = rolled
    checks = whole.select("user_id", F.lit("wp_ability_x").alias("capability"), (F.col("user_id") % 3 == 0).alias("exempt"), F.lit(True).alias("granted"))
    found, wanted = (sorted(map(tuple, budget.budget_gate(checks, state, "0.05", "2024-01").collect()))
                     for state in (colocated.store(whole, 8).read(spark), whole))
    assert found == wanted and {r[-1] for r in found} == {True, False}
