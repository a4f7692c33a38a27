import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from govlake.operators import budget, ratelimit, requests, retention, usage
from govlake.plans import jobs
from govlake.policy import RateWindow
from govlake.session import clear_scratch, scratch_path, shared_dir
from govlake.sources import files as fs
from govlake.sources import sample, sinks
from govlake.sources.tables import stream_table
from govlake.streaming import scrub
from govlake.streaming import ratelimit as limits
from govlake.streaming import usage as live
from govlake.streaming.keyed import fold_batch, folded_stream
from govlake.streaming.run import drain, stateful, to_table

WINDOWS = [RateWindow("minute", 60, 3), RateWindow("day", 600, 9)]


@pytest.fixture
def exchange(spark, sf_dir):
    return sample.exchange(spark, sf_dir)


def files(frame, folder, order):
    """Write a frame as several files, in the given row order."""
    frame.repartition(1).sortWithinPartitions(order).write.option("maxRecordsPerFile", 200).mode("overwrite").parquet(str(folder))


def stream(spark, frame, folder):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    return stream_table(spark, str(folder), schema, maxFilesPerTrigger="1")


def table(frame):
    return sorted(tuple(r) for r in frame.select("user_id", "period", "provider", "model", "requests", "usd_micros").collect())


def test_stream_rollup_counts_redelivered_events_once(spark, exchange, tmp_path):
    again = exchange.where("request_id % 10 = 0")
    mixed = exchange.unionByName(again).orderBy(F.xxhash64("request_id", F.rand(3)))
    mixed.repartition(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    streamed = live.stream_usage(stream(spark, exchange, tmp_path / "in"), horizon="40 days")
    wanted = usage.usage_rollup(usage.request_cost(requests.shape_requests(exchange)))
    assert table(streamed) == table(wanted)


def test_ids_are_kept_for_the_horizon_only(spark, exchange, tmp_path):
    """In order, with events delivered again within the horizon and events without an id."""
    again = exchange.where("request_id % 10 = 0").withColumn("arrival", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    nameless = exchange.where("request_id % 7 = 0").withColumn("request_id", F.lit(None).cast("bigint"))
    nameless = nameless.unionByName(nameless).withColumn("arrival", F.col("ts"))
    everything = exchange.withColumn("arrival", F.col("ts")).unionByName(again).unionByName(nameless)
    files(everything, tmp_path / "in", "arrival")
    unique = live.once(stream(spark, everything, tmp_path / "in"), "1 day")
    with stateful(spark, 2):
        query = to_table(unique, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.where("request_id IS NOT NULL").count() == exchange.count()
    assert found.where("request_id IS NULL").count() == nameless.count()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # A day of about thirty, and the rows of one file that are taken up before old ones go.
    assert len(kept) >= 5 and max(kept) < 400 < everything.count()


def test_replayed_batch_overwrites_itself(spark, exchange, tmp_path):
    rolled = usage.usage_rollup(usage.request_cost(requests.shape_requests(exchange)))
    for batch in (0, 0, 1):
        sinks.write_usage_delta(rolled.where(f"user_id % 2 = {batch}"), str(tmp_path / "deltas"), batch)
    assert table(sinks.read_usage_deltas(spark, str(tmp_path / "deltas"))) == table(rolled)


def limiter_log(spark, n=2000):
    rng = random.Random(8)
    base = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()) * 1000
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.choice(["a", "b"]), base + rng.randint(0, 5000_000)) for i in range(n)]
    return spark.createDataFrame(rows, "request_id BIGINT, user_id BIGINT, ability_id STRING, ms BIGINT").select(
        "request_id", "user_id", "ability_id", F.timestamp_millis("ms").alias("ts"), (F.col("ms") + F.col("request_id") * 37 % 40_000).alias("arrival"))


def per_tick(frame):
    return {(r["user_id"], r["ability_id"], r["tick"]): (r["requests"], r["allowed"]) for r in frame.collect()}


@pytest.mark.parametrize("order", ["ts", "arrival", "shuffled"])
def test_stream_limits_equal_the_replay(spark, tmp_path, order):
    """Every request is decided as in the batch replay: in order, mixed within the delay, and late."""
    log = limiter_log(spark).withColumn("shuffled", F.xxhash64("request_id"))
    log = log.withColumn("user_id", F.when((F.col("user_id") != 0) | (F.col("request_id") % 2 == 0), F.col("user_id"))).cache()
    files(log, tmp_path / "in", order)
    got = per_tick(limits.stream_rate_limits(stream(spark, log, tmp_path / "in"), WINDOWS, root=str(tmp_path / "state"), log=log))
    replay = ratelimit.rate_limit_replay(log, WINDOWS).groupBy(
        F.coalesce("user_id", F.lit(0)).alias("user_id"), "ability_id", ratelimit.tick_of(F.col("ts")).alias("tick")
    ).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("rate_decision") == "allowed").alias("allowed"))
    assert got == per_tick(replay)
    assert sum(n for n, _ in got.values()) == log.count() and any(n > ok for n, ok in got.values())
    # What the stream itself decided: nearly all in order or mixed within the delay, less if events come late.
    written = spark.read.parquet(str(tmp_path / "state" / "table")).agg(F.sum("value")).first()[0]
    assert written > 0.95 * log.count() if order != "shuffled" else 0 < written < log.count()


def test_idle_keys_leave_the_state(spark, tmp_path):
    """Users who come one after the other: only the last of them are remembered."""
    rows = [(i, i // 20, "a", 1_700_000_000_000 + i * 10_000) for i in range(1000)]
    log = spark.createDataFrame(rows, "request_id BIGINT, user_id BIGINT, ability_id STRING, ms BIGINT").withColumn("ts", F.timestamp_millis("ms"))
    files(log, tmp_path / "in", "ts")
    rule = limits.counters(WINDOWS)
    with stateful(spark, 2):
        query = to_table(folded_stream(limits.ticks(stream(spark, log, tmp_path / "in")), rule, "60 seconds"),
                         str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    operators = [p["stateOperators"][0] for p in query.recentProgress]
    assert operators[-1]["customMetrics"].get("rocksdbGetCount") is not None
    # A user's 20 requests span 200 s, counters live 600 s: at most five users are remembered.
    assert operators[-1]["customMetrics"]["numValueStateVars"] > 0 and spark.read.parquet(str(tmp_path / "out")).count() >= 990
    remembered = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "counter").load()
    assert 1 <= remembered.count() <= 5


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log = limiter_log(spark, 1200).cache()
    root, source = str(tmp_path / "state"), str(tmp_path / "in")
    at = F.unix_millis("ts")
    middle = log.agg(F.percentile(at, 0.5)).first()[0]
    for part in (log.where(at <= middle), log.where(at > middle)):
        part.coalesce(1).write.mode("append").parquet(source)
        decided = limits.stream_rate_limits(stream(spark, log, source), WINDOWS, root=root)
        got = per_tick(decided)
    wanted = {(r["user_id"], r["ability_id"], r["slot"]): (r["value"], r["folded"][-1])
              for r in fold_batch(limits.ticks(log).drop("ts"), limits.counters(WINDOWS)).collect()}
    assert set(got.items()) <= set(wanted.items()) and len(got) > 0.95 * len(wanted)
    assert per_tick(limits.stream_rate_limits(stream(spark, log, source), WINDOWS, root=root, log=log)) == wanted


def test_abilities_of_a_user_share_a_state(spark, tmp_path):
    """A state for each user, however many abilities they use; callers that aren't logged in have one for each ability."""
    rows = [(i, i % 5, f"ability {i % 7}", 1_700_000_000_000 + i * 100) for i in range(700)]
    log = spark.createDataFrame(rows, "request_id BIGINT, user_id BIGINT, ability_id STRING, ms BIGINT").withColumn("ts", F.timestamp_millis("ms"))
    files(log, tmp_path / "in", "ts")
    with stateful(spark, 2):
        query = to_table(folded_stream(limits.ticks(stream(spark, log, tmp_path / "in")), limits.counters(WINDOWS), "60 seconds"),
                         str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "counter").load()
    assert kept.count() == 4 + 7


def test_costs_are_worked_out_once(spark, exchange):
    """No filter on the cost is pushed to the source, which would parse the bodies again for each of its parts."""
    plan = live.spend_slots(usage.request_cost(requests.shape_requests(exchange)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


@pytest.mark.parametrize("order", ["ts", "provider"])
def test_stream_alerts_equal_the_crossings(spark, exchange, tmp_path, order):
    costed = usage.request_cost(requests.shape_requests(exchange)).cache()
    files(costed, tmp_path / "in", order)
    exempt = spark.createDataFrame([(3,), (4,)], "user_id BIGINT")
    alerts = live.spend_alerts(stream(spark, costed, tmp_path / "in"), "0.10", exempt, log=costed).collect()
    crossings = budget.budget_crossings(costed, "0.10", exempt).withColumn("slot", F.unix_micros(F.date_trunc("minute", "crossed_at"))).collect()
    assert {(r["user_id"], r["period"], r["slot"]) for r in alerts} == {(r["user_id"], r["period"], r["slot"]) for r in crossings}


def test_spend_is_forgotten_after_the_month(spark, exchange, tmp_path):
    """One event of the next month closes the month: all its spend is out and out of the state."""
    costed = usage.request_cost(requests.shape_requests(exchange))
    later = costed.where("usd_micros > 0").limit(1).withColumn("ts", F.lit("2024-02-02 00:00:00").cast("timestamp")).withColumn("user_id", F.lit(-1).cast("bigint"))
    everything = costed.unionByName(later).cache()
    files(everything, tmp_path / "in", "ts")
    alerts = live.spend_alerts(stream(spark, everything, tmp_path / "in"), "0.10", root=str(tmp_path / "state"))
    crossings = budget.budget_crossings(costed, "0.10").withColumn("slot", F.unix_micros(F.date_trunc("minute", "crossed_at")))
    assert {tuple(r) for r in alerts.select("user_id", "slot").collect()} == {tuple(r) for r in crossings.select("user_id", "slot").collect()}
    kept = spark.read.format("statestore").option("path", str(tmp_path / "state" / "checkpoint")).option("stateVarName", "counter").load()
    assert [r["key"]["user_id"] for r in kept.collect()] == [-1]


@pytest.mark.parametrize("at, end", [("2024-01-31 23:59:59", "2024-02-01"), ("2024-12-01 00:00:00", "2025-01-01"), ("1999-02-28 12:00:00", "1999-03-01")])
def test_month_ends(at, end):
    def micros(text):
        return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000

    assert live.month_end(micros(at)) == micros(end)


def test_stream_moderation(spark, sf_dir, tmp_path):
    bodies = sample.outputs(spark, sf_dir)
    files(bodies, tmp_path / "in", "conv_id")
    checked = scrub.stream_moderate(stream(spark, bodies, tmp_path / "in"), "body", ["que"])
    got = drain(spark, checked.select("conv_id", "turn", "violation"), "moderated")
    assert got.count() == bodies.count() and got.where("violation is not null").count() > 0


def test_usage_sink_rewrites_only_touched_months(spark, exchange, tmp_path):
    path = str(tmp_path / "usage")
    january = usage.usage_rollup(usage.request_cost(requests.shape_requests(exchange)))
    december = january.withColumn("period", F.lit("2023-12"))
    sinks.write_usage(spark, path, january.unionByName(december))
    untouched = sorted(spark.read.parquet(path).where("period = '2023-12'").inputFiles())
    twice = usage.add_usage(january, january).unionByName(december)
    for _ in range(3):  # tried again
        sinks.upsert_usage(spark, path, january, 5)
        assert table(sinks.read_usage(spark, path)) == table(twice)
    stored = sinks.read_usage(spark, path)
    assert sorted(f for f in stored.inputFiles() if "2023-12" in f) == [f for f in untouched if "2023-12" in f]
    sinks.upsert_usage(spark, path, january.where("false"), 6)
    assert table(sinks.read_usage(spark, path)) == table(twice)
    sinks.upsert_usage(spark, path, december, 5)  # a batch that is run again with other rows replaces the first
    assert table(sinks.read_usage(spark, path)) == table(january.unionByName(usage.add_usage(december, december)))


def test_broken_upsert_is_run_again(spark, exchange, tmp_path, monkeypatch):
    path = str(tmp_path / "usage")
    january = usage.usage_rollup(usage.request_cost(requests.shape_requests(exchange)))
    sinks.write_usage(spark, path, january)
    with monkeypatch.context() as broken:
        def fail(*_):
            raise OSError("no more")

        broken.setattr(sinks, "_replace", fail)
        with pytest.raises(OSError):
            sinks.upsert_usage(spark, path, january, 0)  # the delta is logged, the month is not rebuilt
    assert table(sinks.read_usage(spark, path)) == table(january)
    sinks.upsert_usage(spark, path, january, 0)
    sinks.upsert_usage(spark, path, january, 1)
    assert table(sinks.read_usage(spark, path)) == table(usage.add_usage(january, usage.add_usage(january, january)))


def test_sweep_removes_expired_months_in_place(spark, exchange, tmp_path):
    path = str(tmp_path / "usage")
    january = usage.usage_rollup(usage.request_cost(requests.shape_requests(exchange)))
    sinks.write_usage(spark, path, january.unionByName(january.withColumn("period", F.lit("2022-12"))))
    sinks.upsert_usage(spark, path, january.withColumn("period", F.lit("2022-11")), 0)
    kept = [f for f in spark.read.parquet(path).inputFiles() if "2024-01" in f]
    today = F.lit("2025-01-10").cast("date")
    assert jobs.sweep_usage(spark, path, today) == ("2023-01", 2 * january.count())
    assert table(sinks.read_usage(spark, path)) == table(january)
    assert spark.read.parquet(path).inputFiles() == kept
    assert jobs.sweep_usage(spark, path, today) == ("2023-01", 0)
    sinks.upsert_usage(spark, path, january, 1)  # what the log has lost doesn't come back
    assert table(sinks.read_usage(spark, path)) == table(usage.add_usage(january, january))
    assert retention.usage_swept(january.where("false"), today).first()["cutoff"] == "2023-01"


def test_append_only_log(spark, tmp_path):
    rows = spark.range(3)
    sinks.append(rows, str(tmp_path / "log"))
    sinks.append(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_shared_folder_is_the_one_the_session_names(spark):
    class Named:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "hdfs://cluster/shared" if key == "spark.checkpoint.dir" else default

    assert shared_dir(Named()) == "hdfs://cluster/shared"
    named = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    folder = shared_dir(spark)
    assert folder and shared_dir(spark) == folder
    assert named == (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir())


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    class Unnamed:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            applicationId = "app"

            @staticmethod
            def getCheckpointDir():
                return None

    Unnamed.sparkContext.master = master
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unnamed())


def test_scratch_is_removed(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert fs.exists(spark, path)
    clear_scratch(spark)
    assert not fs.exists(spark, path)
