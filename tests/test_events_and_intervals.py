"""Observed counts, the stored edit history, and the rules as SQL functions."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from govlake.functions import money, pii, requests as rq, sql
from govlake.operators import events, intervals, prompts
from govlake.plans import jobs
from govlake.plans.catalog import QUERIES
from govlake.policy import Policy
from govlake.session import scratch_path
from govlake.sources import sample, sinks
from govlake.streaming import scrub
from govlake.streaming.run import to_table

from test_streams_and_sinks import files, stream


class Jobs:
    """Spark jobs run inside, by a job group."""

    def __init__(self, spark):
        self.context = spark.sparkContext

    def __enter__(self):
        self.name = f"group-{random.random()}"
        self.context.setJobGroup(self.name, "counted")
        return self

    def __exit__(self, *_):
        self.context.setLocalProperty("spark.jobGroup.id", None)

    def count(self):
        return len(self.context.statusTracker().getJobIdsForGroup(self.name))


def test_events_of_the_replay_are_counted_on_the_way(spark, sf_dir):
    replay = QUERIES["governance_replay"](spark, sf_dir).withColumn("usd_micros", F.round(F.col("usd_spent") * 1_000_000).cast("bigint")).cache()
    rows = replay.collect()
    with Jobs(spark) as ran:
        replay.write.parquet(scratch_path(spark, "plain"))
        plain = ran.count()
    with Jobs(spark) as ran:
        counts = jobs.write_replay(replay, scratch_path(spark, "counted"))
        assert ran.count() == plain  # no job besides the write
    stopped = [r["stopped_by"] for r in rows if r["stopped_by"]]
    assert counts["requests"] == len(rows) and counts["stopped"] == len(stopped) > 0
    for gate in events.GATES:
        assert counts[f"stopped_by_{gate}"] == sum(s.split(":")[0] == gate for s in stopped)
    assert counts["output_blocked"] == sum(r["output_blocked"] for r in rows)
    assert counts["usd_micros"] == sum(r["usd_micros"] for r in rows)


def test_swept_log_is_counted_in_one_scan(spark, sf_dir):
    log = sample.exchange(spark, sf_dir).select("request_id", "ts")
    log = log.unionByName(log.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    now, policy, path = F.lit("2024-02-01 00:00:00").cast("timestamp"), Policy(log_retention_days=14), scratch_path(spark, "log")
    counts = jobs.sweep_log(log, now, path, policy)
    assert counts["kept"] == spark.read.parquet(path).count() == jobs.retain_log(log, now, policy).count() > 0
    assert counts["kept"] + counts["removed"] == log.count()
    watched, _ = events.observed(log, {"rows": F.count(F.lit(1))})
    assert watched._jdf.queryExecution().executedPlan().toString().count("FileScan") == log._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_stream_events_come_with_its_progress(spark, sf_dir, tmp_path):
    bodies = sample.outputs(spark, sf_dir)
    files(bodies, tmp_path / "in", "conv_id")
    checked = scrub.stream_moderate(stream(spark, bodies, tmp_path / "in"), "body", sample.BANNED).select("conv_id", "turn", "violation")
    query = to_table(events.observed_stream(checked, "moderation", events.moderation_metrics()), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert events.stream_totals(query, "moderation") == {"answers": written.count(), "blocked": written.where("violation IS NOT NULL").count()}


def edit_log(spark, n=400):
    rng = random.Random(6)
    rows = [(i, rng.choice("abcd"), "delete" if rng.random() < 0.3 else "put", rng.choice(["prepend", "bogus"]), f"t{i}", i % 5,
             datetime.fromtimestamp(1.7e9 + rng.randint(0, 300) * 60, timezone.utc)) for i in range(n)]
    return spark.createDataFrame(rows, "edit_id BIGINT, ability_id STRING, action STRING, mode STRING, template STRING, updated_by BIGINT, updated_at TIMESTAMP")


def table(frame):
    return sorted((tuple(r) for r in frame.select("ability_id", "edit_id", "from_us", "to_us", "live", "mode", "template", "updated_by").collect()), key=repr)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2, 1)])
def test_stored_intervals_equal_a_rebuild(spark, tmp_path, order):
    """After any order of batches, with ties of time, late edits, and a batch that comes again."""
    log, path = edit_log(spark).cache(), str(tmp_path / "history")
    for number in order:
        sinks.record_edits(spark, path, log.where(F.col("edit_id") % 4 == number), number)
    stored = sinks.read_intervals(spark, path)
    assert table(stored) == table(intervals.edit_intervals(log))
    rows = table(stored)
    for ability in "abcd":
        own = sorted((r for r in rows if r[0] == ability), key=lambda r: (r[2], r[1]))
        assert [r[3] for r in own] == [*(r[2] for r in own[1:]), intervals.OPEN_END]
    in_force = intervals.interval_current(stored).select("ability_id", "template").collect()
    latest = log.groupBy("ability_id").agg(F.max_by(F.struct("action", "template"), F.struct("updated_at", "edit_id")).alias("x"))
    assert sorted(map(tuple, in_force)) == sorted((r["ability_id"], r["x"]["template"]) for r in latest.collect() if r["x"]["action"] == "put")


def test_a_batch_rewrites_only_its_shards(spark, tmp_path):
    log, path = edit_log(spark).cache(), str(tmp_path / "history")
    sinks.record_edits(spark, path, log, 0)
    before = set(spark.read.parquet(path).inputFiles())
    late = log.where("ability_id = 'a'").limit(1).withColumn("edit_id", F.lit(9999).cast("bigint"))
    sinks.record_edits(spark, path, late, 1)
    shard = late.select(F.pmod(F.xxhash64("ability_id"), F.lit(sinks.SHARDS))).first()[0]
    after = set(spark.read.parquet(path).inputFiles())
    assert before != after and all(f"shard={shard}/" in f for f in before ^ after)
    sinks.record_edits(spark, path, late.where("false"), 2)
    assert set(spark.read.parquet(path).inputFiles()) == after


@pytest.mark.parametrize("bucket_seconds", [60, 3600, 10**6])
def test_lookups_in_intervals_equal_the_log(spark, bucket_seconds):
    log, rng = edit_log(spark), random.Random(3)
    calls = spark.createDataFrame(
        [(i, rng.choice("abcde"), datetime.fromtimestamp(1.7e9 - 3600 + rng.randint(0, 420) * 60, timezone.utc)) for i in range(500)],
        "request_id BIGINT, ability_id STRING, ts TIMESTAMP")
    found, wanted = (sorted(map(tuple, f.select("request_id", "edit_id", "mode", "template").collect()))
                     for f in (intervals.interval_asof(calls, intervals.edit_intervals(log), bucket_seconds=bucket_seconds), prompts.prompt_asof(calls, log)))
    assert repr(found) == repr(wanted)
    assert intervals.interval_asof(calls.limit(0), intervals.edit_intervals(log)).count() == 0


def test_sql_functions_equal_the_rules(spark):
    names = sql.register(spark)
    assert set(names) == set(sql.definitions())
    bodies = [None, "", "not json", '{"usage":{"prompt_tokens":"12abc","output_tokens":3.9}}', '{"usage":{"prompt_tokens":null,"input_tokens":7}}',
              '{"usage":{"prompt_tokens":true,"completion_tokens":"-5e2"}}', '{"usageMetadata":{"promptTokenCount":5}}', '{"model":"m\'1"}']
    rows = [(b, u, t) for b in bodies for u, t in [(None, None), ("https://api.OPENAI.com/x", "a@b.co é123-45-6789é (555) 123-4567"),
                                                   ("https://eu.azure.com", "x" * 50 + "@"), ("no uri", "$1 \\ [REDACTED] 12345678901 a@b.co,c@d.org")]]
    frame = spark.createDataFrame(rows, "body STRING, uri STRING, text STRING")
    frame.createOrReplaceTempView("exchanges")
    tokens = rq.tokens(F.col("body"))
    wanted = frame.select(rq.provider(F.col("uri")), rq.model(F.col("body")), tokens["tokens_input"], tokens["tokens_output"], pii.redact(F.col("text"))).collect()
    found = spark.sql("SELECT gov_provider(uri), gov_model(body), gov_tokens_in(body), gov_tokens_out(body), gov_redact(text) FROM exchanges").collect()
    assert list(map(tuple, found)) == list(map(tuple, wanted))
    amounts = spark.createDataFrame([(1, 1, None, None), (None, 333, "0.0015", None), (10**13, 10**13, "0.5", "99.9"), (7, -7, "0.0005", "0.0000005"), (-333, -1, "0.0015", None)],
                                    "a BIGINT, b BIGINT, x STRING, y STRING").selectExpr("a", "b", "x::DECIMAL(12,9) AS x", "y::DECIMAL(12,9) AS y")
    amounts.createOrReplaceTempView("amounts")
    wanted = amounts.select(money.price_micros(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in spark.sql("SELECT gov_price_micros(a, b, x, y) FROM amounts").collect()] == [r[0] for r in wanted]
    assert "Python" not in spark.sql("SELECT gov_redact(text) FROM exchanges")._jdf.queryExecution().executedPlan().toString()
