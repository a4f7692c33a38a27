"""Versions in force on two streams, against the batch look-up."""

import random
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from govlake.operators.prompts import prompt_asof
from govlake.streaming.asof import asof_stream, bucket_runs, stream_prompt_asof
from govlake.streaming.run import stateful, to_table
from test_streams_and_sinks import files, stream


def at(seconds):
    return datetime.fromtimestamp(1.7e9 + seconds, timezone.utc)


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(12)
    calls = [(i, rng.choice("aaaab"), at(rng.randint(0, 20_000))) for i in range(800)] + [(5000, "never edited", at(100))]
    edits = [(i, rng.choice("ab"), "delete" if i % 4 == 0 else "put", rng.choice(["append", "bogus"]), f"t{i}", 1, at(rng.randint(50, 20_000))) for i in range(300)]
    return (
        spark.createDataFrame(calls, "request_id BIGINT, ability_id STRING, ts TIMESTAMP").cache(),
        spark.createDataFrame(edits, "edit_id BIGINT, ability_id STRING, action STRING, mode STRING, template STRING, updated_by BIGINT, updated_at TIMESTAMP").cache(),
    )


def rows(frame):
    return sorted(map(tuple, frame.select("request_id", "ability_id", "edit_id", "mode", "template").collect()), key=repr)


@pytest.mark.parametrize("mixed", [False, True])
def test_streamed_versions_equal_the_log(spark, logs, tmp_path, mixed):
    calls, edits = logs
    order = {"ts": F.xxhash64("request_id") if mixed else F.col("ts"), "updated_at": F.xxhash64("edit_id") if mixed else F.col("updated_at")}
    files(calls, tmp_path / "calls", order["ts"])
    files(edits, tmp_path / "edits", order["updated_at"])
    found = stream_prompt_asof(stream(spark, calls, tmp_path / "calls"), stream(spark, edits, tmp_path / "edits"),
                               root=str(tmp_path / "state"), call_log=calls, edit_log=edits)
    if not mixed:
        assert rows(found) == rows(prompt_asof(calls, edits))
        written = rows(spark.read.parquet(str(tmp_path / "state" / "table")))
        assert len({r[0] for r in written}) == len(written) > 0.9 * calls.count()
        assert (5000, "never edited", None, None, None) in written
    else:
        # Edits that come after the watermark are lost to the stream; every call still comes out once.
        assert [r[0] for r in sorted(rows(found))] == [r["request_id"] for r in calls.orderBy("request_id").collect()]
        patient = stream_prompt_asof(stream(spark, calls, tmp_path / "calls"), stream(spark, edits, tmp_path / "edits"), delay="7 hours",
                                     root=str(tmp_path / "patient"), call_log=calls, edit_log=edits)
        assert rows(patient) == rows(prompt_asof(calls, edits))


def test_replaced_versions_are_forgotten(spark, logs, tmp_path):
    calls, edits = logs
    files(calls, tmp_path / "calls", "ts")
    files(edits, tmp_path / "edits", "updated_at")
    with stateful(spark, 2):
        query = to_table(asof_stream(stream(spark, calls, tmp_path / "calls"), stream(spark, edits, tmp_path / "edits"), parts=2),
                         str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "versions").option("flattenCollectionTypes", "true").load()
    assert 0 < kept.count() < edits.count() / 2


def test_state_holds_one_version_of_an_ability(spark, logs, tmp_path):
    """However many parts and edits there are, and no row of state for calls that wait."""
    calls, edits = logs
    files(calls, tmp_path / "calls", "ts")
    files(edits, tmp_path / "edits", "updated_at")
    with stateful(spark, 2):
        query = to_table(asof_stream(stream(spark, calls, tmp_path / "calls"), stream(spark, edits, tmp_path / "edits")),
                         str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    kept = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "versions").option("flattenCollectionTypes", "true").load()
    assert kept.count() == edits.select("ability_id").distinct().count()


def test_equal_times_and_missing_ids(spark, tmp_path):
    """Calls at the time of edits, several edits at once, an unknown action and calls without an id."""
    calls = [(None if i % 9 == 0 else i, "a", at(i * 7 % 400)) for i in range(120)]
    edits = [(i, "a", ("put", "delete", None)[i % 3], "append", f"t{i}", 1, at(i // 2 * 14)) for i in range(50)]
    calls = spark.createDataFrame(calls, "request_id BIGINT, ability_id STRING, ts TIMESTAMP").cache()
    edits = spark.createDataFrame(edits, "edit_id BIGINT, ability_id STRING, action STRING, mode STRING, template STRING, updated_by BIGINT, updated_at TIMESTAMP").cache()
    files(calls, tmp_path / "calls", "ts")
    files(edits, tmp_path / "edits", "updated_at")
    found = stream_prompt_asof(stream(spark, calls, tmp_path / "calls"), stream(spark, edits, tmp_path / "edits"), delay="1 second",
                               root=str(tmp_path / "state"), call_log=calls, edit_log=edits)
    assert rows(found) == rows(prompt_asof(calls, edits))
    assert len(rows(spark.read.parquet(str(tmp_path / "state" / "table")))) >= 60


@pytest.mark.parametrize("parts", [1, 4])
def test_runs_of_a_bucket(parts):
    events = [{"at": t, "request_id": t, "is_call": call, "edit_id": n, "live": True, "mode": "m", "template": f"t{n}"}
              for t, call, n in [(5, True, 0), (1, True, 0), (2, False, 7), (2, False, 6), (3, False, 8), (3, True, 0), (4, False, 9)]]
    alone = [{**events[0], "request_id": 70}]
    batch = pa.RecordBatch.from_pylist([{"ability_id": "a", "bucket": 0, "events": events}, {"ability_id": "b", "bucket": 10, "events": alone}])
    runs = bucket_runs(batch, parts, 10).to_pylist()
    assert [(r["ability_id"], r["known"], r["last"], r["template"], r["calls"]) for r in runs] == [
        ("a", False, False, None, [1]), ("a", True, False, "t8", [3]), ("a", True, True, "t9", [5]), ("b", False, False, None, [70])]
    assert [r["part"] for r in runs] == [0, 1 if parts > 1 else 0, 0, 0]
