"""The raw log as JSON lines."""

import json
import re

from pyspark.sql import functions as F

from govlake.operators import requests
from govlake.sources import raw, sample

BODIES = [
    None, "", "not json", "{}", "[1]", '"text"', "null", '{"model":"m-1"}', '{"model":null}', '{"model":"x"', '{"model":7}',
    '{"usage":{"prompt_tokens":12,"completion_tokens":3.9}}', '{"usage":{"prompt_tokens":null,"input_tokens":"7x"}}',
    '{"usage":{"input_tokens":true,"output_tokens":1e2}}', '{"usage":5}', '{"usageMetadata":{"promptTokenCount":4,"candidatesTokenCount":"2"}}',
]


def lines_of(spark, folder):
    rows = [
        {"request_id": i * 100 + j, "ts": "2024-01-01T00:00:00.000Z", "end_ts": "2024-01-01T00:00:01.500Z", "user_id": 1, "route": "/wp-abilities/v1/ai/x/run",
         "uri": "https://api.openai.com/v1", "request_body": a, "response_body": b, "error_message": None}
        for i, a in enumerate(BODIES) for j, b in enumerate(BODIES)
    ]
    broken = ['{"request_id": 1', "plain text", '["request_id"]', '{"request_id": "no number"}']
    folder.mkdir()
    (folder / "lines.json").write_text("\n".join([json.dumps(r) for r in rows] + broken), encoding="utf-8")
    return rows, broken


def test_every_line_is_in_one_table(spark, tmp_path):
    rows, broken = lines_of(spark, tmp_path / "raw")
    parsed, rest = raw.read_exchange(spark, str(tmp_path / "raw"))
    assert sorted(r["line"] for r in rest.where("reason = 'line'").collect()) == sorted(broken)
    ids = [r["request_id"] for r in parsed.collect()] + [r["request_id"] for r in rest.where("reason != 'line'").collect()]
    assert sorted(ids) == [r["request_id"] for r in rows]

    def parses(text):
        try:
            return text is None or json.loads(text) is not ...
        except ValueError:
            return False

    assert {r["request_id"] for r in parsed.collect()} == {r["request_id"] for r in rows if parses(r["request_body"]) and parses(r["response_body"])}
    assert dict(parsed.dtypes)["request"] == "variant" and dict(parsed.dtypes)["response"] == "variant"


def test_token_rules_are_those_of_texts(spark, tmp_path):
    rows, _ = lines_of(spark, tmp_path / "raw")
    parsed, rest = raw.read_exchange(spark, str(tmp_path / "raw"))
    as_text = spark.read.schema("request_id BIGINT, ts TIMESTAMP, end_ts TIMESTAMP, user_id BIGINT, route STRING, uri STRING, request_body STRING, "
                                "response_body STRING, error_message STRING").json(str(tmp_path / "raw")).where("request_id IS NOT NULL AND uri IS NOT NULL")
    for metadata in (False, True):
        events = requests.shape_parsed(parsed, metadata).unionByName(requests.shape_requests(raw.texts(rest), metadata))
        assert sorted(map(tuple, events.collect())) == sorted(map(tuple, requests.shape_requests(as_text, metadata).collect()))


def test_bodies_are_parsed_when_the_log_is_read(spark, sf_dir, tmp_path):
    exchange = sample.exchange(spark, sf_dir)
    exchange.select(F.to_json(F.struct(*exchange.columns)).alias("value")).write.text(str(tmp_path / "raw"))
    parsed, _ = raw.read_exchange(spark, str(tmp_path / "raw"))
    plan = requests.shape_parsed(parsed)._jdf.queryExecution().executedPlan().toString()
    # The fields are read by the scan itself.
    assert not re.findall(r"(?<![\w-])(from_json|try_parse_json|parse_json)\(", plan), plan
    assert re.search(r"coalesce\(response#\d+\.0, response#\d+\.1\)", plan), plan
