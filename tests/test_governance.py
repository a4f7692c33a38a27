import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import functions as F

from govlake.functions import limiter
from govlake.functions.money import micros_of
from govlake.operators import access, budget, ratelimit, requests, retention, usage
from govlake.plans import jobs
from govlake.policy import ABILITIES, DEFAULT_ROLE_MAP, Policy, RateWindow
from govlake.sources.tables import local_rows

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def log(spark, rows):
    """Request log from (id, user, ability, seconds)."""
    frame = spark.createDataFrame(
        [(i, u, a, int(s * 1_000_000)) for i, u, a, s in rows],
        "request_id BIGINT, user_id BIGINT, ability_id STRING, us BIGINT")
    base = int(START.timestamp()) * 1_000_000
    return frame.withColumn("ts", F.timestamp_micros(F.col("us") + base)).drop("us")


def simulate(rows, windows):
    """The limiter, one request after the other."""
    store, answers = {}, {}
    for i, user, ability, seconds in sorted(rows, key=lambda r: (r[3], r[0])):
        now, answer = int(seconds), "allowed"
        for w in windows:
            if w.limit <= 0:
                continue
            count, until = store.get((w.name, user, ability), (0, 0))
            if now >= until:
                count = 0
            if count >= w.limit:
                answer = w.name
                break
            store[(w.name, user, ability)] = (count + 1, now + w.ttl_seconds)
        answers[i] = answer
    return answers


def decisions(spark, rows, windows):
    replay = ratelimit.rate_limit_replay(log(spark, rows), windows)
    return {r["request_id"]: r["rate_decision"] for r in replay.collect()}


def test_limiter_edges(spark):
    minute = [RateWindow("minute", 60, 1)]
    assert decisions(spark, [(1, 0, "a", 0), (2, 0, "a", 59), (3, 0, "a", 60), (4, 0, "b", 1), (5, 1, "a", 1)], minute) == {
        1: "allowed", 2: "minute", 3: "allowed", 4: "allowed", 5: "allowed"}
    # a rejection by the day has already used a slot of the minute
    both = [RateWindow("minute", 60, 2), RateWindow("day", 86_400, 1)]
    assert decisions(spark, [(1, 0, "a", 0), (2, 0, "a", 1), (3, 0, "a", 2)], both) == {
        1: "allowed", 2: "day", 3: "minute"}
    assert decisions(spark, [(1, 0, "a", 0), (2, 0, "a", 0)], [RateWindow("minute", 60, 0)]) == {1: "allowed", 2: "allowed"}


def test_requests_without_user_share_one_counter(spark):
    nobody = [RateWindow("minute", 60, 1)]
    assert decisions(spark, [(1, None, "a", 0), (2, 0, "a", 1), (3, None, None, 2)], nobody) == {
        1: "allowed", 2: "minute", 3: "allowed"}


def test_fold_does_not_depend_on_batch_borders():
    rng = random.Random(9)
    rows = sorted({(u, "ab"[rng.randint(0, 1)], t * 1_000_000) for u in range(6) for t in rng.sample(range(500), 20 if u else 400)})
    table = pa.table({"user_id": [r[0] for r in rows], "ability_id": [r[1] for r in rows], "tick": [r[2] for r in rows],
                      "requests": [rng.randint(1, 3) for _ in rows]})
    windows = [(60_000_000, 5), (300_000_000, 12)]

    def passed(size):
        folded = limiter.fold_sorted(table.to_batches(max_chunksize=size), ("user_id", "ability_id"), windows)
        return [p for b in folded for p in b.column("passed").to_pylist()]

    walked, key = [], None
    for row in table.to_pylist():
        if (row["user_id"], row["ability_id"]) != key:
            key = (row["user_id"], row["ability_id"])
            counts, expires = limiter.fresh(windows)
        walked.append(limiter.advance(row["tick"], row["requests"], windows, counts, expires))
    for size in (1, 3, 50, 10_000):
        assert passed(size) == walked


def test_limiter_equals_simulation_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        user = 0 if rng.random() < 0.5 else rng.randint(1, 9)
        rows.append((i, user, rng.choice("ab"), round(rng.random() * 4000, 3)))
    rows += [(10_000 + i, 0, "a", 2000.5) for i in range(300)]
    windows = [RateWindow("minute", 60, 5), RateWindow("day", 600, 12)]
    assert decisions(spark, rows, windows) == simulate(rows, windows)


def costed(spark, rows):
    """Costed requests from (id, user, seconds, micros)."""
    frame = log(spark, [(i, u, "a", s) for i, u, s, _ in rows])
    money = spark.createDataFrame([(r[0], r[3]) for r in rows], "request_id BIGINT, usd_micros BIGINT")
    return frame.join(money, "request_id").withColumn("period", F.date_format("ts", "yyyy-MM"))


def test_budget_replay_equals_simulation(spark):
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randint(1, 30), rng.randint(0, 40 * 86_400), rng.choice([0, 3, 40, 700]))
            for i in range(5000)]
    spent, wanted = {}, {}
    for i, user, seconds, micros in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (user, at(seconds).strftime("%Y-%m"))
        wanted[i] = spent.get(key, 0) >= 20_000
        if not wanted[i]:
            spent[key] = spent.get(key, 0) + micros
    for bucket in (60, 86_400 * 40):
        got = budget.budget_replay(costed(spark, rows), "0.02", bucket_seconds=bucket)
        assert {r["request_id"]: r["over_budget"] for r in got.collect()} == wanted
    assert any(wanted.values())


def test_budget_edges(spark):
    rows = [(1, 5, 0, 50_000), (2, 5, 10, 50_000), (3, 5, 20, 1), (4, 6, 0, 99_999), (5, 6, 1, 0)]
    at_cap = {r["request_id"]: r["over_budget"] for r in budget.budget_replay(costed(spark, rows), "0.10").collect()}
    assert at_cap == {1: False, 2: False, 3: True, 4: False, 5: False}
    crossing = budget.budget_crossings(costed(spark, rows), "0.10").first()
    assert (crossing["user_id"], crossing["crossing_id"], crossing["spent_micros"]) == (5, 2, 100_000)
    assert budget.budget_crossings(costed(spark, rows), "0").count() == 0
    exempt = budget.budget_crossings(costed(spark, rows), "0.10", local_rows(spark, [(5,)], "user_id BIGINT"))
    assert exempt.count() == 0


def spending(spark, micros, user=1):
    return spark.createDataFrame(
        [(user, "2024-01", "anthropic", "m", 1, 1000, 1000, micros, START)],
        "user_id BIGINT, period STRING, provider STRING, model STRING, requests BIGINT, tokens_in BIGINT, "
        "tokens_out BIGINT, usd_micros BIGINT, updated_at TIMESTAMP")


def gate(spark, micros, cap, capability="wp_ability_ai_title_generation", exempt=False):
    checks = spark.createDataFrame([(1, capability, exempt, True)], "user_id BIGINT, capability STRING, exempt BOOLEAN, granted BOOLEAN")
    return budget.budget_gate(checks, spending(spark, micros), cap, "2024-01").first()["granted"]


def test_budget_gate(spark):
    assert gate(spark, 6_000_000, "5.0") is False
    assert gate(spark, 1_000_000, "5.0") is True
    assert gate(spark, 5_000_000, "5.0") is False
    assert gate(spark, 999_000_000, "0") is True
    assert gate(spark, 6_000_000, "5.0", capability="edit_posts") is True
    assert gate(spark, 6_000_000, "5.0", exempt=True) is True
    assert micros_of("0.0000005") == 1


def test_upsert_adds_and_keeps_the_later_time(spark):
    merged = usage.add_usage(spending(spark, 5), spending(spark, 7)).first()
    assert (merged["requests"], merged["tokens_in"], merged["usd_micros"]) == (2, 2000, 12)
    assert usage.add_usage(spending(spark, 5), spending(spark, 5, user=2)).count() == 2


def test_events_shape_and_redelivery(spark):
    rows = [(1, at(0), at(1.2345), 0, "/wp-abilities/v1/ai/x/run", "https://api.openai.com/", '{"model":"m"}',
             '{"usage":{"prompt_tokens":1}}', None),
            (1, at(0), at(1.2345), 0, "/wp-abilities/v1/ai/x/run", "https://api.openai.com/", '{"model":"m"}',
             '{"usage":{"prompt_tokens":1}}', None),
            (2, at(0), at(0), 0, "/x", None, None, None, "boom"),
            (3, at(0), at(0), 0, "/x", "https://api.openai.com/", "{}", '{"error":{"code":429}}', None)]
    exchange = spark.createDataFrame(rows, (
        "request_id BIGINT, ts TIMESTAMP, end_ts TIMESTAMP, user_id BIGINT, route STRING, uri STRING, "
        "request_body STRING, response_body STRING, error_message STRING"))
    events = requests.shape_requests(requests.dedupe(exchange)).orderBy("request_id").collect()
    assert [(e["ability_id"], e["provider"], e["model"], e["duration_ms"], e["tokens_input"], e["status"]) for e in events] == [
        ("ai/x", "openai", "m", 1234, 1, "success"), ("/x", "", "", 0, 0, "error"), ("/x", "openai", "", 0, 0, "success")]
    rolled = usage.usage_rollup(usage.request_cost(requests.shape_requests(requests.dedupe(exchange))))
    # an HTTP error body counts as a request without tokens; a thrown error counts for nothing
    assert sorted((r["model"], r["requests"], r["usd_micros"]) for r in rolled.collect()) == [("", 1, 0), ("m", 1, 3)]


def roles(spark, ability, held, mapping, granted=True, capability=None):
    capability = capability or jobs.capability_of(F.lit(ability))
    checks = spark.range(1).select(
        (capability if not isinstance(capability, str) else F.lit(capability)).alias("capability"),
        F.array(*[F.lit(h) for h in held]).cast("array<string>").alias("roles"), F.lit(granted).alias("granted"))
    table = local_rows(spark, list(mapping.items()), "ability_id STRING, roles ARRAY<STRING>")
    return access.role_gate(checks, table).first()["granted"]


def test_role_gate(spark):
    mapping = {**DEFAULT_ROLE_MAP, "ai/closed": []}
    assert roles(spark, "ai/image-generation", ["editor"], mapping) is True
    assert roles(spark, "ai/image-generation", ["author"], mapping) is False
    assert roles(spark, "ai/image-generation", ["editor"], mapping, granted=False) is True
    assert roles(spark, "ai/image-generation", [], mapping) is False
    assert roles(spark, "ai/closed", ["administrator"], mapping) is False
    assert roles(spark, "ai/summarization", [], mapping, granted=False) is False
    assert roles(spark, "", ["author"], mapping, capability="edit_posts") is True


def test_mapped_abilities_are_in_the_catalogue(spark):
    catalogue = local_rows(spark, [(a,) for a in ABILITIES], "ability_id STRING")
    mapped = local_rows(spark, [(a,) for a in DEFAULT_ROLE_MAP], "ability_id STRING")
    assert access.unknown_abilities(mapped, catalogue).count() == 0
    typo = local_rows(spark, [("ai/image-generatoin",)], "ability_id STRING")
    assert access.unknown_abilities(typo, catalogue).count() == 1


def test_allowlist(spark):
    schema = "capability STRING, provider STRING, model STRING, pos INT"
    preferred = local_rows(spark, [("text", "a", "b|c", 0), ("text", "a|b", "c", 1), ("image", "x", "y", 2)], schema)
    allow = local_rows(spark, [("text", "a", "b|c")], "capability STRING, provider STRING, model STRING")
    assert sorted(r["pos"] for r in access.allowed_models(preferred, allow).collect()) == [0, 2]
    assert [r["pos"] for r in access.allowlist_violations(preferred, allow).collect()] == [1]
    nothing = local_rows(spark, [], "capability STRING, provider STRING, model STRING")
    assert access.allowed_models(preferred, nothing).count() == 3


def test_disabled_features(spark):
    features = local_rows(spark, [("ai/x",), ("ai/y",)], "feature_id STRING")
    assert [r["feature_id"] for r in access.enabled_features(features, ["AI/X"]).collect()] == ["ai/y"]
    assert access.enabled_features(features, []).count() == 2


def test_retention(spark):
    frame = spending(spark, 1).union(spending(spark, 1).withColumn("period", F.lit("2021-12")))
    day = F.lit("2024-01-15").cast("date")
    assert retention.usage_retained(frame, day, 24).count() == 1
    assert retention.usage_retained(frame, day, 0).count() == 2
    assert tuple(retention.usage_swept(frame, day, 24).first()) == ("2022-01", 1)
    assert retention.usage_swept(frame, day, 0).first()["removed"] == 0
    assert retention.retention_days(0, 30) == 30 and retention.retention_days(7, 30) == 7


def replayed(spark, policy, answers=(), **options):
    """What stops each of a few requests under a policy."""
    model = '{"model":"m-%d"}'
    exchange = local_rows(
        spark,
        [(i, at(i * 100), at(i * 100 + 1), 1, f"/wp-abilities/v1/{ability}/run", "https://api.openai.com/v1/x", model % (i % 2), "{}", None)
         for i, ability in enumerate(["ai/summarization", "ai/title-generation", "ai/summarization", "ai/image-generation"])],
        "request_id BIGINT, ts TIMESTAMP, end_ts TIMESTAMP, user_id BIGINT, route STRING, uri STRING, request_body STRING, "
        "response_body STRING, error_message STRING")
    users = local_rows(spark, [(1, ["editor"], False)], "user_id BIGINT, roles ARRAY<STRING>, manage_options BOOLEAN")
    roles = local_rows(spark, [], "ability_id STRING, roles ARRAY<STRING>")
    texts = local_rows(spark, list(answers), "request_id BIGINT, text STRING")
    rows = jobs.governance_replay(exchange, users, roles, texts, policy, **options).collect()
    return {r["request_id"]: (r["stopped_by"], r["output_blocked"]) for r in rows}


def test_replay_gates_of_the_policy(spark):
    """A feature that is off uses no slot; the model list of a kind without entries allows all."""
    once = [RateWindow("day", 86_400, 1)]
    assert replayed(spark, Policy(rate_windows=once))[2] == ("rate:day", False)
    off = replayed(spark, Policy(rate_windows=once, disabled_features=["AI/Summarization"]))
    assert off == {0: ("feature", False), 1: (None, False), 2: ("feature", False), 3: (None, False)}
    kind = F.when(F.col("ability_id") == "ai/image-generation", "image").otherwise("text")
    listed = Policy(model_allowlist=[("text", "openai", "m-0"), ("vision", "openai", "m-9")])
    assert replayed(spark, listed, model_kind=kind) == {0: (None, False), 1: ("model", False), 2: (None, False), 3: (None, False)}


def test_replay_with_a_long_phrase_list(spark):
    texts = [(0, "never SAY this"), (1, "fine"), (3, "say")]
    phrases = ["say this", *[f"unused phrase {i}" for i in range(jobs.MANY_PHRASES)]]
    short, long = (replayed(spark, Policy(banned_phrases=p), texts) for p in (phrases[:1], phrases))
    assert short == long == {0: (None, True), 1: (None, False), 2: (None, False), 3: (None, False)}


def test_log_retention_job(spark):
    rows = log(spark, [(1, 1, "a", 0), (2, 1, "a", 86_400 * 5)])
    now = F.lit(at(86_400 * 8)).cast("timestamp")
    assert [r["request_id"] for r in jobs.retain_log(rows, now, Policy(log_retention_days=4)).collect()] == [2]
    assert jobs.retain_log(rows, now).count() == 2


def test_window_counts_share_the_counter_of_nobody(spark):
    rows = log(spark, [(1, None, "a", 0), (2, 0, "a", 1)])
    assert [(r["user_id"], r["requests"], r["exceeded"]) for r in ratelimit.window_counts(rows, "1 minute", 1).collect()] == [(0, 2, True)]
