"""The catalogue of runnable queries over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions import money, outputs, sql
from govlake.operators import (
    access, budget, guidelines, intervals, moderate, policies, prompts, ratelimit, redact, requests, retention,
    usage,
)
from govlake.plans import jobs
from govlake.policy import Policy
from govlake.session import apply_runtime_conf, scratch_path
from govlake.sources import colocated, raw, sample, sinks
from govlake.sources.tables import local_rows, sample_stream, sample_table, stream_table
from govlake.streaming import ratelimit as stream_limits
from govlake.streaming import asof, scrub
from govlake.streaming import usage as stream_usage_rules
from govlake.streaming.run import drain

Query = Callable[[SparkSession, str], DataFrame]

MONTH = "2024-01"
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under the name of its function."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(apply_runtime_conf(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def _usd(column: str = "usd_micros") -> Column:
    return money.usd_double(F.col(column)).alias("usd_spent")


def _micros(column: str, name: str) -> Column:
    return F.unix_micros(column).alias(name)


def _events(spark, sf_dir):
    return requests.shape_requests(sample.exchange(spark, sf_dir))


def _costed(spark, sf_dir):
    return usage.request_cost(_events(spark, sf_dir), sample.prices(spark))


def _usage(spark, sf_dir):
    return usage.usage_rollup(_costed(spark, sf_dir))


def _exempt(spark, sf_dir):
    return sample.users(spark, sf_dir).where("manage_options")


def _aged_usage(spark, sf_dir):
    """The rollup with its months spread over the two years before."""
    months_back = (F.col("user_id") % 25).cast("int")
    aged = F.date_format(F.add_months(F.to_date(F.concat("period", F.lit("-01"))), -months_back), "yyyy-MM")
    return _usage(spark, sf_dir).withColumn("period", aged)


# -- requests and usage ------------------------------------------------------------------

@query
def shape_requests(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("ts", F.unix_micros("ts"))


@query
def shape_raw_json(spark, sf_dir):
    """The same events from a log of JSON lines, some of them broken, with bodies parsed once."""
    path = scratch_path(spark, "raw")
    exchange = sample.exchange(spark, sf_dir)
    lines = exchange.select(F.to_json(F.struct(*exchange.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    broken = exchange.where("request_id % 50 = 0").select(F.concat(F.lit('{"request_id": '), F.col("route")).alias("value"))
    lines.unionByName(broken).write.text(path)
    parsed, rest = raw.read_exchange(spark, path)
    events = requests.shape_parsed(parsed).unionByName(requests.shape_requests(raw.texts(rest)))
    return events.withColumn("ts", F.unix_micros("ts"))


@query
def route_ability(spark, sf_dir):
    """Traffic per ability on governed routes, odd routes included."""
    kind = F.col("request_id") % 6
    tail = F.element_at(F.split("route", "/"), -2)
    routes = sample.exchange(spark, sf_dir).withColumn(
        "route",
        F.when(kind == 0, F.concat(F.lit("/wp-abilities/v1/ai/running-"), tail, F.lit("/run")))
        .when(kind == 1, F.replace("route", F.lit("/run"), F.lit("/describe/more")))
        .when(kind == 2, F.concat(F.lit("/other"), F.col("route")))
        .when(kind == 3, F.replace("route", F.lit("/wp-abilities/v1"), F.lit("/wp/v2")))
        .otherwise(F.col("route")),
    )
    return requests.governed(routes).groupBy("ability_id").agg(F.count(F.lit(1)).alias("requests"))


@query
def request_cost(spark, sf_dir):
    return _costed(spark, sf_dir).select("request_id", "user_id", "period", "provider", "model", "status", _usd())


@query
def usage_rollup(spark, sf_dir):
    return _usage(spark, sf_dir).select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd(),
        _micros("updated_at", "updated_us"))


@query
def usage_by_user(spark, sf_dir):
    return jobs.monthly_usage(sample.exchange(spark, sf_dir), MONTH, sample.prices(spark))


@query
def top_spenders(spark, sf_dir):
    return usage.top_spenders(_usage(spark, sf_dir), MONTH, 20)


@query
def usage_subtotals(spark, sf_dir):
    return usage.usage_subtotals(_usage(spark, sf_dir)).select(
        "period", "provider", "model", "level", "requests", "tokens_in", "tokens_out", _usd())


@query
def usage_upsert(spark, sf_dir):
    costed = _costed(spark, sf_dir)
    even = F.col("request_id") % 2 == 0
    merged = usage.add_usage(usage.usage_rollup(costed.where(even)), usage.usage_rollup(costed.where(~even)))
    return merged.select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd(),
        _micros("updated_at", "updated_us"))


@query
def usage_retained(spark, sf_dir):
    today = F.lit("2025-03-31").cast("date")
    return retention.usage_retained(_aged_usage(spark, sf_dir), today, 20).select(
        "user_id", "period", "provider", "model", "requests", _usd())


@query
def usage_swept(spark, sf_dir):
    return retention.usage_swept(_aged_usage(spark, sf_dir), F.lit("2025-03-31").cast("date"), 20)


@query
def usage_store_upsert(spark, sf_dir):
    """The rollup from a stored table: half of it written, the rest upserted (once again, too)."""
    costed, path = _costed(spark, sf_dir), scratch_path(spark, "store")
    part = F.col("request_id") % 4
    sinks.write_usage(spark, path, usage.usage_rollup(costed.where(part < 2)))
    for batch in (0, 0, 1, 1, 0):
        sinks.upsert_usage(spark, path, usage.usage_rollup(costed.where(part == 2 + batch)), batch)
    return sinks.read_usage(spark, path).select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd(),
        _micros("updated_at", "updated_us"))


@query
def usage_colocated(spark, sf_dir):
    """The rollup from a table in buckets by user, upserted twice in place of its state."""
    costed, part = _costed(spark, sf_dir), F.col("request_id") % 3
    table = colocated.store(usage.usage_rollup(costed.where(part == 0)), 8)
    for number in (1, 2):
        table = colocated.upsert(spark, table, usage.usage_rollup(costed.where(part == number)))
    return table.read(spark).select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd(),
        _micros("updated_at", "updated_us"))


@query
def usage_store_swept(spark, sf_dir):
    path = scratch_path(spark, "store")
    sinks.write_usage(spark, path, _aged_usage(spark, sf_dir))
    jobs.sweep_usage(spark, path, F.lit("2025-03-31").cast("date"), Policy(usage_retention_months=20))
    return sinks.read_usage(spark, path).select("user_id", "period", "provider", "model", "requests", _usd())


@query
def requests_deduped(spark, sf_dir):
    """A log with redelivered events, each of them once."""
    events = _events(spark, sf_dir)
    return requests.dedupe(events.unionByName(events.where("request_id % 3 = 0"))).select(
        "request_id", "user_id", "ability_id", "status", _micros("ts", "ts_us"))


@query
def unknown_abilities(spark, sf_dir):
    named = sample.calls(spark, sf_dir).select(
        F.when(F.col("request_id") % 9 == 0, F.concat("ability_id", F.lit("s"))).otherwise(F.col("ability_id")).alias("ability_id"))
    return access.unknown_abilities(named.groupBy("ability_id").agg(F.count(F.lit(1)).alias("calls")), sample.abilities(spark))


@query
def log_retained(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return retention.log_retained(_events(spark, sf_dir), now, 0, 14).select("request_id", _micros("ts", "ts_us"))


# -- budgets -------------------------------------------------------------------------------

@query
def over_budget_users(spark, sf_dir):
    return budget.over_budget_users(_usage(spark, sf_dir), sample.CAP_USD).select(
        "user_id", "period", _usd("spent_micros"))


@query
def budget_gate(spark, sf_dir):
    people = sample.users(spark, sf_dir).select("user_id", F.col("manage_options").alias("exempt"))
    checks = sample.calls(spark, sf_dir).join(people, "user_id").select(
        "request_id", "user_id", "exempt", F.lit(True).alias("granted"),
        F.when(F.col("request_id") % 10 == 0, "edit_posts").otherwise(jobs.capability_of(F.col("ability_id"))).alias("capability"))
    return budget.budget_gate(checks, _usage(spark, sf_dir), sample.CAP_USD, MONTH).select(
        "request_id", "user_id", "capability", "granted")


@query
def budget_crossings(spark, sf_dir):
    return budget.budget_crossings(_costed(spark, sf_dir), sample.CAP_USD, _exempt(spark, sf_dir)).select(
        "user_id", "period", _micros("crossed_at", "crossed_us"), "crossing_id", _usd("spent_micros"))


@query
def budget_replay(spark, sf_dir):
    return budget.budget_replay(_costed(spark, sf_dir), sample.CAP_USD, _exempt(spark, sf_dir)).select(
        "request_id", "user_id", _usd(), "over_budget")


# -- rate limits ---------------------------------------------------------------------------

@query
def rate_limit_replay(spark, sf_dir):
    narrow = requests.governed(sample.exchange(spark, sf_dir)).select("request_id", "user_id", "ability_id", "ts")
    return ratelimit.rate_limit_replay(narrow, sample.RATE_WINDOWS).select(
        "request_id", "user_id", "ability_id", "rate_decision",
        ratelimit.rejection_message(F.col("rate_decision"), sample.RATE_WINDOWS).alias("message"))


@query
def rate_limit_shared(spark, sf_dir):
    """All callers as one that is not logged in: few keys hold the whole log and are folded by buckets of time."""
    narrow = requests.governed(sample.exchange(spark, sf_dir)).select("request_id", F.lit(None).cast("bigint").alias("user_id"), "ability_id", "ts")
    return ratelimit.rate_limit_replay(narrow, sample.SHARED_WINDOWS, hot_ticks=200).select("request_id", "ability_id", "rate_decision")


@query
def window_counts(spark, sf_dir):
    return ratelimit.window_counts(_events(spark, sf_dir), "1 hour", 1).select(
        "user_id", "ability_id", _micros("window_start", "window_us"), "requests", "exceeded")


# -- access --------------------------------------------------------------------------------

@query
def role_gate(spark, sf_dir):
    people = sample.users(spark, sf_dir).select("user_id", "roles")
    checks = sample.calls(spark, sf_dir).join(people, "user_id").select(
        "request_id", "user_id", "roles", (F.col("request_id") % 4 != 0).alias("granted"),
        F.when(F.col("request_id") % 10 == 0, "edit_posts").otherwise(jobs.capability_of(F.col("ability_id"))).alias("capability"))
    return access.role_gate(checks, sample.role_map(spark)).select(
        "request_id", "user_id", "capability", "ability_id", "granted")


@query
def enabled_features(spark, sf_dir):
    used = sample.calls(spark, sf_dir).groupBy(F.col("ability_id").alias("feature_id")).agg(F.count(F.lit(1)).alias("calls"))
    return access.enabled_features(used, sample.DISABLED)


def _model_calls(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("capability", sample.capability_kind(F.col("ability_id")))


@query
def allowed_models(spark, sf_dir):
    preferred = _model_calls(spark, sf_dir).groupBy("user_id", "capability", "provider", "model").agg(
        F.min("request_id").alias("pos"))
    return access.allowed_models(preferred, sample.allowlist(spark))


@query
def allowlist_violations(spark, sf_dir):
    return access.allowlist_violations(_model_calls(spark, sf_dir), sample.allowlist(spark)).select(
        "request_id", "user_id", "capability", "provider", "model")


# -- redaction and moderation --------------------------------------------------------------

@query
def pii_redact(spark, sf_dir):
    return redact.redact_column(sample_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query
def pii_report(spark, sf_dir):
    return redact.pii_report(sample_table(spark, sf_dir, "documents"), "text", ["source", "lang"])


@query
def output_text(spark, sf_dir):
    return sample.outputs(spark, sf_dir).select("conv_id", "turn", outputs.output_text(F.col("body")).alias("answer"))


def _moderated(spark, sf_dir):
    answers = sample.outputs(spark, sf_dir).withColumn("answer", outputs.output_text(F.col("body")))
    return moderate.moderate(answers, F.col("answer"), sample.BANNED)


@query
def moderate_outputs(spark, sf_dir):
    return _moderated(spark, sf_dir).select(
        "conv_id", "turn", "violation", F.col("response.status").alias("status"), F.col("response.code").alias("code"),
        F.col("response.message").alias("message"))


@query
def moderation_violations(spark, sf_dir):
    return moderate.violations(_moderated(spark, sf_dir)).select("conv_id", "turn", "violation", "answer")


def _benchmark_phrases(spark, sf_dir):
    return sample_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("phrase"))


@query
def phrase_matches(spark, sf_dir):
    docs = sample_table(spark, sf_dir, "documents")
    return moderate.phrase_matches(docs, "doc_id", "text", _benchmark_phrases(spark, sf_dir))


@query
def corpus_scrub(spark, sf_dir):
    docs = sample_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jobs.corpus_scrub(docs, "doc_id", "text", _benchmark_phrases(spark, sf_dir))


# -- prompts -------------------------------------------------------------------------------

@query
def prompt_current(spark, sf_dir):
    return prompts.prompt_current(sample.prompt_edits(spark, sf_dir)).withColumn("updated_at", F.unix_micros("updated_at"))


@query
def prompt_audit(spark, sf_dir):
    return prompts.prompt_audit(sample.prompt_edits(spark, sf_dir)).withColumn("updated_at", F.unix_micros("updated_at"))


@query
def prompt_history(spark, sf_dir):
    audit = prompts.prompt_audit(sample.prompt_edits(spark, sf_dir))
    return prompts.prompt_history(audit).select("ability_id", "rank", "edit_id", "action", "mode", "template", "updated_by")


@query
def prompt_catalog(spark, sf_dir):
    overrides = prompts.prompt_current(sample.prompt_edits(spark, sf_dir))
    return prompts.prompt_catalog(sample.abilities(spark), overrides).select(
        "pos", "ability_id", "label", F.col("override.mode").alias("mode"), F.col("override.template").alias("template"),
        F.col("override.updated_by").alias("updated_by"))


@query
def prompt_lookup(spark, sf_dir):
    wanted = sample.calls(spark, sf_dir).select(
        "request_id",
        F.when(F.col("request_id") % 9 == 0, F.concat("ability_id", F.lit("s"))).otherwise(F.col("ability_id")).alias("ability_id"))
    overrides = prompts.prompt_current(sample.prompt_edits(spark, sf_dir))
    return prompts.prompt_lookup(wanted, sample.abilities(spark), overrides)


@query
def prompt_asof(spark, sf_dir):
    made = sample.calls(spark, sf_dir).select("request_id", "ability_id", "ts")
    return prompts.prompt_asof(made, sample.prompt_edits(spark, sf_dir)).drop("ts")


def _stored_history(spark, sf_dir):
    """The edit log in three batches, the last first, one of them twice."""
    edits, path = sample.prompt_edits(spark, sf_dir), scratch_path(spark, "history")
    part = F.pmod(F.xxhash64("edit_id"), F.lit(3))
    for batch in (2, 0, 1, 0):
        sinks.record_edits(spark, path, edits.where(part == batch), batch)
    return sinks.read_intervals(spark, path)


@query
def prompt_intervals(spark, sf_dir):
    return _stored_history(spark, sf_dir).select("ability_id", "edit_id", "from_us", "to_us", "live", "mode", "template")


@query
def prompt_asof_stored(spark, sf_dir):
    """The version in force at every call, looked up in the stored intervals."""
    made = sample.calls(spark, sf_dir).select("request_id", "ability_id", "ts")
    return intervals.interval_asof(made, _stored_history(spark, sf_dir)).drop("ts")


@query
def ability_catalog(spark, sf_dir):
    return policies.ability_catalog(sample.registered_abilities(spark, sf_dir), sample.sites(spark, sf_dir))


@query
def policy_snapshot(spark, sf_dir):
    types = sample.guideline_posts(spark, sf_dir).select("site_id", "post_type")
    return policies.policy_snapshot(sample.policies(spark, sf_dir), types, sample.sites(spark, sf_dir))


@query
def policy_merge(spark, sf_dir):
    log = sample.policies(spark, sf_dir)

    def latest(rows):
        return rows.groupBy("site_id", "key").agg(F.max_by("value", "version").alias("value"))

    update = latest(log.where("version % 3 = 1")).withColumn(
        "value", F.when(F.col("site_id") % 4 != 0, F.col("value")))
    return policies.policy_merge(latest(log.where("version % 3 <> 1")), update)


# -- guidelines ----------------------------------------------------------------------------

def _current_guidelines(spark, sf_dir):
    return guidelines.guideline_current(sample.guideline_posts(spark, sf_dir), ["wp_guideline", "wp_content_guideline"])


def _guideline_dim(spark, sf_dir):
    return guidelines.guideline_dim(
        _current_guidelines(spark, sf_dir), sample.guideline_meta(spark, sf_dir), sample.guideline_revisions(spark, sf_dir))


@query
def guideline_current(spark, sf_dir):
    return _current_guidelines(spark, sf_dir).withColumn("post_date", F.unix_micros("post_date"))


@query
def guideline_categories(spark, sf_dir):
    return guidelines.guideline_categories(_current_guidelines(spark, sf_dir), sample.guideline_meta(spark, sf_dir))


@query
def guideline_block_rules(spark, sf_dir):
    return guidelines.guideline_block_rules(_current_guidelines(spark, sf_dir), sample.guideline_meta(spark, sf_dir))


@query
def guideline_sections(spark, sf_dir):
    return guidelines.guideline_sections(_guideline_dim(spark, sf_dir))


@query
def post_blocks(spark, sf_dir):
    return guidelines.post_blocks(sample.posts(spark, sf_dir)).select(
        "post_id", F.array_join("blocks", ",").alias("blocks"))


@query
def relevant_block_rules(spark, sf_dir):
    rules = guidelines.guideline_block_rules(_current_guidelines(spark, sf_dir), sample.guideline_meta(spark, sf_dir))
    return guidelines.relevant_block_rules(guidelines.post_blocks(sample.posts(spark, sf_dir)), rules)


def _rendered(spark, sf_dir):
    preamble = F.when(F.col("ability_id") != "ai/meta-description", F.lit("Be brief.")).otherwise(F.lit(""))
    return jobs.effective_prompts(
        sample.calls(spark, sf_dir), sample.prompt_edits(spark, sf_dir), sample.users(spark, sf_dir),
        sample.posts(spark, sf_dir), sample.guideline_posts(spark, sf_dir), sample.guideline_meta(spark, sf_dir),
        sample.guideline_revisions(spark, sf_dir), preamble=preamble,
        site_name=F.concat(F.lit("Site "), F.col("site_id").cast("string")), site_url=F.lit("https://example.org"))


@query
def render_prompts(spark, sf_dir):
    return _rendered(spark, sf_dir).select("request_id", "ability_id", "site_id", "prompt")


@query
def guideline_audit(spark, sf_dir):
    return prompts.guideline_audit(_rendered(spark, sf_dir))


# -- jobs and streams ----------------------------------------------------------------------

def _replay(spark, sf_dir):
    answers = sample_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    policy = Policy(rate_windows=sample.RATE_WINDOWS, monthly_user_cap_usd="0.05", banned_phrases=sample.BANNED)
    return jobs.governance_replay(
        sample.exchange(spark, sf_dir), sample.users(spark, sf_dir), sample.role_map(spark), answers, policy,
        sample.prices(spark),
    )


@query
def governance_replay(spark, sf_dir):
    return _replay(spark, sf_dir).select("request_id", "user_id", "ability_id", "stopped_by", _usd(), "output_blocked")


@query
def governance_events(spark, sf_dir):
    """How many requests were stopped, and by what, as counted while the replay was written."""
    counts = jobs.write_replay(_replay(spark, sf_dir), scratch_path(spark, "replay"))
    return local_rows(spark, sorted(counts.items()), "event STRING, n BIGINT")


@query
def sql_request_cost(spark, sf_dir):
    """Cost of every request in SQL alone."""
    sql.register(spark)
    return spark.sql(
        """SELECT e.request_id, coalesce(e.user_id, 0L) AS user_id, gov_period(e.ts) AS period, e.provider, e.model, e.status,
             CASE WHEN e.status = 'success' THEN gov_price_micros(e.sent, e.received, p.rate_in, p.rate_out) ELSE 0L END / 1e6D AS usd_spent
           FROM (SELECT *, gov_provider(uri) AS provider, gov_model(request_body) AS model, gov_status(error_message) AS status,
                   gov_tokens_in(response_body) AS sent, gov_tokens_out(response_body) AS received FROM {exchange}) e
           LEFT JOIN {prices} p ON p.provider = e.provider AND p.model = e.model""",
        exchange=sample.exchange(spark, sf_dir), prices=sample.prices(spark))


@query
def sql_pii_redact(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id, gov_redact(text) AS text FROM {documents}", documents=sample_table(spark, sf_dir, "documents"))


def _exchange_stream(spark, sf_dir):
    return sample.exchange_of(sample_stream(spark, sf_dir, "events"))


@query
def stream_usage(spark, sf_dir):
    return stream_usage_rules.stream_usage(_exchange_stream(spark, sf_dir)).select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd())


@query
def stream_usage_late(spark, sf_dir):
    """The same, from files that each span the whole time and repeat some of the others' events,
    with a horizon that covers it."""
    exchange = sample.exchange(spark, sf_dir)
    part, folder = F.pmod(F.xxhash64("request_id"), F.lit(3)), scratch_path(spark, "mixed")
    for number in range(3):
        exchange.where((part == number) | ((F.col("request_id") % 10 == number) & (part < number))).write.mode("append").parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in exchange.schema.fields)
    return stream_usage_rules.stream_usage(stream_table(spark, folder, schema, maxFilesPerTrigger="8"), horizon="40 days").select(
        "user_id", "period", "provider", "model", "requests", "tokens_in", "tokens_out", _usd())


@query
def stream_spend_alerts(spark, sf_dir):
    costed = usage.request_cost(requests.shape_requests(_exchange_stream(spark, sf_dir)))
    alerts = stream_usage_rules.spend_alerts(costed, sample.CAP_USD, _exempt(spark, sf_dir), log=usage.request_cost(_events(spark, sf_dir)))
    return alerts.select("user_id", "period", "slot", _usd("spent_micros"))


@query
def stream_rate_limits(spark, sf_dir):
    def governed(exchange):
        return requests.governed(exchange).select("user_id", "ability_id", "ts")

    decided = stream_limits.stream_rate_limits(
        governed(_exchange_stream(spark, sf_dir)), sample.RATE_WINDOWS, log=governed(sample.exchange(spark, sf_dir)))
    return decided.select("user_id", "ability_id", "tick", "requests", "allowed",
                          F.get("rejected", F.lit(0)).alias("over_hour"), F.get("rejected", F.lit(1)).alias("over_day"))


@query
def stream_prompt_asof(spark, sf_dir):
    """The version in force at every call, from a stream of calls and one of edits."""
    def narrow(calls):
        return calls.select("request_id", "ability_id", "ts")

    return asof.stream_prompt_asof(
        narrow(sample.calls_of(sample_stream(spark, sf_dir, "events"))), sample.prompt_edits_of(sample_stream(spark, sf_dir, "events")),
        call_log=narrow(sample.calls(spark, sf_dir)), edit_log=sample.prompt_edits(spark, sf_dir))


@query
def stream_moderate(spark, sf_dir):
    answers = sample.outputs_of(sample_stream(spark, sf_dir, "conversations"))
    moderated = scrub.stream_moderate(answers, "body", sample.BANNED)
    return drain(spark, moderated.select("conv_id", "turn", "violation", F.col("response.status").alias("status")), "moderated")


@query
def stream_redact(spark, sf_dir):
    texts = sample_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return drain(spark, scrub.stream_redact(texts, "text"), "redacted")
