"""Jobs composed from the operators, configured by one Policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.functions import guidelines as gl
from govlake.functions import outputs
from govlake.functions.requests import CAPABILITY_PREFIX
from govlake.functions.text import feature_key
from govlake.operators import access, budget, events, guidelines, moderate, prompts, ratelimit, redact, requests, retention, usage
from govlake.operators.sizing import settled, spread
from govlake.policy import Policy
from govlake.session import scratch_path
from govlake.sources.sinks import read_usage, remove_months
from govlake.sources.tables import local_rows


# Phrases up to which each is tried on every answer.
MANY_PHRASES = 50


def monthly_usage(exchange: DataFrame, month: str, prices: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """Spend report of a month straight from the raw log; the scan reads that month only."""
    start = F.lit(f"{month}-01").cast("date")
    in_month = (F.col("ts") >= start.cast("timestamp")) & (F.col("ts") < F.add_months(start, 1).cast("timestamp"))
    events = requests.shape_requests(exchange.where(in_month), policy.parse_usage_metadata)
    return usage.usage_by_user(usage.usage_rollup(usage.request_cost(events, prices)), month)


def corpus_scrub(docs: DataFrame, doc_id: str, text: str, phrases: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Redacted text per document with the banned phrases found in the original."""
    # Two numbers per document hit; settled, they are broadcast rather than the texts shuffled.
    found = settled(moderate.phrase_matches(docs, doc_id, text, phrases), "phrases-found")
    return redact.redact_column(docs, text, policy.pii_patterns, policy.redact_pii).join(found, doc_id, "left")


def capability_of(ability: Column) -> Column:
    return F.concat(F.lit(CAPABILITY_PREFIX), F.translate(ability, "/-", "__"))


def _feature_off(policy: Policy) -> Column:
    """Whether the feature of an ability is switched off; ids are compared in key form."""
    off = [feature_key(F.lit(name)) for name in policy.disabled_features]
    return feature_key(F.col("ability_id")).isin(*off) if off else F.lit(False)


def _model_refused(policy: Policy, kind: Column | None) -> Column:
    """Whether the allowlist has a list for the request's kind and its model isn't on it."""
    refused = F.lit(False)
    kind = F.lit("text") if kind is None else kind
    for capability in sorted({row[0] for row in policy.model_allowlist}):
        pairs = [row[1:] for row in policy.model_allowlist if row[0] == capability]
        named = F.lit(False)
        for provider, model in pairs:
            named = named | ((F.col("provider") == provider) & (F.col("model") == model))
        refused = F.when(kind == capability, ~F.coalesce(named, F.lit(False))).otherwise(refused)
    return refused


def retain_log(log: DataFrame, now: Column, policy: Policy = Policy(), current_days: int = 90) -> DataFrame:
    """The request log without what is past the policy's (or else the host's) days."""
    return retention.log_retained(log, now, policy.log_retention_days, current_days)


def sweep_log(log: DataFrame, now: Column, path: str, policy: Policy = Policy(), current_days: int = 90) -> dict[str, int]:
    """Write the log without what is past its days to a new table; how many rows were kept and
    removed, counted on the way."""
    kept, seen = retention.log_swept(log, now, policy.log_retention_days, current_days)
    kept.write.parquet(path)
    return seen.get


def write_replay(replay: DataFrame, path: str) -> dict[str, int]:
    """Write a governance replay; how many requests were stopped, by what, and how many answers blocked."""
    watched, seen = events.observed(replay, events.replay_metrics())
    watched.write.parquet(path)
    return seen.get


def governance_replay(
    exchange: DataFrame,
    users: DataFrame,
    role_map: DataFrame,
    answers: DataFrame,
    policy: Policy,
    prices: DataFrame | None = None,
    materialize: bool = True,
    model_kind: Column | None = None,
) -> DataFrame:
    """Per request: the first gate that stops it, its cost, and whether its answer is blocked.

    Order of the gates: feature switch, rate limit, role, model allowlist, budget. A request
    a later gate denies has still used its rate-limit slot; that of a feature that is off
    was never made. An answer that is blocked has already been paid for. Only requests that
    pass the earlier gates add to the spend the budget looks at. ``model_kind`` tells, from
    ability_id, which list of the allowlist a request falls under (text unless given).
    """
    spark = exchange.sparkSession
    governed = requests.governed(exchange).drop("ability_id")
    shaped = requests.shape_requests(governed, policy.parse_usage_metadata)
    off = _feature_off(policy)
    narrow = usage.request_cost(shaped, prices).select(
        "request_id", "ts", "user_id", "ability_id", "period", "status", "usd_micros",
        _model_refused(policy, model_kind).alias("refused"), off.alias("off"),
    )
    limited = ratelimit.rate_limit_replay(narrow.where(~F.col("off")) if policy.disabled_features else narrow, policy.rate_windows)
    if policy.disabled_features:
        limited = limited.unionByName(narrow.where("off").withColumn("rate_decision", F.lit("allowed")))
    checks = limited.join(users.select("user_id", "roles"), "user_id", "left").select(
        *limited.columns, "roles",
        capability_of(F.col("ability_id")).alias("capability"), F.lit(True).alias("granted"),
    )
    gated = access.role_gate(checks.withColumnRenamed("ability_id", "invoked"), role_map)
    gated = gated.drop("roles", "capability", "ability_id").withColumnRenamed("invoked", "ability_id")
    if materialize:
        # Needed twice (crossings and requests); three shuffles are not worth repeating.
        path = scratch_path(spark, "gated")
        gated.write.parquet(path)
        gated = spark.read.schema(gated.schema).parquet(path)

    spending = gated.where("NOT off AND rate_decision = 'allowed' AND granted AND NOT refused")
    crossings = budget.budget_crossings(spending, policy.monthly_user_cap_usd, users.where("manage_options"))
    replayed = budget.over_at_request(gated, crossings)
    gate = (
        F.when(F.col("off"), F.lit("feature"))
        .when(F.col("rate_decision") != "allowed", F.concat(F.lit("rate:"), "rate_decision"))
        .when(~F.col("granted"), F.lit("role"))
        .when(F.col("refused"), F.lit("model"))
        .when(F.col("over_budget"), F.lit("budget"))
    )
    passed = F.col("stopped_by").isNull()
    decided = replayed.withColumn("stopped_by", gate).select(
        "request_id", "user_id", "ability_id", "stopped_by",
        F.when(passed, F.col("usd_micros")).otherwise(F.lit(0).cast("bigint")).alias("usd_micros"),
        (passed & (F.col("status") == "success")).alias("_answered"),
    )
    if len(policy.banned_phrases) > MANY_PHRASES:
        listed = local_rows(spark, enumerate(policy.banned_phrases), "pos INT, phrase STRING")
        verdicts = moderate.phrase_matches(answers.select("request_id", "text"), "request_id", "text", listed).select(
            "request_id", F.lit(True).alias("_violates")
        )
    else:
        verdicts = spread(answers.select("request_id", "text"), "request_id").select(
            "request_id", outputs.violation(F.col("text"), policy.banned_phrases).isNotNull().alias("_violates")
        ).where("_violates")
    return decided.join(verdicts, "request_id", "left").select(
        "request_id", "user_id", "ability_id", "stopped_by", "usd_micros",
        (F.col("_answered") & F.coalesce("_violates", F.lit(False))).alias("output_blocked"),
    )


def effective_prompts(
    calls: DataFrame,
    edits: DataFrame,
    users: DataFrame,
    posts: DataFrame,
    guideline_posts: DataFrame,
    guideline_meta: DataFrame,
    guideline_revisions: DataFrame,
    policy: Policy = Policy(),
    registered_types: Sequence[str] = gl.POST_TYPES,
    preamble: Column | None = None,
    **options,
) -> DataFrame:
    """The prompt of every call from the edit log, the posts and the guideline tables.

    ``preamble`` overrides the policy's preamble per ability; ``options`` go to
    ``render_prompts`` (site_name, site_url, extra).
    """
    current = guidelines.guideline_current(guideline_posts, registered_types, policy.guideline_statuses)
    dim = guidelines.guideline_dim(current, guideline_meta, guideline_revisions, policy.guidelines_on())
    return prompts.render_prompts(
        calls, settled(prompts.prompt_current(edits), "overrides"), users, guidelines.post_blocks(posts), settled(dim, "guidelines"),
        preamble=F.lit(policy.preamble) if preamble is None else preamble,
        abilities=policy.guideline_abilities, guideline_text=policy.guideline_text, **options,
    )


def sweep_usage(spark: SparkSession, path: str, today: Column, policy: Policy = Policy()) -> tuple[str, int]:
    """Remove the expired months of a stored rollup, in place; returns cutoff and rows removed.

    The log loses the expired months first, so none comes back. Only the folders of expired
    months are touched.
    """
    swept = retention.usage_swept(read_usage(spark, path), today, policy.usage_retention_months).first()
    if policy.usage_retention_months > 0:
        remove_months(spark, path, swept["cutoff"])
    return swept["cutoff"], swept["removed"]
