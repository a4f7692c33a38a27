"""Role gates, feature switches and the model allowlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import requests as rq
from govlake.functions.text import feature_key
from govlake.operators.sizing import small_side
from govlake.sources.tables import local_rows

MODEL_KEYS = ("capability", "provider", "model")


def role_gate(checks: DataFrame, role_map: DataFrame) -> DataFrame:
    """Capability checks against the roles allowed per ability.

    ``checks`` has capability, roles and granted. A mapped ability replaces the answer by
    "has any allowed role" (so it grants as well as denies, and an empty list denies all);
    unmapped abilities and other capabilities keep it.
    """
    allowed = role_map.select("ability_id", F.col("roles").alias("_allowed"))
    named = checks.withColumn(
        "ability_id",
        F.when(rq.is_ability_capability(F.col("capability")), rq.ability_of_capability(F.col("capability"))),
    )
    has_role = F.coalesce(F.arrays_overlap("_allowed", "roles"), F.lit(False))
    return named.join(small_side(allowed), "ability_id", "left").select(
        *[c for c in checks.columns if c != "granted"], "ability_id",
        F.when(F.col("_allowed").isNull(), F.col("granted")).otherwise(has_role).alias("granted"),
    )


def enabled_features(features: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """Rows whose ``feature_id`` is not switched off; ids are compared in key form."""
    off = local_rows(features.sparkSession, [(d,) for d in disabled], "feature STRING").select(
        feature_key(F.col("feature")).alias("_key")
    )
    return (
        features.withColumn("_key", feature_key(F.col("feature_id")))
        .join(small_side(off), "_key", "left_anti").drop("_key")
    )


def allowed_models(preferred: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Preferred models the allowlist keeps; a capability without a list keeps all."""
    keys = allowlist.select(*MODEL_KEYS).distinct()
    listed = keys.select("capability").distinct().withColumn("_listed", F.lit(True))
    named = keys.withColumn("_named", F.lit(True))
    marked = preferred.join(small_side(listed), "capability", "left").join(small_side(named), list(MODEL_KEYS), "left")
    return marked.where("_listed is null or _named").select(preferred.columns)


def allowlist_violations(calls: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Logged calls that used a model the allowlist of their capability does not name."""
    listed = allowlist.select("capability").distinct()
    return (
        calls.join(small_side(listed), "capability", "left_semi")
        .join(small_side(allowlist.select(*MODEL_KEYS)), list(MODEL_KEYS), "left_anti")
        .select(calls.columns)
    )


def unknown_abilities(configured: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Configured ability ids the catalogue does not know; a mistyped id gates nothing."""
    return configured.join(catalogue.select("ability_id"), "ability_id", "left_anti")
