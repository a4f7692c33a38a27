"""The ability catalogue and the policy options, per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions.guidelines import POST_TYPES
from govlake.policy import ABILITIES, POLICY_DEFAULTS

ABILITY_PREFIX = "ai/"


def _sites(by: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Every site that any of the frames names."""
    named = [frame.select(*by) for frame in frames]
    every = named[0]
    for frame in named[1:]:
        every = every.unionByName(frame)
    return every.distinct()


def ability_catalog(registered: DataFrame, sites: DataFrame | None = None, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Registered abilities below ``ai/``; a site that has none gets the built-in list.

    ``registered`` has the site columns, pos, ability_id, label and, if known, description
    and default_instruction (null when it can't be told without a call). Of several
    registrations of an id the last counts, at the place of the first; a missing label is
    the id. ``sites`` lists sites that may have registered nothing at all.
    """
    by = list(by)
    text = {c: F.col(c) if c in registered.columns else F.lit(None).cast("string") for c in ("description", "default_instruction")}
    last = F.max_by(
        F.struct(F.coalesce("label", "ability_id").alias("label"), *[value.alias(c) for c, value in text.items()]), F.col("pos")
    )
    own = registered.where(F.col("ability_id").startswith(ABILITY_PREFIX)).groupBy(*by, "ability_id").agg(
        F.min("pos").alias("pos"), last.alias("_last")
    ).select(
        *by, "pos", "ability_id", "_last.label", F.coalesce("_last.description", F.lit("")).alias("description"),
        F.coalesce("_last.default_instruction", F.lit("")).alias("default_instruction"),
        F.col("_last.default_instruction").isNotNull().alias("default_available"),
    )
    built_in = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(a).alias("ability_id"), F.lit(label).alias("label"),
                 F.lit("").alias("description"), F.lit("").alias("default_instruction"), F.lit(False).alias("default_available"))
        for i, (a, label) in enumerate(ABILITIES.items())
    ])
    every = _sites(by, registered, *([] if sites is None else [sites]))
    without = every.join(own.select(*by).distinct(), by, "left_anti") if by else every.where(F.lit(False))
    return own.unionByName(without.select(*by, F.inline(built_in)))


def policy_snapshot(policies: DataFrame, registered_types: DataFrame, sites: DataFrame | None = None,
                    by: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per site with every option, the default where nothing is stored.

    ``policies`` has the site columns, key, value (JSON text) and version;
    ``registered_types`` the site columns and post_type, which tell whether guidelines are
    available on a site. ``sites`` lists sites that may have stored nothing; those of the
    other two are always in.
    """
    by = list(by)
    values = [
        F.expr(f"max_by(value, version) FILTER (WHERE key = '{key}')").alias(key) for key in POLICY_DEFAULTS
    ]
    detected = registered_types.where(F.col("post_type").isin(*POST_TYPES)).select(
        *by, F.lit(True).alias("guidelines_detected")
    ).distinct()
    every = _sites(by, policies, registered_types, *([] if sites is None else [sites]))
    return every.join(policies.groupBy(*by).agg(*values), by, "left").join(detected, by, "left").na.fill(
        {**POLICY_DEFAULTS, "guidelines_detected": False}
    )


def policy_merge(current: DataFrame, update: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Overwrite options with the non-null ones of an update; unknown keys are ignored.

    Both sides hold one row per site and key. Options the update cannot set stay.
    """
    keys = [*by, "key"]
    settable = update.where(F.col("key").isin(*POLICY_DEFAULTS) & F.col("value").isNotNull())
    new = settable.select(*keys, F.col("value").alias("_new"))
    return current.join(new, keys, "full").select(*keys, F.coalesce("_new", "value").alias("value"))
