"""Guideline posts: the current one, its categories, block rules and revision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import guidelines as gl
from govlake.functions.blocks import block_names, block_of_meta_key
from govlake.functions.text import trim
from govlake.operators.sizing import small_side


def guideline_current(posts: DataFrame, registered_types: Sequence[str], statuses: Sequence[str] = ("publish", "draft"),
                      tagged_types: Sequence[str] = gl.POST_TYPES[:1], by: Sequence[str] = ("site_id",)) -> DataFrame:
    """The guideline post in force, per site (or overall when ``by`` is empty).

    Only the first registered post type counts, even when it has no post. Types that
    carry the type taxonomy need the ``content`` term.
    """
    post_type = next((t for t in gl.POST_TYPES if t in registered_types), None)
    live = posts.where((F.col("post_type") == post_type) & F.col("post_status").isin(*statuses))
    if post_type is None:
        live = posts.where(F.lit(False))
    elif post_type in tagged_types:
        live = live.where(F.array_contains("terms", gl.CONTENT_TERM))
    newest = F.max_by(F.struct("post_id", "post_type", "post_status", "post_date"),
                      F.struct("post_date", "post_id"))
    return live.groupBy(*by).agg(newest.alias("_post")).where("_post is not null").select(*by, "_post.*")


def _first_values(current: DataFrame, meta: DataFrame, by: Sequence[str]) -> DataFrame:
    """First value per meta key of the current guideline posts, trimmed."""
    posts = current.select(*by, "post_id")
    firsts = meta.join(small_side(posts), "post_id").groupBy(*by, "post_id", "meta_key").agg(
        F.min_by("meta_value", "meta_id").alias("_value"), F.min("meta_id").alias("meta_id")
    )
    return firsts.withColumn("value", F.coalesce(trim(F.col("_value")), F.lit(""))).drop("_value")


def guideline_categories(current: DataFrame, meta: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per current guideline post with its four category texts ('' when absent)."""
    wanted = meta.where(F.col("meta_key").isin(*[gl.META_PREFIX + c for c in gl.CATEGORIES]))
    firsts = _first_values(current, wanted, by)
    texts = firsts.groupBy("post_id").agg(*[
        F.coalesce(F.max(F.when(F.col("meta_key") == gl.META_PREFIX + c, F.col("value"))), F.lit("")).alias(c)
        for c in gl.CATEGORIES
    ])
    empty = {c: "" for c in gl.CATEGORIES}
    return current.select(*by, "post_id").join(texts, "post_id", "left").na.fill(empty).select(
        *by, "post_id", *gl.CATEGORIES
    )


def guideline_block_rules(current: DataFrame, meta: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Non-empty block rules of the current guideline posts; ``pos`` keeps their order."""
    wanted = meta.where(F.col("meta_key").startswith(gl.BLOCK_META_PREFIX))
    rules = _first_values(current, wanted, by).where("value != ''").withColumn(
        "name", block_of_meta_key(F.col("meta_key"), gl.BLOCK_META_PREFIX)
    )
    return rules.groupBy(*by, "post_id", "name").agg(
        F.min("meta_id").alias("pos"), F.max_by("value", "meta_id").alias("rule")
    )


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Newest revision per post."""
    newest = F.max_by("revision_id", F.struct("post_modified", "revision_id"))
    return revisions.groupBy("post_id").agg(newest.alias("guideline_revision_id"))


def guideline_dim(current: DataFrame, meta: DataFrame, revisions: DataFrame, enabled: bool = True,
                  by: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per site: category texts, ordered rules, post and revision id."""
    if not enabled:
        current = current.where(F.lit(False))
    keys = [*by, "post_id"]
    is_rule = F.col("meta_key").startswith(gl.BLOCK_META_PREFIX)
    wanted = meta.where(is_rule | F.col("meta_key").isin(*[gl.META_PREFIX + c for c in gl.CATEGORIES]))
    name = F.when(is_rule, block_of_meta_key(F.col("meta_key"), gl.BLOCK_META_PREFIX))
    named = _first_values(current, wanted, by).withColumn("name", name).where("name is null or value != ''")
    # Two meta keys can name the same block: the first gives the place, the last the text.
    entries = named.groupBy(*keys, "name", F.when(F.col("name").isNull(), F.col("meta_key")).alias("category")).agg(
        F.min("meta_id").alias("pos"), F.max_by("value", "meta_id").alias("value")
    )
    rule = F.when(F.col("name").isNotNull(), F.struct("pos", "name", F.col("value").alias("rule")))
    packed = entries.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(rule)),
            lambda r: F.struct(r["name"].alias("name"), r["rule"].alias("rule")),
        ).alias("rules"),
        *[F.max(F.when(F.col("category") == gl.META_PREFIX + c, F.col("value"))).alias(c) for c in gl.CATEGORIES],
    )
    revised = latest_revision(revisions.join(small_side(current.select("post_id")), "post_id", "left_semi"))
    return (
        current.select(keys).join(packed, keys, "left").join(revised, "post_id", "left")
        .select(*by, F.col("post_id").alias("guideline_post_id"),
                F.coalesce("guideline_revision_id", F.lit(0).cast("bigint")).alias("guideline_revision_id"),
                *[F.coalesce(c, F.lit("")).alias(c) for c in gl.CATEGORIES],
                F.coalesce("rules", F.array().cast("array<struct<name:string,rule:string>>")).alias("rules"))
    )


def guideline_sections(dim: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """The section as composed without a post at hand, for sites where it says something."""
    lines = gl.rule_lines(F.col("rules"))
    return dim.select(
        *by, "guideline_post_id", gl.section(F.struct(*gl.CATEGORIES), lines).alias("section")
    ).where("section != ''")


def post_blocks(posts: DataFrame) -> DataFrame:
    """Posts with their block names (null when there is none) and without the content."""
    return posts.withColumn("blocks", block_names(F.col("post_content"))).drop("post_content")


def relevant_block_rules(posts: DataFrame, rules: DataFrame, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Rules that apply to each post: those of its blocks, or all when it has none known."""
    scoped = rules.select(*by, "name", "pos", "rule")
    known = posts.where("blocks is not null").select(*by, F.col("post_id"), F.explode("blocks").alias("name"))
    unknown = posts.where("blocks is null").select(*by, F.col("post_id"))
    by_name = known.join(small_side(scoped), [*by, "name"]).select(*by, "post_id", "name", "pos", "rule")
    if not by:
        raise ValueError("relevant_block_rules needs the site columns to join on")
    all_rules = unknown.join(small_side(scoped), list(by)).select(*by, "post_id", "name", "pos", "rule")
    return by_name.unionByName(all_rules)
