"""Prompt overrides: current state, audit log, versions and the rendered prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.functions import guidelines as gl
from govlake.functions import templates as tp
from govlake.functions.text import lenient_bigint, rtrim
from govlake.operators.ordered import with_latest, with_previous
from govlake.operators.sizing import small_side, spread
from govlake.policy import EDITORIAL_ABILITIES

EDIT_COLUMNS = ("action", "mode", "template", "updated_by", "updated_at")


def prompt_current(edits: DataFrame, keys: Sequence[str] = ("ability_id",)) -> DataFrame:
    """One live override per ability: its latest edit, unless that was a delete."""
    last = F.max_by(F.struct(*EDIT_COLUMNS), F.col("edit_id")).alias("_last")
    return (
        edits.groupBy(*keys).agg(last).where("_last.action != 'delete'")
        .select(*keys, tp.known_mode(F.col("_last.mode")).alias("mode"),
                "_last.template", "_last.updated_by", "_last.updated_at")
    )


def prompt_audit(edits: DataFrame, keys: Sequence[str] = ("ability_id",), edits_per_bucket: int = 100_000) -> DataFrame:
    """The edit history as recorded: a delete carries what it removed, and a delete of
    nothing leaves no row."""
    state = F.struct(F.col("action"), tp.known_mode(F.col("mode")).alias("mode"), F.col("template"))
    seen = with_previous(edits, keys, "edit_id", state, "_before", edits_per_bucket)
    removes = F.col("action") == "delete"
    return seen.where(~removes | (F.col("_before.action") == "put")).select(
        "edit_id", *keys, "action",
        F.when(removes, F.col("_before.mode")).otherwise(tp.known_mode(F.col("mode"))).alias("mode"),
        F.when(removes, F.col("_before.template")).otherwise(F.col("template")).alias("template"),
        "updated_by", "updated_at",
    )


def prompt_history(audit: DataFrame, limit: int = 50, keys: Sequence[str] = ("ability_id",),
                   only: Column | None = None) -> DataFrame:
    """The newest entries per ability, newest first."""
    chosen = audit if only is None else audit.where(only)
    newest = Window.partitionBy(*keys).orderBy(F.col("edit_id").desc())
    return chosen.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def prompt_catalog(catalogue: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("ability_id",)) -> DataFrame:
    """Every ability of the catalogue with its override, if any, in catalogue order."""
    override = F.struct("mode", "template", "updated_by", "updated_at")
    return catalogue.join(
        small_side(overrides.select(*keys, override.alias("override"))), list(keys), "left"
    )


def prompt_lookup(wanted: DataFrame, catalogue: DataFrame, overrides: DataFrame,
                  keys: Sequence[str] = ("ability_id",)) -> DataFrame:
    """Look abilities up; ids the catalogue does not know are flagged, override or not."""
    known = catalogue.select(*keys, "label", F.lit(True).alias("_known"))
    override = overrides.select(*keys, "mode", "template")
    found = wanted.join(small_side(known), list(keys), "left").join(small_side(override), list(keys), "left")
    is_known = F.col("_known").isNotNull()
    return found.select(
        *wanted.columns, (~is_known).alias("unknown_ability"), "label",
        F.when(is_known, F.col("mode")).alias("mode"), F.when(is_known, F.col("template")).alias("template"),
    )


def prompt_asof(calls: DataFrame, edits: DataFrame, keys: Sequence[str] = ("ability_id",)) -> DataFrame:
    """Each call with the override that was live when it was made."""
    seen = with_latest(calls, edits, keys, "ts", "updated_at", "edit_id", ("action", "mode", "template"), "_live")
    live = F.col("_live.action") == "put"
    return seen.select(
        *calls.columns, F.when(live, F.col("_live.edit_id")).alias("edit_id"),
        F.when(live, tp.known_mode(F.col("_live.mode"))).alias("mode"),
        F.when(live, F.col("_live.template")).alias("template"),
    )


def render_prompts(
    calls: DataFrame,
    overrides: DataFrame,
    users: DataFrame,
    posts: DataFrame,
    guidelines: DataFrame,
    *,
    preamble: Column | None = None,
    site_name: Column | None = None,
    site_url: Column | None = None,
    extra: Column | None = None,
    abilities: Sequence[str] = EDITORIAL_ABILITIES,
    guideline_text=None,
) -> DataFrame:
    """The effective prompt of every call, with what the audit needs to know about it.

    ``calls`` has request_id, ts, site_id, user_id, ability_id, instruction and payload
    (a map of scalars as text). ``posts`` has post_id, title, type, status and block
    names, not the content; ``guidelines`` has one row per site and is empty when the
    feature is off. Order: override, then preamble, then guidelines.
    """
    empty = F.lit("")
    calls = spread(calls, "request_id").withColumn("post_id", lenient_bigint(F.try_element_at("payload", F.lit("post_id"))))
    post_side = posts.where("post_id > 0").select("post_id", "post_title", "post_type", "post_status", "blocks")
    user_side = users.select("user_id", "user_login", F.get("roles", F.lit(0)).alias("user_role"))
    parsed = overrides.select(
        "ability_id", "mode", tp.parse(F.col("template")).alias("_parsed"),
        F.contains(F.col("template"), F.lit("{guidelines")).alias("_placed"),
    ).withColumn("_asks", F.exists("_parsed.names", lambda n: n["key"].startswith("guidelines")))
    joined = (
        calls.join(small_side(parsed), "ability_id", "left")
        .join(small_side(guidelines), "site_id", "left")
        .join(user_side, "user_id", "left")
        .join(post_side, "post_id", "left")
    )

    # The section is composed only where the prompt or its template asks for it.
    placed = F.coalesce(F.col("_placed"), F.lit(False))
    listed = F.col("ability_id").isin(*abilities)
    lines = F.coalesce(gl.rule_lines(gl.relevant_rules(F.col("rules"), F.col("blocks"))), empty)
    section = gl.section(F.struct(*gl.CATEGORIES), F.col("_lines"))
    if guideline_text is not None:
        section = F.when(section != "", guideline_text(section)).otherwise(section)
    wanted = listed | placed | F.coalesce(F.col("_asks"), F.lit(False))
    prepared = joined.withColumn("_lines", F.when(wanted, lines)).withColumn(
        "_section", F.when(wanted, section).otherwise(empty)
    )

    guideline_vars = F.when(F.col("_asks"), F.create_map(
        F.lit("guidelines"), F.col("_section"), F.lit("guidelines_blocks"), F.col("_lines"),
        *[x for c in gl.CATEGORIES for x in (F.lit(f"guidelines_{c}"), F.coalesce(F.col(c), empty))],
    ))
    post_vars = F.when(F.col("post_title").isNotNull(), F.create_map(
        F.lit("post_title"), F.col("post_title"), F.lit("post_type"), F.col("post_type"),
        F.lit("post_status"), F.col("post_status"),
    ))
    built_in = F.create_map(
        F.lit("ability"), F.col("ability_id"),
        F.lit("user_login"), F.coalesce(F.col("user_login"), empty),
        F.lit("user_role"), F.coalesce(F.col("user_role"), empty),
        F.lit("site_name"), empty if site_name is None else site_name,
        F.lit("site_url"), empty if site_url is None else site_url,
        F.lit("current_date"), F.date_format("ts", "yyyy-MM-dd"),
    )
    # Bound as columns, so that no placeholder builds them again.
    has_template = F.col("_parsed").isNotNull()
    prepared = prepared.withColumns({
        "_guideline": guideline_vars, "_post": post_vars, "_built_in": F.when(has_template, built_in),
        "_entries": F.when(has_template, tp.folded_entries(F.col("payload"))),
        **({} if extra is None else {"_extra": extra}),
    })

    def lookup(key: Column) -> Column:
        known = [F.try_element_at("_guideline", key), tp.entry_value(F.col("_entries"), key),
                 F.try_element_at("_post", key), F.try_element_at("_built_in", key)]
        return F.coalesce(*([] if extra is None else [F.try_element_at("_extra", key)]), *known)

    filled = F.when(has_template, tp.fill(F.col("_parsed"), lookup))
    with_override = prepared.withColumn("_filled", filled).withColumn(
        "_prompt", tp.combine(F.col("mode"), F.col("instruction"), F.col("_filled"))
    )
    if preamble is not None:
        with_override = with_override.withColumn("_prompt", tp.with_preamble(preamble, F.col("_prompt")))

    applied = (placed | listed) & (F.col("_section") != "")
    appended = F.concat(rtrim(F.col("_prompt")), F.lit(tp.GAP), F.col("_section"))
    return with_override.select(
        "request_id", "ability_id", "site_id",
        F.when(applied & ~placed, appended).otherwise(F.col("_prompt")).alias("prompt"),
        applied.alias("guidelines_applied"),
        F.when(applied, F.col("guideline_post_id")).alias("guideline_post_id"),
        F.when(applied, F.col("guideline_revision_id")).alias("guideline_revision_id"),
    )


def guideline_audit(rendered: DataFrame) -> DataFrame:
    """Which version of which guideline each prompt was based on."""
    return rendered.where("guidelines_applied").select(
        "request_id", "ability_id", "guideline_post_id", "guideline_revision_id"
    )
