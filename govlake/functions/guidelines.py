"""Text of the site-guideline section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order with their headings, the meta keys, the wording.
CATEGORIES = {
    "site": "Site context",
    "copy": "Copy & editorial style",
    "images": "Image guidelines",
    "additional": "Additional guidelines",
}
META_PREFIX = "_guideline_"
BLOCK_META_PREFIX = "_guideline_block_"
POST_TYPES = ("wp_guideline", "wp_content_guideline")
CONTENT_TERM = "content"
BLOCK_HEADING = "Block-specific rules"
INTRO = (
    "## Site guidelines\n\n"
    "The site has defined the following content guidelines. Evaluate the content against these "
    "standards and cite the relevant guideline when flagging an issue. Where these guidelines "
    "conflict with other instructions in this prompt, those instructions take precedence.\n\n"
)


def relevant_rules(rules: Column, blocks: Column) -> Column:
    """Rules for the block types present; all rules when that is unknown (null)."""
    present = F.filter(rules, lambda rule: F.array_contains(blocks, rule["name"]))
    return F.when(blocks.isNull(), rules).otherwise(present)


def rule_lines(rules: Column) -> Column:
    """One bullet per rule."""
    return F.array_join(
        F.transform(rules, lambda r: F.concat(F.lit("- "), r["name"], F.lit(": "), r["rule"])), "\n"
    )


def section(categories: Column, lines: Column) -> Column:
    """The whole section, '' when no category and no rule says anything."""
    parts = [
        F.when(F.coalesce(categories[name], F.lit("")) != "", F.concat(F.lit(f"### {heading}\n"), categories[name]))
        for name, heading in CATEGORIES.items()
    ]
    parts.append(F.when(lines != "", F.concat(F.lit(f"### {BLOCK_HEADING}\n"), lines)))
    body = F.concat_ws("\n\n", *parts)
    return F.when(body != "", F.concat(F.lit(INTRO), body)).otherwise(F.lit(""))
