"""Prompt templates: variables and the combination with the default instruction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from govlake.functions.text import ascii_fold, ltrim, rtrim

# Placeholder form, override modes, separator between prompt parts.
PLACEHOLDER = r"\{([A-Za-z0-9_.]+)\}"
MODES = ("prepend", "append", "replace")
GAP = "\n\n"


def known_mode(mode: Column) -> Column:
    """Unknown modes count as ``prepend``."""
    return F.when(mode.isin(*MODES), mode).otherwise(F.lit(MODES[0]))


def parse(template: Column) -> Column:
    """Struct (literals, names) of a template: the text around its placeholders, and the
    placeholders as struct (key, written). Parse once per template, fill once per call."""
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    return F.struct(
        F.split(template, PLACEHOLDER, -1).alias("literals"),
        F.transform(names, lambda n: F.struct(
            ascii_fold(n).alias("key"), F.concat(F.lit("{"), n, F.lit("}")).alias("written"))).alias("names"),
    )


def folded_entries(payload: Column) -> Column:
    """Entries of a payload map with lower-cased keys, for lookups that ignore case."""
    return F.transform(
        F.map_entries(payload), lambda e: F.struct(ascii_fold(e["key"]).alias("key"), e["value"].alias("value"))
    )


def entry_value(entries: Column, key: Column) -> Column:
    """Value of a key among entries; the last one wins."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def fill(parsed: Column, lookup: Callable[[Column], Column]) -> Column:
    """Fill a parsed template with ``lookup(key)``.

    One pass: filled-in text is not scanned again, unknown names stay as written.
    """
    literals = parsed["literals"]
    following = F.slice(literals, F.lit(2), F.size(literals))
    pieces = F.zip_with(
        parsed["names"], following, lambda n, rest: F.concat(F.coalesce(lookup(n["key"]), n["written"]), rest)
    )
    return F.concat(F.get(literals, F.lit(0)), F.array_join(pieces, ""))


def combine(mode: Column, instruction: Column, filled: Column) -> Column:
    """Place a filled template around (or instead of) the default instruction."""
    return (
        F.when(filled.isNull(), instruction)
        .when(mode == "replace", filled)
        .when(mode == "append", F.concat(rtrim(instruction), F.lit(GAP), filled))
        .otherwise(F.concat(filled, F.lit(GAP), ltrim(instruction)))
    )


def with_preamble(preamble: Column, instruction: Column) -> Column:
    return F.when(
        F.coalesce(preamble, F.lit("")) != "", F.concat(preamble, F.lit(GAP), instruction)
    ).otherwise(instruction)
