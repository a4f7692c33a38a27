"""Small text and number expressions with the exact trim, fold and cast rules."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set stripped by every trim.
TRIM_SET = " \t\n\r\0\x0b"

_NUMBER_PREFIX = r"^[ \t\n\r\x0B\f]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(TRIM_SET))


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(TRIM_SET))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(TRIM_SET))


def ascii_fold(text: Column) -> Column:
    """Lower-case A-Z only, so that lengths and other scripts stay as they are.

    Texts of ASCII alone take the far cheaper ``lower``, which is the same for them.
    """
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def lenient_bigint(text: Column) -> Column:
    """Number at the start of a text, truncated; anything else is 0, null stays null."""
    number = F.regexp_extract(text, _NUMBER_PREFIX, 1)
    parsed = F.coalesce(
        text.try_cast("bigint"),
        number.try_cast("double").try_cast("bigint"),
        F.when(text == "true", F.lit(1).cast("bigint")),
        F.lit(0).cast("bigint"),
    )
    return F.when(text.isNotNull(), parsed)


def feature_key(text: Column) -> Column:
    """Key form of a feature id: lower case, only letters, digits, ``_`` and ``-``."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9_-]", "")
