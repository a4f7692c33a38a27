"""Content blocks in post markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Form of an opening block delimiter and the default namespace.
BLOCK_OPENING = (
    r"(?s)<!--\s+wp:((?:[a-z][a-z0-9_-]*/)?[a-z][a-z0-9_-]*)\s+(?:\{(?:(?!\}\s+/?-->).)*+\}\s+)?/?-->"
)
BLOCK_MARK = "<!-- wp:"
DEFAULT_NAMESPACE = "core/"


def block_names(content: Column) -> Column:
    """Distinct block types at any depth, in order of appearance; null when there is none."""
    raw = F.regexp_extract_all(content, F.lit(BLOCK_OPENING), F.lit(1))
    full = F.transform(raw, lambda n: F.when(n.contains("/"), n).otherwise(F.concat(F.lit(DEFAULT_NAMESPACE), n)))
    names = F.array_distinct(full)
    return F.when(content.contains(BLOCK_MARK) & (F.size(names) > 0), names)


def block_of_meta_key(meta_key: Column, prefix: str) -> Column:
    """``<prefix>core_paragraph`` gives ``core/paragraph``."""
    rest = F.substring(meta_key, F.lit(len(prefix) + 1), F.length(meta_key))
    return F.regexp_replace(rest, r"(?s)^([^_]*)_(.*)$", "$1/$2")
