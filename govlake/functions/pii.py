"""Redaction of personal data as a chain of built-in regular-expression replacements."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from govlake.policy import PII_PATTERNS

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_LOCAL = "[A-Za-z0-9._%+-]"

# Cheap tests that must hold before the default patterns can match at all.
_PRETESTS = {
    PII_PATTERNS["email"]: lambda text: text.contains("@"),
    PII_PATTERNS["ssn"]: lambda text: text.rlike(r"[0-9]{4}"),
    PII_PATTERNS["phone"]: lambda text: text.rlike(r"[0-9]{4}"),
}


def java_pattern(pattern: str) -> str:
    """The same pattern for the JVM: word edges are ASCII, runs are not rescanned.

    The JVM's own word edge knows all scripts and misses matches next to accented
    letters. For the e-mail pattern the match is anchored at the start of a run (or
    right behind the previous match), which keeps long runs without ``@`` linear.
    """
    if pattern == PII_PATTERNS["email"]:
        rest = pattern[len(_LOCAL) + 1:]
        return rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{rest}"
    return pattern.replace(r"\b", _EDGE)


def check_patterns(spark: SparkSession, patterns: Mapping[str, str]) -> None:
    """Fail before the job starts when a configured pattern does not compile."""
    probe = [F.regexp_replace(F.lit("x"), java_pattern(p), "").alias(f"p{i}") for i, p in enumerate(patterns.values())]
    if probe:
        spark.range(1).select(*probe).collect()


def redact(text: Column, patterns: Mapping[str, str] = PII_PATTERNS) -> Column:
    """Replace every match by ``[REDACTED:label]``, pattern after pattern."""
    for label, pattern in patterns.items():
        text = _replace(text, label, pattern)
    return text


def hits(text: Column, patterns: Mapping[str, str] = PII_PATTERNS) -> dict[str, Column]:
    """Matches per label, each counted in the text as the earlier labels left it."""
    counts = {}
    for label, pattern in patterns.items():
        found = F.size(F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)))
        test = _PRETESTS.get(pattern)
        zero = F.lit(0)
        counts[label] = F.when(test(text), found).otherwise(zero) if test else found
        text = _replace(text, label, pattern)
    return counts


def _replace(text: Column, label: str, pattern: str) -> Column:
    mark = f"[REDACTED:{label}]".replace("\\", "\\\\").replace("$", "\\$")
    replaced = F.regexp_replace(text, java_pattern(pattern), mark)
    test = _PRETESTS.get(pattern)
    return F.when(test(text), replaced).otherwise(text) if test else replaced
