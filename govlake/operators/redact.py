"""Redaction over document tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import pii
from govlake.policy import PII_PATTERNS


def redact_column(df: DataFrame, column: str, patterns: Mapping[str, str] = PII_PATTERNS,
                  enabled: bool = True) -> DataFrame:
    """Redact one text column; switched off it passes through."""
    if not enabled:
        return df
    if dict(patterns) != PII_PATTERNS:
        pii.check_patterns(df.sparkSession, patterns)
    return df.withColumn(column, pii.redact(F.col(column), patterns))


def pii_report(df: DataFrame, column: str, by: Sequence[str], patterns: Mapping[str, str] = PII_PATTERNS) -> DataFrame:
    """Documents and matches per label, grouped."""
    counts = pii.hits(F.col(column), patterns)
    counted = df.select(*by, *[c.alias(label) for label, c in counts.items()])
    any_hit = sum((F.col(label) for label in counts), F.lit(0)) > 0
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(any_hit).alias("documents_hit"),
        *[F.sum(label).cast("bigint").alias(f"{label}_hits") for label in counts],
    )
