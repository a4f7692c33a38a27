"""Stateless rules on streams: the same Columns as in batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions import outputs, pii
from govlake.operators import moderate
from govlake.policy import PII_PATTERNS


def stream_redact(texts: DataFrame, column: str, patterns: Mapping[str, str] = PII_PATTERNS) -> DataFrame:
    return texts.withColumn(column, pii.redact(F.col(column), patterns))


def stream_moderate(answers: DataFrame, body: str, phrases: Sequence[str]) -> DataFrame:
    """Verdict and replacement response per answer body."""
    return moderate.moderate(answers, outputs.output_text(F.col(body)), phrases)
