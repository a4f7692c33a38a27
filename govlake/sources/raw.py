"""The raw request log as JSON lines, with bodies parsed once.

A line that is no JSON object, or whose bodies are no JSON, goes to a side table with its text
and the reason; all others have their bodies as VARIANT values, so later steps read fields
without parsing again. Every line is in exactly one of the two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake import schemas
from govlake.operators.sizing import settled

_CORRUPT = "_corrupt_line"
BODIES = {"request_body": "request", "response_body": "response"}


def read_exchange(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rest) of a folder of JSON lines.

    ``parsed`` has the columns of an exchange with ``request`` and ``response`` in place of the
    body texts, null where there is no body. ``rest`` has the exchange's columns, a ``reason``
    (``line``, ``request_body`` or ``response_body``, the first that applies) and the ``line``
    where that is the reason. The lines are read and parsed once, when both tables are written.
    """
    read = spark.read.schema(f"{schemas.EXCHANGE}, {_CORRUPT} STRING").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    whole = read.withColumns({name: F.try_parse_json(body) for body, name in BODIES.items()})
    reason = F.when(F.col(_CORRUPT).isNotNull(), "line")
    for body, name in BODIES.items():
        reason = reason.when(F.col(body).isNotNull() & F.col(name).isNull(), body)
    marked = settled(whole.withColumn("reason", reason), "raw-exchange")
    kept = [c for c in marked.columns if c not in (*BODIES, *BODIES.values(), _CORRUPT, "reason")]
    parsed = marked.where("reason IS NULL").select(*kept, *BODIES.values())
    rest = marked.where("reason IS NOT NULL").select(*kept, *BODIES, "reason", F.col(_CORRUPT).alias("line"))
    return parsed, rest


def texts(rest: DataFrame) -> DataFrame:
    """The exchanges of the side table whose line can be read; rules for texts apply to their bodies."""
    return rest.where("reason != 'line'").drop("reason", "line")
