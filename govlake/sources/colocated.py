"""Usage state in buckets by user, so that joins and upserts move only what is new.

The rollup is a bucketed table: the rows of a user are in one bucket, whatever the month. Spend
per user, the budget gate and the upsert read the table as it lies; checks and deltas, which
are far smaller, are the only side that is shuffled to it. An upsert writes the next version of
the table beside the last one and returns it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.operators.usage import COUNTERS, USAGE_KEYS
from govlake.session import scratch_path

BUCKETS = 64


@dataclass(frozen=True)
class Colocated:
    """A version of a bucketed rollup."""

    name: str
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)


@contextmanager
def _settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    names = {name.replace("__", "."): value for name, value in wanted.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _save(usage: DataFrame, buckets: int, path: str | None) -> Colocated:
    name = f"usage_{uuid.uuid4().hex}"
    where = path or scratch_path(usage.sparkSession, "colocated")
    usage.write.bucketBy(buckets, "user_id").sortBy("user_id").option("path", where).saveAsTable(name)
    return Colocated(name, buckets)


def store(usage: DataFrame, buckets: int = BUCKETS, path: str | None = None) -> Colocated:
    """Write a rollup as a bucketed table, one file per bucket."""
    return _save(usage.repartition(buckets, "user_id"), buckets, path)


def added(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The additive upsert as a join on the rollup's keys; the delta has one row per key.

    Shaped requests leave no key null; a row that has one is kept as it is.
    """
    old, new = state.alias("old"), delta.alias("new")
    met = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in USAGE_KEYS], "full")
    zero = F.lit(0).cast("bigint")
    return met.select(
        *[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in USAGE_KEYS],
        *[(F.coalesce(f"old.{c}", zero) + F.coalesce(f"new.{c}", zero)).alias(c) for c in COUNTERS],
        F.greatest("old.updated_at", "new.updated_at").alias("updated_at"),
    )


def upsert(spark: SparkSession, table: Colocated, delta: DataFrame, path: str | None = None) -> Colocated:
    """The next version of the table with a delta added; the state is read and written in its buckets."""
    # The table is dealt by user alone, which is enough to meet on user, month, provider and model.
    # Reading buckets as partitions has to hold for the write too, so they are not merged.
    with _settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__shuffle__partitions=str(table.buckets),
                   spark__sql__adaptive__coalescePartitions__enabled="false"):
        return _save(added(table.read(spark), delta), table.buckets, path)
