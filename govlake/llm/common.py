"""What several corpus operators share: table readers, Arrow batches of bounded size, worker memory."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govlake.session import RUNTIME_CONF, scratch_path

# Rows of a batch sent to Python: with texts of 100 kB a batch is 25 MB.
BATCH_ROWS = 256
# Bytes of text worked on at once inside a Python task.
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``mapInArrow`` with batches of about ``BATCH_ROWS`` rows.

    The plan reads the number of rows when it runs, so another query may have set another; the
    bound in bytes is the same for all queries of the library and holds whatever the rows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", RUNTIME_CONF["spark.sql.execution.arrow.maxBytesPerBatch"])
    return df.mapInArrow(function, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes: small ones are put together, and one that
    is larger is cut between rows."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if held and total + part.nbytes > size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
            held.append(part)
            total += part.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """An object a Python worker builds once and keeps for its later tasks.

    The library's functions travel with the job by value, so their module globals are new
    in every task; what is kept here outlives the task, not the worker.
    """
    kept = sys.modules.setdefault("_kept_by_this_worker", types.ModuleType("_kept_by_this_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that whatever else a table holds cannot clash with working columns."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def stored(df: DataFrame, label: str) -> DataFrame:
    """A written copy in the shared folder, which cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str, few_buckets: bool = False) -> DataFrame:
    """Add the gapless rank from 0 inside each group, in the order of (bucket, order).

    Only a bucket of a group is sorted in one task; buckets are put in line by a sum over
    their counts, which is one row per group and bucket. ``few_buckets`` says that the number
    of these is fixed, so that the counts can be broadcast.
    """
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_within", F.row_number().over(within) - 1)
        .join(F.broadcast(counts) if few_buckets else counts, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint"))
        .drop("_bucket", "_within", "_before")
    )
