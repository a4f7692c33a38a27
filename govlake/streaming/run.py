"""Start a streaming query into a table below the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from govlake.session import scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings for queries with keyed state that are started inside: RocksDB, and one state
    partition per core unless told otherwise (their number is fixed by the first start)."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the stream to a parquet table; processes what is there unless told otherwise."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand every micro-batch to ``write(batch, batch_id)``, which must be repeatable."""
    return (
        stream.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Process what the source holds now and return the written table."""
    root = scratch_path(spark, label)
    to_table(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
