"""Readers: any Spark source, always with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from govlake import schemas
from govlake.sources import files


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Batch read with a declared schema."""
    return _instants(spark.read.format(fmt).schema(schema).options(**options).load(path))


def stream_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Streaming read of a folder (or any streaming source) with a declared schema."""
    return _instants(spark.readStream.format(fmt).schema(schema).options(**options).load(path))


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small policy table from driver values, whose size the optimizer knows."""
    parsed = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(parsed.fields)
    table = pa.table(
        {f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(parsed.fields, columns)}
    )
    return spark.createDataFrame(table, schema=parsed)


def sample_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", schemas.SAMPLE_TABLES[name])


def sample_stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A sample table as a stream of files, be it stored as one file or as a folder."""
    path = f"{sf_dir}/{name}.parquet"
    if files.is_file(spark, path):
        path, options = sf_dir, {"pathGlobFilter": f"{name}.parquet", **options}
    return stream_table(spark, path, schemas.SAMPLE_TABLES[name], **options)


def _instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps are UTC; only instants can carry a watermark."""
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
