"""The few file-system questions jobs ask, through the session's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_file(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.getFileStatus(where).isFile()


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the entries ``<prefix>n`` of a folder, ascending."""
    system, where = _at(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if there is no folder."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []
