"""Folders of whatever store the session's tables are in, by the Hadoop file system behind it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _at(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it does not exist."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, there or not there and never in part."""
    store, where = _at(spark, path)
    store.create(where, True).close()
