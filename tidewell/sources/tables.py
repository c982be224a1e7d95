"""Reading and writing tables: overwrite, append with new columns, keyed upsert, schema sync, versions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits, files


_local: dict[str, str] = {}


def read_table(spark: SparkSession, name: str, merge_schema: bool = False) -> DataFrame:
    """A Parquet path, or a table of the session's catalog."""
    if "/" in name:
        return spark.read.option("mergeSchema", merge_schema).parquet(name)
    return spark.table(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a single-machine session without one gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewell-"))
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the table, schema and all. The path must not be one that ``df`` reads."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows; columns may be new, ``read_table(..., merge_schema=True)`` gives nulls for them before."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A numbered snapshot, stamped with its number; the path can be recorded with what is made from it."""
    path = f"{root}/version={version}"
    df.withColumn("snapshot_version", F.lit(version)).write.mode("errorifexists").parquet(path)
    return path


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with the same keys.

    Columns that only one side has are null for the other. A key that ``source`` has twice would make the
    result depend on chance; ``duplicate_keys`` finds those.
    """
    return source.unionByName(target.join(source.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite those partitions that ``df`` has rows for, which must not be read from them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_batch(df: DataFrame, path: str, batch: str, column: str = "batch_id") -> None:
    """Add a batch to a log, once: the batch is a partition of its own, which a second run of it overwrites.

    Columns may be new, as with ``append``. A batch without rows leaves the log as it is.
    """
    replace_partitions(df.withColumn(column, F.lit(batch)), path, column)


def batch_sink(path: str, name: str, column: str = "batch_id") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: every micro-batch goes to the log once, however often it is tried."""
    return lambda df, number: append_batch(df, path, f"{name}-{number}", column)


def upsert_partitions(spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition: str, staging: str | None = None) -> int:
    """Upsert into a partitioned table, rewriting only the partitions that ``source`` touches; the version it becomes.

    ``source`` is used twice: with ``staging`` it is written there first, otherwise it should read a written table.
    """
    if staging:
        source.write.mode("overwrite").parquet(staging)
        source = spark.read.schema(source.schema).parquet(staging)
    touched = spark.read.parquet(path).join(source.select(partition).distinct(), partition, "left_semi")
    return commits.commit(upsert(touched, source, keys), path, partition, keys)


def publish_upsert(spark: SparkSession, path: str, source: DataFrame, wanted: T.StructType, keys: list[str], partition: str) -> int:
    """Upsert into a table that may not exist yet or have other columns than ``wanted``; the version it becomes.

    Only the partitions that ``source`` touches are rewritten, unless the columns change: then all are. Either way the new rows
    are staged first, so that a loss midway is mended by the next publication (or ``commits.recover``), and the
    change set is kept. ``source`` should read a written table, as it is used twice.
    """
    source = sync_schema(source, wanted, keys)
    commits.recover(spark, path, partition)
    if not any(n[0] not in "._" for n in files.children(spark, path)):  # no table yet, or one without rows
        return commits.commit(source, path, partition, keys, whole=True)
    have = spark.read.parquet(path)
    columns = lambda fields: {(f.name.lower(), f.dataType.simpleString()) for f in fields if f.name.lower() != partition.lower()}
    if columns(have.schema) != columns(wanted):
        return commits.commit(upsert(sync_schema(have, wanted, keys), source, keys), path, partition, keys, whole=True)
    return upsert_partitions(spark, path, source, keys, partition)


def sync_schema(df: DataFrame, wanted: T.StructType, keys: list[str]) -> DataFrame:
    """``df`` with the wanted columns in order: new ones null, dropped ones gone, keys always kept.

    Names are compared without case, as the catalog does.
    """
    have = {c.lower(): c for c in df.columns}
    names = {f.name.lower() for f in wanted}
    kept = [F.col(have[k.lower()]).alias(k) for k in keys if k.lower() in have and k.lower() not in names]
    columns = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*kept, *columns)


def audit_row(spark: SparkSession, fields: dict[str, str], metrics: dict[str, float], recorded_at: str) -> DataFrame:
    """One audit row: text columns, and metrics as one JSON column so that the schema never changes."""
    row = spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in sorted(fields.items())))
    packed = F.to_json(F.struct(*(F.lit(float(v)).alias(k) for k, v in sorted(metrics.items())))) if metrics else F.lit("{}")
    return row.withColumns({"evaluation_summary": packed, "recorded_at": F.lit(recorded_at).cast("timestamp")})


def latest(df: DataFrame, by: str | Column, n: int, *ties: str) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(F.desc(by) if isinstance(by, str) else by.desc(), *ties).limit(n)


def preview(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by keys."""
    return df.orderBy(*keys).limit(n)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
