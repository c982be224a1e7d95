"""Changes of stored tables that survive a loss midway, with a feed of what each of them changed.

Beside a table lies ``<path>.commits`` with one folder a version. A commit stages the new partitions and the change
set there, marks itself ready, overwrites the table's partitions from what it staged, and marks itself done. A commit that was
ready is carried out again by whoever comes next, one that was not is forgotten: the table is never without its rows, neither
version is ever lost, and half-written partitions don't outlast the next ``recover``. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

CHANGE, VERSION = "_change_type", "_version"
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"


def change_set(before: DataFrame, after: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The rows that differ: after's columns, the kind of change and the version. Keys are unique on each side; nulls equal nulls.

    A row that stays the same gives none, a changed one its old and its new form. Columns that only ``before`` has are left out,
    those that only ``after`` has were null before.
    """
    columns = after.columns
    kinds = dict(after.dtypes)
    have = {c.lower(): c for c in before.columns}
    old_form = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(kinds[c]).alias(c) for c in columns]
    old = before.select(F.struct(*old_form).alias("old"), F.lit(True).alias("was"))
    new = after.select(F.struct(*columns).alias("new"), F.lit(True).alias("is"))
    same = lambda c: F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    both = old.join(new, reduce(Column.__and__, map(same, keys)), "full_outer")
    rest = [c for c in columns if c not in keys]
    changed = ~reduce(Column.__and__, map(same, rest), F.lit(True))
    row = lambda side, kind: F.struct(F.col(side).alias("row"), F.lit(kind).alias("kind"))
    rows = F.when(F.col("was").isNull(), F.array(row("new", INSERT))).when(F.col("is").isNull(), F.array(row("old", DELETE))).when(changed, F.array(row("old", BEFORE), row("new", AFTER)))
    return both.select(F.explode(rows).alias("x")).select("x.row.*", F.col("x.kind").alias(CHANGE), F.lit(version).cast("long").alias(VERSION))


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}.commits"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that the table has gone through."""
    return [int(v) for v in files.children(spark, _folder(path)) if files.exists(spark, f"{_folder(path)}/{v}/done")]


def _apply(spark: SparkSession, path: str, at: str, partition: str | None) -> None:
    rows = spark.read.parquet(f"{at}/rows")
    whole = files.exists(spark, f"{at}/whole")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    files.mark(spark, f"{at}/done")
    files.delete(spark, f"{at}/rows")


def recover(spark: SparkSession, path: str, partition: str | None) -> list[int]:
    """Carry out commits that were ready and not done, forget those that were not ready; the versions that were carried out."""
    carried = []
    for v in files.children(spark, _folder(path)):
        at = f"{_folder(path)}/{v}"
        if files.exists(spark, f"{at}/done"):
            if files.exists(spark, f"{at}/rows"):
                files.delete(spark, f"{at}/rows")
        elif files.exists(spark, f"{at}/ready"):
            _apply(spark, path, at, partition)
            carried.append(int(v))
        else:
            files.delete(spark, at)
    return carried


def stage(rows: DataFrame, path: str, partition: str | None, keys: list[str] | None = None, whole: bool = False) -> str:
    """The first half of a commit: rows and change set are written and marked ready. ``finish`` does the rest."""
    spark = rows.sparkSession
    recover(spark, path, partition)
    version = max([0, *versions(spark, path)]) + 1
    at = f"{_folder(path)}/{version:08d}"
    rows.write.parquet(f"{at}/rows")
    if whole:
        files.mark(spark, f"{at}/whole")
    if keys:
        after = spark.read.parquet(f"{at}/rows")
        before = after.limit(0)
        if any(n[0] not in "._" for n in files.children(spark, path)):
            before = spark.read.parquet(path)
            if partition and not whole:
                before = before.join(after.select(partition).distinct(), partition, "left_semi")
        change_set(before, after, keys, version).write.parquet(f"{at}/changes")
    files.mark(spark, f"{at}/ready")
    return at


def finish(spark: SparkSession, path: str, at: str, partition: str | None) -> None:
    _apply(spark, path, at, partition)


def commit(rows: DataFrame, path: str, partition: str | None, keys: list[str] | None = None, whole: bool = False) -> int:
    """Put ``rows`` in place of the table's partitions that they have rows for (or of the ``whole`` table); the version it becomes.

    ``rows`` may be made from the table itself. With ``keys`` the version's change set is kept for ``read_changes``.
    """
    at = stage(rows, path, partition, keys, whole)
    finish(rows.sparkSession, path, at, partition)
    return int(at.rsplit("/", 1)[1])


def read_changes(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """The change sets of the versions from ``first`` to ``last``, as one table; columns that a version lacks are null."""
    chosen = [v for v in versions(spark, path) if v >= first and (last is None or v <= last)]
    found = [p for v in chosen if files.exists(spark, p := f"{_folder(path)}/{v:08d}/changes")]
    if not found:
        raise ValueError(f"{path} has no change sets of the versions asked for")
    return spark.read.option("mergeSchema", True).parquet(*found)


def replay(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that the changes lead to from an empty one: of each key the newest form, if that is no deletion."""
    columns = [c for c in changes.columns if c not in (CHANGE, VERSION)]
    newest = changes.where(F.col(CHANGE) != BEFORE).groupBy(*keys).agg(F.max_by(F.struct(CHANGE, *columns), VERSION).alias("x"))
    return newest.where(F.col(f"x.{CHANGE}") != DELETE).select(*(F.col(f"x.{c}").alias(c) for c in columns))
