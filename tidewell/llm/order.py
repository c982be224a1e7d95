"""Gapless positions along an order, from sorted runs that are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def positions(rows: DataFrame, key: str, order: list[str], at: str = "pos") -> DataFrame:
    """``rows`` with ``at`` (long): the place of each row among those of its ``key`` along ``order``, from 0, nulls first.

    Rows are dealt by ranges of key and order and written as sorted runs, so a key with a third of all rows is
    many tasks' work; after that only counts, one a run and key, are added up. ``rows`` should read a
    written table, since the ranges come from a sample of it. Keys must not be null; full ties keep the order they
    are written in. Uses the names __place, __part, __first and __before.
    """
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order)]
    runs = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("__part", F.shiftright("__place", 33))
    counts = runs.groupBy("__part", key).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", key, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return runs.join(starts, ["__part", key]).select(*rows.columns, (F.col("__place") - F.col("__first") + F.col("__before")).alias(at))
