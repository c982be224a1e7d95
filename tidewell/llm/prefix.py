"""Running sums over groups of any size: block totals first, then a short window in each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(hashed: Column, blocks: int) -> Column:
    """Blocks that follow the order of a non-negative 63-bit hash."""
    return F.least(F.lit(blocks - 1), F.floor(hashed / F.lit(float(2**63)) * blocks).cast("long"))


def running_sum(df: DataFrame, group: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group that come before.

    ``block`` must follow ``order``; its number of values sets how far a group is spread, so no task holds
    more than one block of a group. Rows equal in all of ``order`` may swap places.
    """
    offset = out + "__offset"
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(F.sum(value).alias("__total"))
    totals = totals.select(*group, block, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, [*group, block])
        .withColumn(out, (F.col(offset) + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop(offset)
    )
