"""Running totals along a numeric order without one task for everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import sketch_quantiles, sketched

def place_among(df: DataFrame, value: Column, sorted_: str, most: int, name: str) -> DataFrame:
    """``df`` with how many elements of the array ``sorted_`` (at most ``most``, in order) lie below ``value``: 0 if it is null.

    A binary search, each step of it a plain expression, since an array's higher-order functions are interpreted for every element.
    """
    out = df.withColumn(name, F.lit(0))
    step = 1 << max(most - 1, 0).bit_length()
    while step:
        out = out.withColumn(name, F.col(name) + F.when(F.get(sorted_, F.col(name) + F.lit(step - 1)) < value, step).otherwise(0))
        step //= 2
    return out


def cut_points(df: DataFrame, group: list[str], order: str, blocks: int = 256) -> DataFrame:
    """group.., __cuts: sketched quantiles of ``order`` that cut each group into blocks of near equal row counts, however its values are spread.

    Computed at once, since a sketch's draws differ from run to run and blocks are joined with each other. One row of at most
    ``blocks`` numbers a group comes to the driver, so groups are things like columns and days.
    """
    cuts = sketched(df, group, order, k=2048).select(*group, sketch_quantiles("sketch", [i / blocks for i in range(1, blocks)]).alias("__cuts"))
    return df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def blocked(df: DataFrame, group: list[str], order: str, blocks: int = 256, name: str = "__block", cuts: DataFrame | None = None) -> DataFrame:
    """``df`` with the block of each row by ``cuts``, or its own ``cut_points``."""
    cuts = cut_points(df, group, order, blocks) if cuts is None else cuts
    return place_among(df.join(F.broadcast(cuts), group, "left"), F.col(order).cast("double"), "__cuts", blocks, name).drop("__cuts")  # one row a group


def cumulative(df: DataFrame, group: list[str], order: str, values: list[str], blocks: int = 256, cuts: DataFrame | None = None) -> DataFrame:
    """``df`` with cum_<value> (inclusive) and next_<order>, by group along ``order``, which must be distinct there and not null.

    Blocks of near equal counts along ``order`` are totalled first; their sums precede the running sums inside. ``cuts`` may come from
    other rows with these values, which are cheaper to read.
    """
    if not group:
        return cumulative(df.withColumn("__all", F.lit(0)), ["__all"], order, values, blocks).drop("__all")
    placed = blocked(df, group, order, blocks, cuts=cuts)
    before, after = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group).orderBy("__block")
    sums = placed.groupBy(*group, "__block").agg(*(F.sum(v).alias(f"__sum_{v}") for v in values), F.min(order).alias("__first"))
    sums = sums.select(*group, "__block", F.lead("__first").over(after).alias("__then"), *(F.coalesce(F.sum(f"__sum_{v}").over(before), F.lit(0)).alias(f"__sum_{v}") for v in values))
    inside = Window.partitionBy(*group, "__block").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(sums, [*group, "__block"])
    return out.select(*df.columns, *((F.col(f"__sum_{v}") + F.sum(v).over(upto)).alias(f"cum_{v}") for v in values), F.coalesce(F.lead(order).over(inside), "__then").alias(f"next_{order}"))
