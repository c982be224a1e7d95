"""Point-in-time feature lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_in_time(events: DataFrame, features: DataFrame, keys: list[str], event_ts: str, feature_ts: str, names: list[str], stretch_seconds: int = 30 * 86_400) -> DataFrame:
    """``events`` with the features as they were known at the event: the latest with feature_ts <= event_ts.

    A key's rows are sorted in stretches of time, so that a key with very many rows is many tasks' work; the last
    version of each earlier stretch, one row a stretch, is carried into the next. No match, or a null key or time,
    gives nulls; the latest version wins, and of versions at one time the greatest.
    """
    used = set(events.columns)
    if clash := used & set(names):
        raise ValueError(f"the events have columns named {sorted(clash)}")
    at = lambda c: F.col(c).cast("timestamp")
    known = F.struct(*(F.col(n) for n in names))
    left = events.select(F.struct(*events.columns).alias("__event"), *keys, at(event_ts).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).alias("__version"))
    right = features.where(F.col(feature_ts).isNotNull()).select(F.lit(None).alias("__event"), *keys, at(feature_ts).alias("__at"), F.lit(0).alias("__kind"), known.alias("__version"))
    both = left.unionByName(right).withColumn("__stretch", F.floor(F.unix_seconds("__at") / stretch_seconds))
    group = [*keys, "__stretch"]
    newest = both.groupBy(*group).agg(F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__version"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*group, F.last("__last", ignorenulls=True).over(earlier)["__version"].alias("__carried"))
    # Rows without a key or a time match nothing, so that they can stay out of the join.
    usable = F.col("__at").isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    order = Window.partitionBy(*group).orderBy("__at", "__kind", "__version").rowsBetween(Window.unboundedPreceding, 0)
    within = both.where(usable).withColumn("__known", F.last("__version", ignorenulls=True).over(order)).where("__kind = 1")
    found = within.join(carried, group, "left").select("__event.*", F.coalesce("__known", "__carried").alias("__known"))
    rest = left.where(~usable).select("__event.*", F.lit(None).cast(found.schema["__known"].dataType).alias("__known"))
    return found.unionByName(rest).select(*events.columns, *(F.col(f"__known.{n}").alias(n) for n in names))
