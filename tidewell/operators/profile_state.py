"""Profiles as mergeable states: one row a day, column, model version and slice, from which any longer window follows.

A state holds counts, the mean and the sum of squared deviations from it, extremes, a KLL sketch of the values and an HLL sketch of
the distinct ones. States of disjoint rows merge into the state of all of them, so a week or a month costs its days' rows and not the log's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files, tables
from .categories import split_columns
from .drift import _profiled
from .quantiles import sketch_quantiles

KEYS = ["day", "column", "model", "slice"]
#: log2 of the HLL sketch's buckets (a relative error of about 0.8 %), items a level of the KLL sketch.
HLL_LG, KLL_K = 14, 1024


def profile_states(log: DataFrame, columns: list[str], scored_at: str = "scored_at", model: str = "model_version", by: str | None = None) -> DataFrame:
    """day, column, model, slice and the state of every column's values. Columns that are no numbers have counts and the HLL sketch."""
    numeric, _ = split_columns(log, columns)
    number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    values = F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("x"), F.col(c).cast("string").alias("text")) for c in columns))
    _, *named = _profiled(log, scored_at, model, by, "1 day")
    rows = log.select(F.to_date(scored_at).alias("day"), *named, F.inline(values))
    x = F.when(~F.isnan("x"), F.col("x"))
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("text").alias("n_known"),
        F.count(x).alias("n_number"),
        F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.kll_sketch_agg_double(x, KLL_K).alias("kll"),
        F.hll_sketch_agg("text", HLL_LG).alias("hll"),
    )


def merged(states: DataFrame, by: dict[str, Column]) -> DataFrame:
    """One state for each combination of ``by`` (names and what they are), of states of disjoint rows."""
    n, whole = F.col("n_number"), Window.partitionBy(*by)  # one row a day, model and slice
    named = states.select(*(c.alias(k) for k, c in by.items()), *(c for c in states.columns if c not in KEYS and c not in by))
    # Deviations from the whole mean: those from each part's mean, and the parts' means' own.
    off = F.col("mean") - F.col("__mean")
    held = named.withColumn("__mean", F.try_divide(F.sum(F.col("mean") * n).over(whole), F.sum(n).over(whole)))
    return held.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("n_known").alias("n_known"),
        F.sum(n).alias("n_number"),
        F.max("__mean").alias("mean"),
        F.sum(F.col("m2") + n * off * off).alias("m2"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("kll", KLL_K).alias("kll"),
        F.hll_union_agg("hll").alias("hll"),
    )


def windows(states: DataFrame, window: str = "7 days") -> DataFrame:
    """States of longer windows, by window_start instead of day, for each model and slice and for all of them ('*')."""
    at = F.window(F.col("day").cast("timestamp_ntz"), window).start
    every = [states.withColumns({c: F.lit("*") for c in more}) for more in ([], ["model"], ["slice"], ["model", "slice"])]
    both = reduce(DataFrame.unionByName, every).withColumn("window_start", at)
    return merged(both, {c: F.col(c) for c in ("window_start", "column", "model", "slice")})


def read_profile(states: DataFrame, points: list[float] | None = None) -> DataFrame:
    """The states' keys, n, n_null, mean, deviation, low, high, quantiles at ``points`` and distinct; sketched ones within their error."""
    keys = [c for c in states.columns if c in ("day", "window_start", "column", "model", "slice")]
    return states.select(
        *keys,
        "n",
        (F.col("n") - F.col("n_known")).alias("n_null"),
        "mean",
        F.when(F.col("n_number") > 1, F.sqrt(F.col("m2") / (F.col("n_number") - 1))).alias("deviation"),
        "low",
        "high",
        sketch_quantiles("kll", points or [0.25, 0.5, 0.75]).alias("quantiles"),
        F.hll_sketch_estimate("hll").alias("distinct"),
    )


def refresh_profile(path: str, log: DataFrame, columns: list[str], changed: DataFrame | None = None, scored_at: str = "scored_at", model: str = "model_version", by: str | None = None) -> list[str]:
    """Bring the states stored under ``path`` up to date with ``log``; returns the days that were computed.

    ``changed`` holds the rows (or just their times) that came, or were labelled, since the last refresh: only their days are read from
    the log and only their partitions are written. Without a stored profile, or without ``changed``, all days are. Days are
    the log's partitions' size apart: their list, one entry a day, is all that comes to the driver.
    """
    spark = log.sparkSession
    if not files.exists(spark, path):
        changed = None
    at = F.to_date(scored_at)
    source = changed if changed is not None else log
    days = sorted(r[0] for r in source.select(at.alias("day")).where("day is not null").distinct().collect())
    if not days:
        return []
    rows = log if changed is None else log.where(at.isin(days))
    states = profile_states(rows.where(at.isNotNull()), columns, scored_at, model, by)
    tables.replace_partitions(states, path, "day")
    return [d.isoformat() for d in days]
