"""Quantiles of any number of values: mergeable sketches, and exact ones by narrowing down what the sketches bracket."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items a level of a KLL sketch keeps, and the share of ranks by which it errs (at 99 % certainty) for that size.
KLL_K = 4096


def rank_error(k: int = KLL_K) -> float:
    return 2.296 / k**0.9021


def sketched(values: DataFrame, by: list[str], value: str = "value", k: int = KLL_K, parts: int = 64) -> DataFrame:
    """by.., sketch: one KLL sketch a group, without nulls and NaN.

    Sketches of input tasks merge in ``parts`` parts first, so no task gets those of all tasks at once.
    """
    real = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    part = values.groupBy(*by, F.pmod(F.spark_partition_id(), F.lit(parts)).alias("__part")).agg(F.kll_sketch_agg_double(real, k).alias("sketch"))
    return part.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketch: Column | str, points: list[float]) -> Column:
    """The sketch's values at the points, in an array; null without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, points))))


def _merged(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


_BINS = 256


def _picked(values: DataFrame, spans: dict[str, list[tuple[float, float]]], targets: dict[str, list[int]]) -> list:
    """feature, at (the target's place), value, sure: the value at each rank, if it lies in one of the spans."""
    from .running import place_among

    spark = values.sparkSession
    rows = [(f, [s[0] for s in spans[f]], [s[1] for s in spans[f]], targets[f]) for f in spans]
    known = spark.createDataFrame(rows, "feature string, lows array<double>, highs array<double>, targets array<bigint>")
    v = F.col("value")
    placed = place_among(values.where(~F.isnan("value")).join(F.broadcast(known.drop("targets")), "feature"), v, "highs", max(map(len, spans.values())), "span")
    low, high = F.get("lows", F.col("span")), F.get("highs", F.col("span"))
    inside = F.coalesce(low <= v, F.lit(False))
    # What lies outside all spans counts with the next one's lower end (or beyond all of them). Spans are narrow, so bins of equal
    # width are even enough to be sorted each by itself.
    bin_ = F.coalesce(F.least(F.lit(_BINS), F.floor(F.try_divide(v - low, high - low) * _BINS)).cast("int"), F.lit(0))
    coarse = placed.select("feature", "span", F.when(inside, bin_).otherwise(0).alias("bin"), F.when(inside, v).otherwise(F.coalesce(low, F.lit(float("inf")))).alias("value"), inside.alias("own"))
    steps = coarse.groupBy("feature", "span", "bin", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own"))
    bins = steps.groupBy("feature", "span", "bin").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("feature").orderBy("span", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("feature", "span", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("feature", "span", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    sums = steps.withColumn("upto", upto).join(F.broadcast(bins), ["feature", "span", "bin"]).withColumn("cum_n", F.col("before") + F.col("upto"))  # at most 257 rows a feature and point
    hits = F.filter(F.transform("targets", lambda t, i: F.struct(t.alias("t"), i.alias("at"))), lambda x: (x["t"] <= F.col("cum_n")) & (x["t"] > F.col("cum_n") - F.col("n")))
    found = sums.join(F.broadcast(known.select("feature", "targets")), "feature").select("feature", F.explode(hits).alias("hit"), "value", "own", "cum_n")
    return found.select("feature", "hit.at", "value", (F.col("hit.t") > F.col("cum_n") - F.col("own")).alias("sure")).collect()  # one row a feature and point


#: Values of a feature that one task may sort; beyond it ranks are bracketed first. Both ways give the same values.
ONE_TASK = 250_000


def exact_quantiles(values: DataFrame, buckets: int = 10, k: int = KLL_K, one_task: int = ONE_TASK) -> dict[str, list[float]]:
    """Of each feature (values: feature, value) the values at ranks ceil(i n / buckets), i = 1 .. buckets - 1; NaN is left out.

    A sketch brackets each rank by twice its error; one pass counts what lies in the brackets value by value and
    everything else in between as a whole, and running totals give the values. Should a bracket have missed its rank, that
    feature is counted without brackets. Features of up to ``one_task`` values are sorted in a task each instead. The driver gets
    one number a feature and point.
    """
    real = values.where(~F.isnan("value"))
    sizes = {r["feature"]: r["n"] for r in real.groupBy("feature").agg(F.count("value").alias("n")).collect() if r["n"]}
    large = [f for f, n in sizes.items() if n > one_task]
    points, out = [i / buckets for i in range(1, buckets)], {}
    if len(large) < len(sizes):
        # A sketch with room for all values is exact.
        room = max(n for n in sizes.values() if n <= one_task)
        few = real.where(~F.col("feature").isin(large)) if large else real
        out |= {r[0]: list(r[1]) for r in few.groupBy("feature").agg(F.percentile_approx("value", points, 4 * room)).collect() if r[1]}
    return out | (_bracketed(real.where(F.col("feature").isin(large)), points, buckets, k) if large else {})


def _bracketed(values: DataFrame, points: list[float], buckets: int, k: int) -> dict[str, list[float]]:
    error, m = 2 * rank_error(k), len(points)
    ends = [*(max(0.0, p - error) for p in points), *(min(1.0, p + error) for p in points)]
    found = sketched(values, ["feature"], k=k).select("feature", F.kll_sketch_get_n_double("sketch").alias("n"), sketch_quantiles("sketch", ends).alias("ends")).collect()
    spans = {r["feature"]: _merged(list(zip(r["ends"][:m], r["ends"][m:], strict=True))) for r in found}
    targets = {r["feature"]: [-(-i * r["n"] // buckets) for i in range(1, buckets)] for r in found}
    picked = _picked(values, spans, targets)
    missed = {f for f in spans if sum(r["sure"] for r in picked if r["feature"] == f) < m}
    if missed:
        lowest = sys.float_info.max
        picked = [r for r in picked if r["feature"] not in missed] + _picked(values.where(F.col("feature").isin(list(missed))), {f: [(-lowest, lowest), (math.inf, math.inf)] for f in missed}, {f: targets[f] for f in missed})
    out = {f: [0.0] * m for f in spans}
    for r in picked:
        out[r["feature"]][r["at"]] = r["value"]
    return out
