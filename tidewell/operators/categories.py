"""Frequencies of categories: heavy hitters exactly, everything else as "other", on any column whatever its cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value that has at least this share of the rows is a category of its own.
MIN_SHARE = 0.001
#: Items that a sketch tracks; it errs by at most 3.5 / TRACKED of all rows.
TRACKED = 32_768

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in _NUMERIC or kind.startswith("decimal")


def split_columns(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric columns, columns that are taken as categories: text, booleans, dates and whatever else has a text)."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if is_numeric(kinds[c])]
    return numeric, [c for c in columns if c not in numeric]


def as_text(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep.., feature, value) with the non-null values of the columns as text."""
    values = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(*(keep or []), F.inline(values)).where("value is not null")


def _candidates(values: DataFrame, min_share: float, tracked: int, parts: int = 64) -> DataFrame:
    """feature, value: a superset of the heavy values, at most 2 / min_share a feature, by a mergeable top-k sketch."""
    if min_share < 7 / tracked:
        raise ValueError(f"a share of {min_share} needs a sketch of more than {tracked} items")
    part = values.groupBy("feature", F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("state"))
    whole = part.groupBy("feature").agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    most = min(tracked, int(2 / min_share))
    return whole.select("feature", F.explode(F.expr(f"approx_top_k_estimate(state, {most})")).alias("x")).select("feature", "x.item").withColumnRenamed("item", "value")


def heavy_values(values: DataFrame, min_share: float = MIN_SHARE, tracked: int = TRACKED) -> DataFrame:
    """feature, edges: the values with at least ``min_share`` of the feature's rows (values: feature, value), in order.

    A sketch proposes, an exact count over all rows decides. A column of millions of distinct values has none, and costs no more
    than the sketch and one pass; at most 1 / min_share values a feature come to the driver.
    """
    maybe = F.broadcast(_candidates(values, min_share, tracked).withColumn("known", F.lit(True)))  # at most 2 / min_share rows a feature
    counted = values.join(maybe, ["feature", "value"], "left")
    counted = counted.groupBy("feature", F.when(F.col("known"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    got: dict[str, dict] = {}
    for r in counted.collect():
        got.setdefault(r["feature"], {})[r["value"]] = r["n"]
    rows = [(f, sorted((v for v, n in ns.items() if v is not None and n >= min_share * sum(ns.values())), key=str.encode)) for f, ns in got.items()]
    return values.sparkSession.createDataFrame(rows, "feature string, edges array<string>")


def category_counts(values: DataFrame, heavy: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep.., feature, bucket, n: the place of a value among the heavy ones of its feature, or their number for any other value."""
    known = heavy.select("feature", F.posexplode("edges").alias("bucket", "value"))
    rest = heavy.select("feature", F.size("edges").alias("rest"))
    placed = values.join(F.broadcast(rest), "feature").join(F.broadcast(known), ["feature", "value"], "left")  # at most 1 / min_share rows a feature
    return placed.groupBy(*(keep or []), "feature", F.coalesce("bucket", "rest").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def named_buckets(counts: DataFrame, heavy: DataFrame) -> DataFrame:
    """``counts`` with value in place of bucket; null is every value that is not heavy."""
    return counts.join(F.broadcast(heavy), "feature").withColumn("value", F.get("edges", F.col("bucket"))).drop("bucket", "edges")
