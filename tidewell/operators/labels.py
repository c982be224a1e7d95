"""Delayed labels: backfill of the inference log, and what it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits


def backfill_labels(log: DataFrame, outcomes: DataFrame, key: str = "customer_id", label: str = "ground_truth", outcome: str = "is_default", scored_at: str | None = None, outcome_at: str | None = None) -> DataFrame:
    """``log`` with null labels filled from ``outcomes``; set labels stay and no row is added.

    A key with several outcomes gets the greatest of the latest time (or of all, without times), so rows
    never multiply. With both time columns only outcomes from the scoring on count.
    """
    at = F.col(outcome_at) if outcome_at else F.lit(0)
    # Null outcomes say nothing; one row a key after this.
    best = outcomes.where(F.col(outcome).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(at.alias("at"), F.col(outcome).cast("double").alias("value"))).alias("__best"))
    joined = log.join(best, F.col(key) == F.col("__key"), "left")
    counts = F.lit(True) if not (scored_at and outcome_at) else F.col("__best.at") >= F.col(scored_at)
    filled = F.coalesce(F.col(label).cast("double"), F.when(counts, F.col("__best.value")))
    return joined.withColumn(label, filled).select(*log.columns)


def backfill_stored(spark: SparkSession, path: str, outcomes: DataFrame, partition: str, keys: list[str] | None = None, key: str = "customer_id", label: str = "ground_truth", outcome: str = "is_default", scored_at: str | None = None, outcome_at: str | None = None) -> list[str]:
    """Fill the null labels of a stored log in place; the values of ``partition`` that were rewritten, as text.

    Only partitions with an open label that an outcome fills are read whole and rewritten; all other files stay as they are, and a
    second run with the same outcomes rewrites none. The rewrite is a commit: a loss midway is mended by the next
    run. With ``keys`` of the log its change set is kept. The list of partitions is what comes to the driver.
    """
    commits.recover(spark, path, partition)
    log = spark.read.parquet(path)
    filled = backfill_labels(log.where(F.col(label).isNull()), outcomes, key, label, outcome, scored_at, outcome_at)
    touched = [r[0] for r in filled.where(F.col(label).isNotNull()).select(partition).distinct().orderBy(partition).collect()]
    if not touched:
        return []
    known = [v for v in touched if v is not None]
    inside = F.col(partition).isin(known) if None not in touched else F.col(partition).isNull() | F.col(partition).isin(known)
    commits.commit(backfill_labels(log.where(inside), outcomes, key, label, outcome, scored_at, outcome_at), path, partition, keys)
    return [str(v) for v in touched]


def label_coverage(log: DataFrame, label: str = "ground_truth") -> DataFrame:
    """total, labelled, unlabelled, coverage (4 places, 0 for an empty log)."""
    counts = log.agg(F.count(F.lit(1)).alias("total"), F.count(label).alias("labelled"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.try_divide("labelled", "total"), 4))
    return counts.withColumns({"unlabelled": F.col("total") - F.col("labelled"), "coverage": share})


def log_health(log: DataFrame, label: str = "ground_truth", prediction: str = "prediction", scored_at: str = "scored_at") -> DataFrame:
    """total, labelled, distinct_predictions and distinct_days of the log."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(label).alias("labelled"),
        F.count_distinct(prediction).alias("distinct_predictions"),
        F.count_distinct(F.to_date(scored_at)).alias("distinct_days"),
    )
