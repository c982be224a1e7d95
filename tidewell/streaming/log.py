"""The inference log and its daily profile as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import THRESHOLD, inference_log


def log_stream(scored: DataFrame, monitored: list[str], score: str = "prediction", threshold: float = THRESHOLD) -> DataFrame:
    """The log's shape row by row; works on a stream as on a table."""
    return inference_log(scored, monitored, score, threshold)


def profile_stream(log: DataFrame, window: str = "1 day", late_by: str = "2 hours") -> DataFrame:
    """Counts, mean score and positive rate per window and model version; rows later than ``late_by`` are dropped."""
    rows = log.withWatermark("scored_at", late_by)
    out = rows.groupBy(F.window("scored_at", window), "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction_score").alias("mean_score"), F.avg("prediction").alias("positive_rate")
    )
    return out.select(F.col("window.start").alias("window_start"), "model_version", "n", "mean_score", "positive_rate")


def late_labels(log: DataFrame, outcomes: DataFrame, wait: str = "30 days", late_by: str = "2 hours") -> DataFrame:
    """Log rows with the outcomes that arrive within ``wait`` of the scoring, as a stream-stream join."""
    left = log.drop("ground_truth").withWatermark("scored_at", late_by)
    right = outcomes.select(F.col("customer_id").alias("outcome_customer"), F.col("is_default").cast("double").alias("ground_truth"), "outcome_at").withWatermark("outcome_at", late_by)
    near = (F.col("outcome_at") >= F.col("scored_at")) & (F.col("outcome_at") <= F.col("scored_at") + F.expr(f"interval {wait}"))
    return left.join(right, (F.col("customer_id") == F.col("outcome_customer")) & near, "left").drop("outcome_customer")
