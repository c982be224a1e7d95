"""Model-quality metrics and the threshold gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import cumulative

#: Metric, bound, whether greater is better.
THRESHOLDS = [("roc_auc", 0.70, True), ("precision", 0.40, True), ("recall", 0.40, True)]


def ranking_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision), from distinct scores and running counts.

    Null scores and labels are left out; without both classes the metrics are null.
    """
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = rows.groupBy((-F.col(score)).cast("double").alias("down")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    upto = cumulative(steps, [], "down", ["pos", "neg"])
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = upto.agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("area"),
        F.sum(F.col("pos") * precision).alias("gain"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    return sums.select(F.try_divide("area", F.col("n_pos") * F.col("n_neg")).alias("roc_auc"), F.when(F.col("n_neg") > 0, F.try_divide("gain", "n_pos")).alias("pr_auc"))


def threshold_metrics(scored: DataFrame, score: str, label: str, threshold: float = 0.30, zero_division: float = 0.0) -> DataFrame:
    """precision, recall and f1 of score >= threshold."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.where(F.col(label).isNotNull()).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(zero_division))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def quality_metrics(scored: DataFrame, score: str, label: str, threshold: float = 0.30) -> DataFrame:
    """metric, value: roc_auc, pr_auc, precision, recall, f1 and base_rate."""
    names = ["roc_auc", "pr_auc", "precision", "recall", "f1", "base_rate"]
    rate = scored.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))
    long = lambda df: df.unpivot([], [c for c in names if c in df.columns], "metric", "value")
    return long(ranking_metrics(scored, score, label)).unionByName(long(threshold_metrics(scored, score, label, threshold))).unionByName(long(rate))


def gate(metrics: DataFrame, thresholds: list[tuple[str, float, bool]] | None = None) -> DataFrame:
    """metric, value, bound, status (PASS, BREACH, or WARNING for a metric that was not computed), message."""
    rows = [(m, float(b), g) for m, b, g in (thresholds or THRESHOLDS)]
    bounds = metrics.sparkSession.createDataFrame(rows, "metric string, bound double, greater_is_better boolean")
    both = bounds.join(metrics, "metric", "left")
    bad = F.when(F.col("greater_is_better"), F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    status = F.when(F.col("value").isNull(), "WARNING").when(bad, "BREACH").otherwise("PASS")
    said = F.when(F.col("greater_is_better"), F.format_string("%s=%.4f < required %s", "metric", "value", F.col("bound").cast("string"))).otherwise(F.format_string("%s=%.4f > allowed %s", "metric", "value", F.col("bound").cast("string")))
    return both.select("metric", "value", "bound", status.alias("status"), F.when(status == "BREACH", said).when(status == "WARNING", F.concat(F.lit("no value for "), "metric")).alias("message"))


class ThresholdBreach(RuntimeError):
    pass


def enforce(gated: DataFrame, mode: str = "enabled") -> list[str]:
    """The breaches' messages; raises on any if enabled, only reports in a dry run, reads nothing if disabled."""
    if mode == "disabled":
        return []
    if mode not in ("enabled", "dry_run"):
        raise ValueError(f"no mode {mode}")
    found = [r["message"] for r in gated.where("status = 'BREACH'").orderBy("metric").collect()]  # a row a threshold
    if found and mode == "enabled":
        raise ThresholdBreach("; ".join(found))
    return found
