"""A/B comparison of arms from the inference log and the decision table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drift import bucket_counts, bucket_shares, psi_of, quantile_edges
from .significance import erfc


def ratio(top: Column, bottom: Column, zero_division: float | None = None) -> Column:
    """top / bottom, and ``zero_division`` (null for A/B reports, 0 for validation) where that is undefined."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(zero_division).cast("double"))


def confusion(log: DataFrame, by: list[str], prediction: str = "prediction", label: str = "ground_truth", zero_division: float | None = None) -> DataFrame:
    """tp, fp, fn, tn, n_labelled, accuracy, precision and recall by group, over labelled rows."""
    seen = F.col(label).isNotNull()
    p, y = F.col(prediction) == 1, F.col(label) == 1
    out = log.groupBy(*by).agg(
        F.count_if(seen & p & y).alias("tp"),
        F.count_if(seen & p & ~y).alias("fp"),
        F.count_if(seen & ~p & y).alias("fn"),
        F.count_if(seen & ~p & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns(
        {
            "n_labelled": tp + fp + fn + tn,
            "accuracy": ratio(tp + tn, tp + fp + fn + tn, zero_division),
            "precision": ratio(tp, tp + fp, zero_division),
            "recall": ratio(tp, tp + fn, zero_division),
        }
    )


def arm_summary(log: DataFrame, variant: str = "variant", prediction: str = "prediction", label: str = "ground_truth") -> DataFrame:
    """variant, n, n_labelled, positive_pred_rate and model_version (distinct ones, by comma); rows without an arm are left out."""
    arms = log.where(F.col(variant).isNotNull() & (F.col(variant) != ""))
    return arms.groupBy(F.col(variant).alias("variant")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(label).alias("n_labelled"),
        F.avg((F.col(prediction) == 1).cast("double")).alias("positive_pred_rate"),
        F.concat_ws(",", F.sort_array(F.collect_set("model_version"))).alias("model_version"),
    )


def score_psi(log: DataFrame, variant: str = "variant", score: str = "prediction_score", control: str = "A", buckets: int = 10) -> DataFrame:
    """variant, psi of each arm's scores on the edges of the control's, which is the first arm if there is no such arm."""
    arms = log.where(F.col(variant).isNotNull() & (F.col(variant) != ""))
    name = score if score in log.columns else "prediction"
    rows = arms.select(F.col(variant).alias("feature"), F.col(name).cast("double").alias("value")).where("value is not null")
    champion = rows.agg(F.coalesce(F.min(F.when(F.col("feature") == control, F.col("feature"))), F.min("feature"))).first()[0]
    edges = quantile_edges(rows.where(F.col("feature") == champion), buckets).select("edges")
    names = rows.select("feature").distinct()
    per_arm = names.join(F.broadcast(edges))  # one row
    counts = bucket_counts(rows, per_arm)
    base = counts.where(F.col("feature") == champion).select("bucket", "n")
    base = names.join(F.broadcast(base))  # at most ``buckets`` rows
    shares = bucket_shares(base, counts, per_arm)
    return psi_of(shares, ["feature"]).withColumnRenamed("feature", "variant")


def z_test(s_a: Column, n_a: Column, s_b: Column, n_b: Column) -> tuple[Column, Column]:
    """(difference B - A, z) of two proportions with the pooled variance; null where it is undefined."""
    pooled = F.try_divide(s_a + s_b, n_a + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    diff = F.try_divide(s_b, n_b) - F.try_divide(s_a, n_a)
    return diff, F.when(error > 0, F.try_divide(diff, error))


def two_sided_p(z: Column) -> Column:
    """The chance of a standard normal value as far from 0 as ``z``; null for null or NaN."""
    return F.when(z.isNotNull() & ~F.isnan(z), erfc(F.abs(z) / math.sqrt(2)))


def significance(metrics: DataFrame) -> DataFrame:
    """primary_metric, diff, z of the two arms in ``metrics`` (one row; nulls unless there are exactly two).

    Accuracy is primary when both arms have labels, the approval rate otherwise, each with its own counts.
    """
    first, second = F.min_by(F.struct("*"), "variant"), F.max_by(F.struct("*"), "variant")
    pair = metrics.agg(F.count(F.lit(1)).alias("arms"), first.alias("a"), second.alias("b"))
    by_label = (F.col("arms") == 2) & (F.col("a.n_labelled") > 0) & (F.col("b.n_labelled") > 0)
    by_rate = (F.col("arms") == 2) & F.col("a.approval_rate").isNotNull() & F.col("b.approval_rate").isNotNull()
    hit = lambda x: F.when(by_label, F.col(f"{x}.tp") + F.col(f"{x}.tn")).when(by_rate, F.col(f"{x}.n_approved")).cast("double")
    of = lambda x: F.when(by_label, F.col(f"{x}.n_labelled")).when(by_rate, F.col(f"{x}.n_decided")).cast("double")
    diff, z = z_test(hit("a"), of("a"), hit("b"), of("b"))
    return pair.select(F.when(by_label, "accuracy").when(by_rate, "approval_rate").alias("primary_metric"), diff.alias("diff"), z.alias("z"))


def compare_arms(log: DataFrame, decisions: DataFrame | None, checked_at: str, serving_mode: str = "batch", p_values: bool = True) -> DataFrame:
    """The comparison table: one row an arm, the test's columns on each.

    ``decisions`` has variant and is_eligible; its approval rates are tested on its own numbers of rows.
    """
    metrics = arm_summary(log).join(confusion(log, ["variant"]).drop("n_labelled"), "variant").join(score_psi(log), "variant", "left")
    if decisions is None:
        none = F.lit(None)
        metrics = metrics.withColumns({"n_decided": none.cast("long"), "n_approved": none.cast("long"), "approval_rate": none.cast("double")})
    else:
        rates = decisions.groupBy("variant").agg(F.count(F.lit(1)).alias("n_decided"), F.count_if("is_eligible").alias("n_approved"), F.avg(F.col("is_eligible").cast("double")).alias("approval_rate"))
        metrics = metrics.join(rates, "variant", "left")
    tested = significance(metrics)
    tested = tested.withColumn("p_value", two_sided_p(F.col("z"))) if p_values else tested
    out = metrics.join(F.broadcast(tested))  # one row
    return out.select(
        "variant", "model_version", "n", "approval_rate", "positive_pred_rate", "accuracy", "precision", "recall", "psi", "primary_metric", "z",
        *(["p_value"] if p_values else []), F.lit(serving_mode).alias("serving_mode"), F.lit(checked_at).alias("checked_at"),
    )
