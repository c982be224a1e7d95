"""Policy decisions over a scored batch, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import credit_limit, eligibility


def apply_policy(scored: DataFrame, decided_at: str, pd_score: str = "prediction", age: str = "age", amount: str = "credit_amount", kyc_status: str = "kyc_status") -> DataFrame:
    """``scored`` with is_eligible, risk_band, rejection_reason, recommended_limit and decided_at.

    Without a KYC column adults count as verified; that stand-in can't tell minors from the unverified.
    """
    rows = scored
    if kyc_status not in scored.columns:
        rows = scored.withColumn(kyc_status, F.when(F.col(age) >= 18, "VERIFIED").otherwise("PENDING"))
    rows = rows.withColumn("__verdict", eligibility(pd_score, age, kyc_status))
    return rows.withColumns(
        {
            "is_eligible": F.col("__verdict.eligible"),
            "risk_band": F.col("__verdict.risk_band"),
            "rejection_reason": F.col("__verdict.rejection_reason"),
            "recommended_limit": credit_limit(F.col("__verdict.risk_band"), amount),
            "decided_at": F.lit(decided_at).cast("timestamp"),
        }
    ).drop("__verdict")


def decision_mix(decisions: DataFrame, by: list[str] | None = None, pd_score: str = "prediction") -> DataFrame:
    """applicants, avg_pd (4 places) and avg_limit (whole) by risk band, and by ``by`` before it; ordered."""
    groups = [*(by or []), "risk_band"]
    out = decisions.groupBy(*groups).agg(F.count(F.lit(1)).alias("applicants"), F.round(F.avg(pd_score), 4).alias("avg_pd"), F.round(F.avg("recommended_limit"), 0).alias("avg_limit"))
    return out.orderBy(*groups)


def approval_rate(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n and approval_rate (0 for no decisions at all), by ``by`` if given."""
    out = decisions.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_eligible").cast("double")).alias("approval_rate"))
    return out.withColumn("approval_rate", F.coalesce("approval_rate", F.lit(0.0)))


def rejection_reasons(decisions: DataFrame) -> DataFrame:
    """Reasons of the rejected, most frequent first."""
    return decisions.where("not is_eligible").groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rejection_reason")
