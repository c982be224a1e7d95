"""Credit policy as Columns, and as temporary SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the policy: highest probability of default in each band, multiple and cap of its limit.
BANDS = {
    "BAND_A_LOW_RISK": (0.10, 2.0, 1_000_000.0),
    "BAND_B_MEDIUM_RISK": (0.25, 1.0, 500_000.0),
    "BAND_C_HIGH_RISK": (0.50, 0.5, 100_000.0),
}
EXCESSIVE = "BAND_D_EXCESSIVE_RISK"
MINIMUM_AGE = 18


def _verdict(eligible: bool, band: str, reason: str) -> Column:
    return F.struct(F.lit(eligible).alias("eligible"), F.lit(band).alias("risk_band"), F.lit(reason).alias("rejection_reason"))


def eligibility(pd_score: str = "prediction", age: str = "age", kyc_status: str = "kyc_status") -> Column:
    """struct(eligible, risk_band, rejection_reason): hard filters first, then inclusive bands.

    An unknown score is in no band and fails closed, as a score above the last does.
    """
    out = F.when(F.col(kyc_status).isNull() | (F.upper(kyc_status) != "VERIFIED"), _verdict(False, "REJECTED", "KYC_NOT_VERIFIED"))
    out = out.when(F.col(age).isNull() | (F.col(age) < MINIMUM_AGE), _verdict(False, "REJECTED", "UNDERAGE"))
    for band, (highest, _, _) in BANDS.items():
        out = out.when(F.col(pd_score) <= highest, _verdict(True, band, "NONE"))
    return out.otherwise(_verdict(False, EXCESSIVE, "PD_EXCEEDS_THRESHOLD"))


def credit_limit(risk_band: Column | str = "risk_band", credit_amount: Column | str = "credit_amount", null_amount_gets_cap: bool = False) -> Column:
    """Multiple of the amount up to the band's cap, 0 outside the bands.

    ``least`` skips nulls, so an unknown amount would be granted the cap; it gets 0 unless asked for.
    """
    band = F.col(risk_band) if isinstance(risk_band, str) else risk_band
    amount = F.col(credit_amount) if isinstance(credit_amount, str) else credit_amount
    out = F.when(F.lit(False), F.lit(0.0)) if null_amount_gets_cap else F.when(amount.isNull(), F.lit(0.0))
    for name, (_, multiple, cap) in BANDS.items():
        out = out.when(band == name, F.least(amount * multiple, F.lit(cap)))
    return out.otherwise(F.lit(0.0))


def register_policy_functions(spark: SparkSession, eligibility_name: str = "credit_eligibility", limit_name: str = "credit_limit", schema: str | None = None) -> None:
    """The policy for SQL users: two functions that Spark inlines into the caller's plan.

    They are temporary, or kept in the catalog's ``schema``, for all sessions and with a comment, if one is named.
    """
    kind = "FUNCTION" if schema else "TEMPORARY FUNCTION"
    eligibility_name, limit_name = (f"{schema}.{n}" if schema else n for n in (eligibility_name, limit_name))
    told = lambda text: f"COMMENT '{text}'" if schema else ""
    verdict = lambda ok, band, why: f"named_struct('eligible', {ok}, 'risk_band', '{band}', 'rejection_reason', '{why}')"
    in_band = " ".join(f"WHEN pd_score <= {v[0]}D THEN {verdict('true', k, 'NONE')}" for k, v in BANDS.items())
    limits = " ".join(f"WHEN risk_band = '{k}' THEN LEAST(amount * {v[1]}D, {v[2]}D)" for k, v in BANDS.items())
    spark.sql(f"""
        CREATE OR REPLACE {kind} {eligibility_name}(pd_score DOUBLE, age INT, kyc_status STRING)
        RETURNS STRUCT<eligible: BOOLEAN, risk_band: STRING, rejection_reason: STRING> {told("eligibility, band and reason of an applicant by score, age and identity check")} RETURN CASE
        WHEN kyc_status IS NULL OR upper(kyc_status) <> 'VERIFIED' THEN {verdict("false", "REJECTED", "KYC_NOT_VERIFIED")}
        WHEN age IS NULL OR age < {MINIMUM_AGE} THEN {verdict("false", "REJECTED", "UNDERAGE")}
        {in_band} ELSE {verdict("false", EXCESSIVE, "PD_EXCEEDS_THRESHOLD")} END""")
    spark.sql(f"""
        CREATE OR REPLACE {kind} {limit_name}(risk_band STRING, amount DOUBLE) RETURNS DOUBLE {told("the limit that a band allows for an amount")}
        RETURN CASE WHEN amount IS NULL THEN 0.0D {limits} ELSE 0.0D END""")
