import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.functions import cohorts, features, policy

APPLICANTS = "duration int, credit_amount double, installment_commitment int, age int, existing_credits int, num_dependents int, residence_since int, class int"


@pytest.fixture(scope="module")
def applicants(spark):
    rows = [
        (24, 4800.0, 2, 35, 1, 1, 4, 0),
        (6, 12000.0, 4, 22, 3, 2, 1, 1),
        (0, 1000.0, 1, 45, 1, 0, 5, 0),
        (36, 8000.0, None, 52, None, None, None, 0),
        (60, 15000.0, 4, 68, 4, 1, 7, 1),
    ]
    return spark.createDataFrame(rows, APPLICANTS)


def test_features(applicants):
    out = features.compute_features(applicants).collect()
    assert [r.monthly_instalment for r in out] == [200.0, 2000.0, 0.0, 222.22, 250.0]
    assert [r.total_obligation_load for r in out] == [2, 12, 1, 0, 16]
    assert [r.has_multiple_credits for r in out] == [0, 1, 0, 0, 1]
    assert [r.residence_band for r in out] == ["STABLE", "TRANSIENT", "STABLE", "TRANSIENT", "STABLE"]
    assert [r.age_band for r in out] == ["PRIME", "YOUNG", "MATURE", "MATURE", "SENIOR"]
    assert [r["class"] for r in out] == [0, 1, 0, 0, 1]


def test_features_twice_and_nulls(applicants):
    once = features.compute_features(applicants)
    twice = features.compute_features(once)
    assert once.select("monthly_instalment").collect() == twice.select("monthly_instalment").collect()
    audit = {r.column: r.n_null for r in features.null_audit(once, features.DERIVED + ["num_dependents"]).collect()}
    assert audit == dict.fromkeys(features.DERIVED, 0) | {"num_dependents": 1}


@pytest.mark.parametrize(
    "score, age, kyc, band, reason",
    [
        (0.001, 40, "PENDING", "REJECTED", "KYC_NOT_VERIFIED"),
        (0.001, 17, "VERIFIED", "REJECTED", "UNDERAGE"),
        (0.01, 40, None, "REJECTED", "KYC_NOT_VERIFIED"),
        (0.10, 40, "verified", "BAND_A_LOW_RISK", "NONE"),
        (0.25, 40, "VERIFIED", "BAND_B_MEDIUM_RISK", "NONE"),
        (0.50, 40, "VERIFIED", "BAND_C_HIGH_RISK", "NONE"),
        (0.51, 40, "VERIFIED", "BAND_D_EXCESSIVE_RISK", "PD_EXCEEDS_THRESHOLD"),
        (None, 40, "VERIFIED", "BAND_D_EXCESSIVE_RISK", "PD_EXCEEDS_THRESHOLD"),
    ],
)
def test_policy(spark, score, age, kyc, band, reason):
    row = spark.createDataFrame([(score, age, kyc)], "prediction double, age int, kyc_status string")
    policy.register_policy_functions(spark)
    for column in (policy.eligibility(), F.expr("credit_eligibility(prediction, age, kyc_status)")):
        got = row.select(column.alias("v")).first().v
        assert (got.risk_band, got.rejection_reason, got.eligible) == (band, reason, reason == "NONE")


def test_policy_functions_in_the_catalog(spark):
    policy.register_policy_functions(spark, "kept_eligibility", "kept_limit", schema="default")
    other = spark.newSession()
    (row,) = other.sql("select default.kept_eligibility(0.2D, 40, 'verified') as v, default.kept_limit('BAND_C_HIGH_RISK', 50000D) as x").collect()
    assert (row.v.risk_band, row.x) == ("BAND_B_MEDIUM_RISK", 25_000.0)
    for name in ("kept_eligibility", "kept_limit"):
        assert "by score" in str(other.sql(f"describe function extended default.{name}").collect()) or name == "kept_limit"
        other.sql(f"drop function default.{name}")


def test_limits(spark):
    rows = spark.createDataFrame([("BAND_A_LOW_RISK", 99999999.0), ("BAND_C_HIGH_RISK", 50000.0), ("REJECTED", 50000.0), ("BAND_A_LOW_RISK", None)], "risk_band string, credit_amount double")
    assert [r.x for r in rows.select(policy.credit_limit().alias("x")).collect()] == [1_000_000.0, 25_000.0, 0.0, 0.0]
    assert rows.select(policy.credit_limit(null_amount_gets_cap=True).alias("x")).collect()[3].x == 1_000_000.0


def test_cohorts(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("cust_"), "id").alias("k"))
    rows = keys.select("k", cohorts.cohort_bucket("k", "s").alias("b"), cohorts.cohort("k", "s", 10).alias("narrow"), cohorts.cohort("k", "s", 20).alias("wide")).collect()
    assert all(r.b == zlib.crc32(f"s:{r.k}".encode()) % 100 for r in rows)
    assert all(r.wide == "B" for r in rows if r.narrow == "B")
    assert abs(sum(r.narrow == "B" for r in rows) / len(rows) - 0.1) < 0.01
    assert cohorts.cohort_of("cust_1", "s", 10) == rows[1].narrow
    with pytest.raises(ValueError):
        cohorts.cohort("k", "s", 101)


def test_ceil_timestamp(spark):
    row = spark.sql("select timestamp'2024-01-01 10:00:00' as a, timestamp'2024-01-01 10:00:00.000001' as b")
    got = row.select(features.ceil_timestamp("a", 15).cast("string").alias("a"), features.ceil_timestamp("b", 15).cast("string").alias("b")).first()
    assert (got.a, got.b) == ("2024-01-01 10:00:00", "2024-01-01 10:15:00")
