"""Row-level credit features and labels: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVED = ["monthly_instalment", "credit_to_age_ratio", "total_obligation_load", "has_multiple_credits", "dependents_per_credit"]
BANDS = ["residence_band", "age_band"]
MONITORED = ["duration", "credit_amount", "age", "installment_commitment", "monthly_instalment", "credit_to_age_ratio"]


def _per(amount: str, by: str) -> Column:
    """amount / by to two places; 0 where there is nothing to divide by. A null amount stays null."""
    return F.when(F.col(by).isNull() | (F.col(by) <= 0), F.lit(0.0)).otherwise(F.round(F.try_divide(F.col(amount), F.col(by)), 2))


def monthly_instalment() -> Column:
    return _per("credit_amount", "duration")


def credit_to_age_ratio() -> Column:
    return _per("credit_amount", "age")


def total_obligation_load() -> Column:
    """Unknown credits count as one here, though not in ``has_multiple_credits``."""
    return F.coalesce("installment_commitment", F.lit(0)) * F.coalesce("existing_credits", F.lit(1))


def has_multiple_credits() -> Column:
    return (F.coalesce("existing_credits", F.lit(0)) > 1).cast("int")


def dependents_per_credit() -> Column:
    credits = F.greatest(F.coalesce("existing_credits", F.lit(1)), F.lit(1))
    return F.round(F.coalesce("num_dependents", F.lit(0)) / credits, 2)


def banded(value: str, edges: list[tuple[float, str]], above: str) -> Column:
    """The name of the first edge that the value is below; null and the rest are ``above``."""
    out = F.lit(above)
    for edge, name in reversed(edges):
        out = F.when(F.col(value) < edge, F.lit(name)).otherwise(out)
    return out


def residence_band() -> Column:
    """Unknown residence counts as transient."""
    return F.when(F.coalesce("residence_since", F.lit(0)) < 2, "TRANSIENT").when(F.col("residence_since") < 4, "SETTLING").otherwise("STABLE")


def age_band() -> Column:
    return banded("age", [(25, "YOUNG"), (40, "PRIME"), (60, "MATURE")], "SENIOR")


def compute_features(df: DataFrame) -> DataFrame:
    """``df`` with all derived features; rows, the label and all other columns stay."""
    return df.withColumns(
        {
            "monthly_instalment": monthly_instalment(),
            "credit_to_age_ratio": credit_to_age_ratio(),
            "total_obligation_load": total_obligation_load(),
            "has_multiple_credits": has_multiple_credits(),
            "dependents_per_credit": dependents_per_credit(),
            "residence_band": residence_band(),
            "age_band": age_band(),
        }
    )


def bad_label(column: str = "class", bad: str = "bad") -> Column:
    """1 for the bad class, which is the event that models predict."""
    return (F.col(column) == bad).cast("int")


def ceil_timestamp(column: str, minutes: int) -> Column:
    """The timestamp rounded up to whole steps of ``minutes``."""
    step = 60 * minutes
    return F.timestamp_seconds(F.ceil(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(step * 1_000_000.0)) * step)


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_null: one row per column, from one pass."""
    sums = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return sums.unpivot([], columns, "column", "n_null")


def label_encode(df: DataFrame, column: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(``df`` with integer codes, the mapping): classes in lexical order from 0; null stays null.

    The mapping has one row a class; it is joined, so its size is Spark's to judge.
    """
    from pyspark.sql import Window

    classes = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    mapping = classes.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)
    return df.join(mapping.select(F.col("value").alias(column), F.col("code").alias(out)), column, "left"), mapping
