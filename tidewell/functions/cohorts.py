"""Deterministic cohorts: the same key is in the same arm in every run, on every layout."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def cohort_bucket(key: str, salt: str, buckets: int = 100) -> Column:
    """0 to ``buckets`` - 1 by CRC-32 of salt and key; another salt shuffles the keys anew."""
    return F.pmod(F.crc32(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")).cast("binary")), F.lit(buckets)).cast("int")


def cohort(key: str, salt: str, split_percent: int) -> Column:
    """'B' for the first ``split_percent`` buckets, else 'A': a wider split keeps whoever was in."""
    if not 0 <= split_percent <= 100:
        raise ValueError("split_percent must be 0 to 100")
    return F.when(cohort_bucket(key, salt) < split_percent, "B").otherwise("A")


def cohort_of(value: object, salt: str, split_percent: int) -> str:
    """The arm of one key, outside Spark."""
    return "B" if zlib.crc32(f"{salt}:{value}".encode()) % 100 < split_percent else "A"


def sampled(key: str, fraction: float, seed: int = 42) -> Column:
    """True for about this fraction of the keys, whatever the partitioning."""
    return cohort_bucket(key, f"sample {seed}", 1_000_000) < F.lit(int(fraction * 1_000_000))
