"""Distribution functions of test statistics as Columns: chi-squared, Kolmogorov, normal."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column, terms: int = 400) -> Column:
    """The complementary error function of a number, not null, from 0 on, by the series of erf, whose terms are all positive.

    ``terms`` reach 1e-15 up to 10; beyond it is below 1e-44 and comes out as 0.
    """
    x = F.least(x, F.lit(10.0))
    first = F.struct(x.alias("term"), x.alias("sum"))
    step = lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step, lambda a: a["sum"] * F.exp(-x * x) * F.lit(2 / math.sqrt(math.pi)))
    return F.greatest(F.lit(0.0), 1 - erf)


def chi2_tail(x: Column, df: Column) -> Column:
    """The chance that chi-squared with ``df`` degrees of freedom (a whole number) exceeds ``x``: the regularised upper incomplete gamma function.

    For even df it is exp(-h) times the sum of h^k / k! over k < df / 2, h being x / 2; for odd df erfc(sqrt(h)) and the like sum
    over half-numbers. Terms are summed by their logarithms. Null without degrees of freedom; 1 for x of 0 or below.
    """
    h, odd = x.cast("double") / 2, df % 2
    log_h = F.log(h)
    # Before the first term: h^-1 / Gamma(0) stands for nothing, so the first terms are set: log of 1, or of sqrt(h) / Gamma(3/2).
    first = F.when(odd == 1, log_h / 2 - F.lit(math.lgamma(1.5))).otherwise(0.0) - h
    n = F.floor((df - odd) / 2).cast("int")
    start = F.struct(first.alias("log"), F.lit(0.0).alias("sum"))
    step = lambda acc, k: F.struct((acc["log"] + log_h - F.log(k + odd / 2)).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))
    terms = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k.cast("double"))).otherwise(F.array().cast("array<double>"))
    total = F.aggregate(terms, start, step, lambda acc: acc["sum"])
    tail = total + F.when(odd == 1, erfc(F.sqrt(h))).otherwise(0.0)
    return F.when((df >= 1) & x.isNotNull(), F.when(h <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail)))


def kolmogorov_tail(x: Column, terms: int = 20) -> Column:
    """The chance that Kolmogorov's limiting distribution exceeds ``x``, by whichever of its two series converges fast."""
    k = F.sequence(F.lit(1), F.lit(terms))
    summed = lambda f: F.aggregate(F.transform(k, f), F.lit(0.0), lambda a, b: a + b)
    high = 2 * summed(lambda i: F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * x * x))
    low = 1 - math.sqrt(2 * math.pi) / x * summed(lambda i: F.exp(-F.pow(2 * i - 1, F.lit(2)) * math.pi**2 / (8.0 * x * x)))
    return F.when(x <= 0.04, 1.0).when(x > 0.04, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(x < 1, low).otherwise(high))))


def ks_p_value(distance: Column, n: Column, m: Column) -> Column:
    """The two-sample Kolmogorov-Smirnov test's asymptotic p-value; null if a sample is empty."""
    effective = F.try_divide(n * m.cast("double"), n + m)
    return F.when((n > 0) & (m > 0), kolmogorov_tail(distance * F.sqrt(effective)))
