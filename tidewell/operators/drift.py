"""Drift and profile metrics: any number of columns in one pass a side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .categories import as_text, category_counts, heavy_values, named_buckets, split_columns
from .quantiles import exact_quantiles
from .running import cumulative, cut_points
from .significance import chi2_tail, ks_p_value

FLOOR = 1e-4


def unpivoted(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep.., feature, value) with the non-null values of the columns as doubles."""
    values = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*(keep or []), F.inline(values)).where("value is not null")


def quantile_edges(values: DataFrame, buckets: int = 10, accuracy: int | None = None) -> DataFrame:
    """feature, edges: the distinct inner quantiles in order. NaN, above every number for Spark, is left out.

    They are exact, found by narrowing down; ``accuracy`` gives sketched ones instead, off by one part in so many.
    """
    if accuracy is None:
        found = exact_quantiles(values, buckets)
        return values.sparkSession.createDataFrame([(f, sorted(set(q))) for f, q in found.items()], "feature string, edges array<double>")
    points = [i / buckets for i in range(1, buckets)]
    edges = F.percentile_approx("value", points, accuracy)
    return values.where(~F.isnan("value")).groupBy("feature").agg(F.array_sort(F.array_distinct(edges)).alias("edges"))


def bucket_counts(values: DataFrame, edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """feature, bucket, n for the buckets that have values: the number of edges that a value exceeds.

    A value equal to an edge stays below it. Edges are one row a feature.
    """
    over = F.size(F.filter("edges", lambda e: F.col("value") > e))
    return values.join(F.broadcast(edges), "feature").groupBy(*(keep or []), "feature", over.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def bucket_shares(expected: DataFrame, actual: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, bucket, e, a, n_e, n_a over all buckets, empty ones too; e and a are shares before any floor."""
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    both = spine.join(expected.withColumnRenamed("n", "n_e"), ["feature", "bucket"], "left").join(actual.withColumnRenamed("n", "n_a"), ["feature", "bucket"], "left")
    both = both.fillna(0, ["n_e", "n_a"])
    whole = Window.partitionBy("feature")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    return both.select("feature", "bucket", "n_e", "n_a", share("n_e").alias("e"), share("n_a").alias("a"), F.sum("n_e").over(whole).alias("all_e"), F.sum("n_a").over(whole).alias("all_a"))


def psi_of(shares: DataFrame, by: list[str]) -> DataFrame:
    """Population stability index; shares are floored but not scaled again, an empty side gives 0."""
    e, a = F.greatest("e", F.lit(FLOOR)), F.greatest("a", F.lit(FLOOR))
    total = F.sum((a - e) * F.log(a / e))
    return shares.groupBy(*by).agg(F.when(F.max(F.least("all_e", "all_a")) == 0, F.lit(0.0)).otherwise(total).alias("psi"))


def psi_from_counts(actual: list[int], expected: list[int]) -> float:
    """The index of two lists of counts."""
    from math import log

    if len(actual) != len(expected):
        raise ValueError("the lists differ in length")
    if not sum(actual) or not sum(expected):
        return 0.0
    pairs = [(max(x / sum(actual), FLOOR), max(y / sum(expected), FLOOR)) for x, y in zip(actual, expected, strict=True)]
    return sum((x - y) * log(x / y) for x, y in pairs)


def verdict(psi: Column, warn: float = 0.10, retrain: float = 0.25) -> Column:
    return F.when(psi >= retrain, "RETRAIN").when(psi >= warn, "WARN").otherwise("STABLE")


def drift_report(baseline: DataFrame, live: DataFrame, columns: list[str], checked_at: str, buckets: int = 10, warn: float = 0.10, retrain: float = 0.25, accuracy: int | None = None) -> DataFrame:
    """feature, psi, verdict, checked_at; columns that either side lacks, or that the baseline has no values of, are skipped."""
    shared = [c for c in columns if c in baseline.columns and c in live.columns]
    if not shared:
        return baseline.sparkSession.createDataFrame([], "feature string, psi double, verdict string, checked_at string")
    before, now = unpivoted(baseline, shared), unpivoted(live, shared)
    edges = quantile_edges(before, buckets, accuracy)
    shares = bucket_shares(bucket_counts(before, edges), bucket_counts(now, edges), edges)
    return psi_of(shares, ["feature"]).select("feature", "psi", verdict(F.col("psi"), warn, retrain).alias("verdict"), F.lit(checked_at).alias("checked_at"))


def retrain_decision(report: DataFrame) -> DataFrame:
    """One row: n_features, n_warned, warned, worst_feature, worst_psi, retrain_required, reason. No rows, no retraining."""
    breach = F.col("verdict") == "RETRAIN"
    said = F.concat("feature", F.lit(" PSI="), F.format_string("%.4f", "psi"))
    reasons = F.concat_ws("; ", F.sort_array(F.collect_list(F.when(breach, said))))
    return report.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("verdict") == "WARN").alias("n_warned"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("verdict") == "WARN", F.col("feature"))))).alias("warned"),
        F.max_by("feature", F.struct("psi", "feature")).alias("worst_feature"),
        F.max("psi").alias("worst_psi"),
        F.coalesce(F.bool_or(breach), F.lit(False)).alias("retrain_required"),
        F.when(F.count_if(breach) > 0, reasons).otherwise("no breach").alias("reason"),
    )


def inject_skew(log: DataFrame, factors: dict[str, float], key: str, chosen: Column, suffix: str = "_skew") -> DataFrame:
    """``log`` and the chosen rows once more, with their columns multiplied and their keys marked."""
    text = log.withColumn(key, F.col(key).cast("string"))
    more = text.where(chosen).withColumns({c: (F.col(c) * f).cast(log.schema[c].dataType) for c, f in factors.items()})
    return text.unionByName(more.withColumn(key, F.concat(key, F.lit(suffix))))


def newest_first(history: DataFrame, checked_at: str = "checked_at") -> DataFrame:
    return history.orderBy(F.desc(checked_at), "feature")


def _profiled(log: DataFrame, scored_at: str, model: str, by: str | None, window: str) -> list[Column]:
    """window_start, model and slice of a row; unknown ones have a name."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return [F.window(scored_at, window).start.alias("window_start"), named(model).alias("model"), (named(by) if by else F.lit("all")).alias("slice")]


def _over_sets(rows: DataFrame, keys: list[str], metrics: list[Column]) -> DataFrame:
    """The metrics by the keys and, for model and slice, over all of them, which '*' stands for."""
    sets = [[*(F.col(k) for k in keys), *map(F.col, more)] for more in (["model", "slice"], ["model"], ["slice"], [])]
    every = [F.col(c) for c in [*keys, "model", "slice"]]
    whole = [F.when(F.grouping(c) == 1, "*").otherwise(F.col(c)).alias(f"of_{c}") for c in ("model", "slice")]
    return rows.groupingSets(sets, *every).agg(*whole, *metrics).drop("model", "slice").withColumnsRenamed({"of_model": "model", "of_slice": "slice"})


def profile_metrics(log: DataFrame, columns: list[str], scored_at: str = "scored_at", model: str = "model_version", by: str | None = None, window: str = "1 day") -> DataFrame:
    """Counts, nulls, mean, deviation and range per column, day, model version and slice; '*' is all of them.

    Columns that are no numbers have counts and nulls only; ``category_profile`` has their values.
    """
    numeric, _ = split_columns(log, columns)
    number = lambda c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
    values = F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("value"), F.col(c).isNull().alias("missing")) for c in columns))
    rows = log.select(*_profiled(log, scored_at, model, by, window), F.inline(values))
    v = F.col("value")
    metrics = [F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("n_null"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high")]
    return _over_sets(rows, ["window_start", "column"], metrics).select("window_start", "column", "model", "slice", "n", "n_null", "mean", "deviation", "low", "high")


def category_profile(log: DataFrame, columns: list[str], scored_at: str = "scored_at", model: str = "model_version", by: str | None = None, window: str = "1 day", heavy: DataFrame | None = None) -> DataFrame:
    """window_start, column, model, slice, value, n, share of the categories of each column; '*' is all models or slices.

    Values are those that are heavy in the whole log (or in ``heavy``), null stands for all others together; rows without
    a value don't count. Any type of column has categories; one whose values are all rare has only the null row.
    """
    keys = ["window_start", "model", "slice"]
    kept = log.select(*_profiled(log, scored_at, model, by, window), *columns)
    rows = as_text(kept, columns, keys)
    heavy = heavy_values(as_text(log, columns)) if heavy is None else heavy
    cells = named_buckets(category_counts(rows, heavy, keys), heavy).withColumnRenamed("feature", "column")
    out = _over_sets(cells, ["window_start", "column", "value"], [F.sum("n").alias("n")])
    whole = Window.partitionBy("window_start", "column", "model", "slice")  # at most 1 / min_share values
    return out.select("window_start", "column", "model", "slice", "value", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"))


def profile_table_metrics(log: DataFrame, prediction: str = "prediction", label: str = "ground_truth", scored_at: str = "scored_at", model: str = "model_version", by: str | None = None, window: str = "1 day") -> DataFrame:
    """Rows, labelled rows, confusion counts, accuracy, precision and recall per day, model version and slice; '*' is all of them."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    seen = F.col(label).isNotNull() & F.col(prediction).isNotNull()
    kinds = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    rows = log.select(*_profiled(log, scored_at, model, by, window), *((seen & k).alias(n) for n, k in kinds.items()))
    out = _over_sets(rows, ["window_start"], [F.count(F.lit(1)).alias("n"), *(F.count_if(n).alias(n) for n in kinds)])
    tp, fp, fn, tn = (F.col(n) for n in kinds)
    shares = {"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)}
    return out.select("window_start", "model", "slice", "n", (tp + fp + fn + tn).alias("n_labelled"), *kinds, *(c.alias(n) for n, c in shares.items()))


def distances(shares: DataFrame, by: list[str]) -> DataFrame:
    """Distances of bucket shares: psi, js (distance, base 2), chi2, tv and linf."""
    m = (F.col("e") + F.col("a")) / 2
    part = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)
    expected = F.col("e") * F.col("all_a")
    gap = F.abs(F.col("a") - F.col("e"))
    e, a = F.greatest("e", F.lit(FLOOR)), F.greatest("a", F.lit(FLOOR))
    return shares.groupBy(*by).agg(
        F.sum((a - e) * F.log(a / e)).alias("psi"),
        F.sqrt(F.greatest(F.sum(part("e") + part("a")) / 2, F.lit(0.0))).alias("js"),
        F.sum(F.when(expected > 0, (F.col("n_a") - expected) * (F.col("n_a") - expected) / expected).otherwise(0.0)).alias("chi2"),
        (F.sum(gap) / 2).alias("tv"),
        F.max(gap).alias("linf"),
    )


def cdf_distances(before: DataFrame, now: DataFrame, by: list[str] | None = None) -> DataFrame:
    """feature (or what is named), ks, wasserstein of two tables of values, from their distinct values in order."""
    by = by or ["feature"]
    side = lambda df, e, a: df.where(~F.isnan("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")).select(*by, "value", (F.col("n") * e).alias("n_e"), (F.col("n") * a).alias("n_a"))
    steps = side(before, 1, 0).unionByName(side(now, 0, 1)).groupBy(*by, "value").agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))
    every = before.select(*by, "value").unionByName(now.select(*by, "value"))
    upto = cumulative(steps, by, "value", ["n_e", "n_a"], cuts=cut_points(every, by, "value"))
    totals = steps.groupBy(*by).agg(F.sum("n_e").alias("all_e"), F.sum("n_a").alias("all_a"))
    gaps = upto.join(F.broadcast(totals), by).withColumn("gap", F.abs(F.try_divide("cum_n_e", "all_e") - F.try_divide("cum_n_a", "all_a")))
    return gaps.groupBy(*by).agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))).alias("wasserstein"))


def _sides_by_bucket(baseline: DataFrame, live: DataFrame, columns: list[str], buckets: int, accuracy: int | None) -> list[tuple[DataFrame, DataFrame | None]]:
    """(shares, distances of the distribution functions) of the numeric columns, and of the categories, which have no order."""
    numeric, texts = split_columns(baseline, columns)
    out: list[tuple[DataFrame, DataFrame | None]] = []
    if numeric:
        before, now = unpivoted(baseline, numeric), unpivoted(live, numeric)
        edges = quantile_edges(before, buckets, accuracy)
        out.append((bucket_shares(bucket_counts(before, edges), bucket_counts(now, edges), edges), cdf_distances(before, now)))
    if texts:
        before, now = as_text(baseline, texts), as_text(live, texts)
        heavy = heavy_values(before)
        out.append((bucket_shares(category_counts(before, heavy), category_counts(now, heavy), heavy), None))
    return out


def drift_metrics(baseline: DataFrame, live: DataFrame, columns: list[str], buckets: int = 10, accuracy: int | None = None) -> DataFrame:
    """feature, psi, js, chi2, tv, linf, ks, wasserstein of live against baseline.

    Columns that are no numbers are compared by the values that are heavy in the baseline and all others together; they have
    no ks and no wasserstein. A column that the baseline has no values of is skipped.
    """
    parts = []
    for shares, by_value in _sides_by_bucket(baseline, live, columns, buckets, accuracy):
        found = distances(shares, ["feature"])
        none = [F.lit(None).cast("double").alias(c) for c in ("ks", "wasserstein")]
        parts.append(found.join(by_value, "feature") if by_value is not None else found.select("*", *none))
    return reduce(DataFrame.unionByName, parts)


def drift_tests(baseline: DataFrame, live: DataFrame, columns: list[str], buckets: int = 10, accuracy: int | None = None) -> DataFrame:
    """feature, n_e, n_a, chi2, degrees, chi2_p_value, ks, ks_p_value of live against baseline.

    The chi-squared test holds live's counts against baseline's shares, over the buckets (or categories) that the baseline has rows
    in; the Kolmogorov-Smirnov test, for numbers only, is the asymptotic one of two samples. A side without rows has no p-values.
    """
    parts = []
    for shares, by_value in _sides_by_bucket(baseline, live, columns, buckets, accuracy):
        sizes = shares.groupBy("feature").agg(F.max("all_e").alias("n_e"), F.max("all_a").alias("n_a"), (F.count_if(F.col("e") > 0) - 1).alias("degrees"))
        found = distances(shares, ["feature"]).select("feature", "chi2").join(sizes, "feature")
        ks = found.join(by_value.select("feature", "ks"), "feature", "left") if by_value is not None else found.withColumn("ks", F.lit(None).cast("double"))
        parts.append(ks)
    both = reduce(DataFrame.unionByName, parts)
    chi2_p = F.when(F.col("n_a") > 0, chi2_tail(F.col("chi2"), F.col("degrees")))
    return both.select("feature", "n_e", "n_a", "chi2", "degrees", chi2_p.alias("chi2_p_value"), "ks", ks_p_value(F.col("ks"), F.col("n_e"), F.col("n_a")).alias("ks_p_value"))


def _day_pairs(counts: DataFrame, last_days: int) -> DataFrame:
    """feature, day, before: the newest days, and of each the day before it that has rows."""
    by_day = Window.partitionBy("feature").orderBy("day")  # one row a day
    days = counts.select("feature", "day").distinct().withColumn("before", F.lag("day").over(by_day))
    newest = days.groupBy("feature").agg(F.max("day").alias("newest"))
    return days.join(newest, "feature").where((F.col("day") > F.date_sub("newest", last_days)) & F.col("before").isNotNull()).drop("newest")


def _shares_by_day(counts: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, day, bucket, n_e, n_a, e, a, all_e, all_a of each day (a) against the one before it (e)."""
    spine = pairs.join(F.broadcast(edges), "feature").select("feature", "day", "before", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    now = counts.withColumnRenamed("n", "n_a")
    then = counts.select("feature", F.col("day").alias("before"), "bucket", F.col("n").alias("n_e"))
    both = spine.join(now, ["feature", "day", "bucket"], "left").join(then, ["feature", "before", "bucket"], "left").fillna(0, ["n_a", "n_e"])
    whole = Window.partitionBy("feature", "day")
    shares = both.select("feature", "day", "bucket", F.sum("n_e").over(whole).alias("all_e"), F.sum("n_a").over(whole).alias("all_a"), "n_e", "n_a")
    return shares.withColumns({"e": F.coalesce(F.try_divide("n_e", "all_e"), F.lit(0.0)), "a": F.coalesce(F.try_divide("n_a", "all_a"), F.lit(0.0))})


def consecutive_drift(log: DataFrame, columns: list[str], edges: DataFrame, scored_at: str = "scored_at", last_days: int = 30) -> DataFrame:
    """feature, day, psi, js, chi2, tv, linf, ks, wasserstein of each day against the day before it that has rows.

    The newest ``last_days`` days are reported, the oldest of them too if an earlier day has rows.
    """
    rows = unpivoted(log.withColumn("day", F.to_date(scored_at)), columns, ["day"])
    counts = bucket_counts(rows, edges, ["day"])
    pairs = _day_pairs(counts, last_days)
    before = rows.withColumnRenamed("day", "before").join(pairs, ["feature", "before"]).select("feature", "day", "value")
    by_value = cdf_distances(before, rows.join(pairs.select("feature", "day"), ["feature", "day"]), ["feature", "day"])
    return distances(_shares_by_day(counts, pairs, edges), ["feature", "day"]).join(by_value, ["feature", "day"])


def consecutive_category_drift(log: DataFrame, columns: list[str], heavy: DataFrame | None = None, scored_at: str = "scored_at", last_days: int = 30) -> DataFrame:
    """feature, day, psi, js, chi2, tv, linf of each day's categories against those of the day before it that has rows.

    Categories are the values that are heavy in the whole log, or in ``heavy``; days are chosen as in ``consecutive_drift``.
    """
    rows = as_text(log.withColumn("day", F.to_date(scored_at)), columns, ["day"])
    heavy = heavy_values(rows.select("feature", "value")) if heavy is None else heavy
    counts = category_counts(rows, heavy, ["day"])
    return distances(_shares_by_day(counts, _day_pairs(counts, last_days), heavy), ["feature", "day"])
