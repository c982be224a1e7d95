"""Quantiles, blocks, tails, categories and profile states against plain Python."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import categories, drift, profile_state, quantiles, running, scoring, significance


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    rows = [("a", rng.lognormvariate(0, 3)) for _ in range(20_000)] + [("a", 1e15), ("a", math.nan), ("a", None)] + [("b", float(i % 7)) for i in range(1000)] + [("c", 5.0), ("d", math.nan)]
    return rows, spark.createDataFrame(rows, "feature string, value double").repartition(6)


@pytest.mark.parametrize(("k", "one_task"), [(8, 0), (200, 900), (4096, 0), (200, 10**6)])
def test_exact_quantiles(values, k, one_task):
    rows, df = values
    got = quantiles.exact_quantiles(df.where("value is not null"), 10, k, one_task)
    assert got.keys() == {"a", "b", "c"}
    for f, q in got.items():
        v = sorted(x for g, x in rows if g == f and x is not None and not math.isnan(x))
        assert q == [v[-(-i * len(v) // 10) - 1] for i in range(1, 10)]


def test_brackets_that_miss(values, monkeypatch):
    """With an error that is stated far too small the ranks are found all the same."""
    rows, df = values
    monkeypatch.setattr(quantiles, "rank_error", lambda k: 1e-9)
    v = sorted(x for g, x in rows if g == "a" and x is not None and not math.isnan(x))
    assert quantiles.exact_quantiles(df.where("value is not null"), 10, 8, 0)["a"] == [v[-(-i * len(v) // 10) - 1] for i in range(1, 10)]


def test_blocks_are_even_whatever_the_values(values):
    _, df = values
    one = df.where("feature = 'a' and value is not null and not isnan(value)").distinct()
    sizes = [r["count"] for r in running.blocked(one, ["feature"], "value").groupBy("__block").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 3 * sum(sizes) / len(sizes)
    got = {r.value: r for r in running.cumulative(one.withColumn("n", F.lit(2)), ["feature"], "value", ["n"]).collect()}
    ordered = sorted(got)
    assert all(got[v].cum_n == 2 * (i + 1) and got[v].next_value == (ordered[i + 1] if i + 1 < len(ordered) else None) for i, v in enumerate(ordered))


def test_tails(spark):
    rows = [(float(x), d) for d in (1, 2, 3, 4, 9, 10, 57, 300) for x in (0, 0.001, 0.5, 3, 9, 20, 60, 300)] + [(3.0, 0)]

    def tail(x, d):  # by the series of the lower function
        if x == 0:
            return 1.0
        a, h = d / 2, x / 2
        return 1 - sum(math.exp((a + n) * math.log(h) - h - math.lgamma(a + n + 1)) for n in range(2000))

    got = spark.createDataFrame(rows, "x double, d int").select("x", "d", significance.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect()
    assert all(r.p is None if r.d == 0 else abs(r.p - tail(r.x, r.d)) < 1e-9 for r in got)
    ks = spark.createDataFrame([(i / 40,) for i in range(160)], "x double").select("x", significance.kolmogorov_tail(F.col("x")).alias("p")).collect()
    for r in ks:
        want = 1.0 if r.x < 0.1 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * r.x) ** 2) for k in range(1, 300))
        assert r.p == pytest.approx(want, abs=1e-9)
    far = spark.range(1).select(significance.ks_p_value(F.lit(0.2), F.lit(0), F.lit(5)).alias("p")).first()
    assert far.p is None


def _categories(spark, weights, n, seed, more=()):
    rng = random.Random(seed)
    names = list(weights)
    rows = [(rng.choices(names, list(weights.values()))[0], f"id{seed}-{i}", rng.gauss(0, 1), i % 3 == 0) for i in range(n)]
    return rows, spark.createDataFrame([*rows, *more], "kind string, key string, x double, flag boolean").repartition(5)


def test_category_drift(spark):
    before, b = _categories(spark, {"red": 5, "grün": 3, "": 2}, 3000, 1, [(None, None, None, None)])
    now, a = _categories(spark, {"red": 4, "grün": 3, "": 2, "new": 1}, 2000, 2)
    out = {r.feature: r for r in drift.drift_metrics(b, a, ["kind", "key", "x", "flag"]).collect()}
    assert out.keys() == {"kind", "key", "x", "flag"} and out["kind"].ks is None and out["x"].ks is not None
    e, l = Counter(r[0] for r in before), Counter(r[0] for r in now)
    pairs = [(l[c], e[c]) for c in ("", "grün", "red")] + [(l["new"], 0)]
    assert out["kind"].psi == pytest.approx(drift.psi_from_counts(*map(list, zip(*pairs, strict=True))))
    assert out["kind"].tv == pytest.approx(sum(abs(x / 2000 - y / 3000) for x, y in pairs) / 2)
    assert out["key"].psi == 0 == out["key"].tv  # all its values are rare on both sides
    tests = {r.feature: r for r in drift.drift_tests(b, a, ["kind", "key", "x"]).collect()}
    assert tests["kind"].degrees == 2 and tests["kind"].chi2_p_value < 1e-3 and tests["key"].chi2_p_value is None and tests["x"].chi2_p_value > 1e-4 < tests["x"].ks_p_value
    alike = drift.drift_tests(b, b, ["x", "kind"]).collect()
    assert {(r.feature, r.chi2_p_value, r.ks_p_value) for r in alike} == {("x", 1.0, 1.0), ("kind", 1.0, None)}


def test_heavy_values_stay_few(spark):
    """Of a column with 200,000 values, two of them frequent, only those two come out, with any number of sketches merged."""
    df = spark.range(200_000).select(F.lit("k").alias("feature"), F.when(F.col("id") % 50 == 0, "much").when(F.col("id") % 101 == 0, "some").otherwise(F.col("id").cast("string")).alias("value")).repartition(9)
    (row,) = categories.heavy_values(df).collect()
    assert row.edges == ["much", "some"]
    counts = {r.bucket: r.n for r in categories.category_counts(df, categories.heavy_values(df)).collect()}
    some = sum(i % 101 == 0 and i % 50 > 0 for i in range(200_000))
    assert counts == {0: 4000, 1: some, 2: 196_000 - some}
    with pytest.raises(ValueError):
        categories.heavy_values(df, min_share=1e-6)
    assert categories.heavy_values(df.limit(0)).isEmpty()


LOG = "scored_at timestamp, model_version string, amount double, kind string"


def _log(n, days, seed):
    rng = random.Random(seed)
    return [(f"2024-01-{1 + i % days:02d} 10:00:00", "v1" if i % 4 else "v2", None if i % 17 == 0 else 1e9 + rng.gauss(0, 5), f"k{rng.randrange(900)}") for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "at string, model_version string, amount double, kind string").select(F.col("at").cast("timestamp").alias("scored_at"), "model_version", "amount", "kind").repartition(4)


def test_profile_states_merge(spark):
    rows = _log(30_000, 14, 3)
    states = profile_state.profile_states(_frame(spark, rows), ["amount", "kind"])
    out = [r for r in profile_state.read_profile(profile_state.windows(states, "28 days")).collect() if r.slice == "*"]
    for model in ("v1", "v2", "*"):
        by = {r.column: r for r in out if r.model == model}
        mine = [r for r in rows if model in ("*", r[1])]
        x = sorted(r[2] for r in mine if r[2] is not None)
        mean = sum(x) / len(x)
        a = by["amount"]
        assert (a.n, a.n_null, a.low, a.high) == (len(mine), len(mine) - len(x), x[0], x[-1])
        assert a["mean"] == pytest.approx(mean) and a.deviation == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)), rel=1e-6)
        for p, q in zip((0.25, 0.5, 0.75), a.quantiles, strict=True):
            assert abs(sum(v <= q for v in x) / len(x) - p) < 2 * quantiles.rank_error(profile_state.KLL_K)
        k = by["kind"]
        assert k["mean"] is None and k.quantiles is None and abs(k.distinct - len({r[3] for r in mine})) < 0.03 * 900


def test_three_refreshes_equal_a_whole_profile(spark, tmp_path):
    path, rows = f"{tmp_path}/profile", _log(4000, 9, 4)
    first, second = rows[:3000], [r for r in rows[3000:] if r[0] < "2024-01-04"]
    log = lambda *parts: _frame(spark, [r for p in parts for r in p])
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert len(profile_state.refresh_profile(path, log(first), ["amount", "kind"])) == 9
    old = files()
    assert profile_state.refresh_profile(path, log(first, second), ["amount", "kind"], log(second)) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert {f for f in old if "day=2024-01-01" not in f and "day=2024-01-02" not in f and "day=2024-01-03" not in f} == old.keys() & files().keys()
    late = [(a, m, 7.0 if x is None else x, k) for a, m, x, k in [*first, *second]]
    changed = [r for r, o in zip(late, [*first, *second], strict=True) if r != o]
    profile_state.refresh_profile(path, log(late), ["amount", "kind"], log(changed))
    assert profile_state.refresh_profile(path, log(late), ["amount", "kind"], log(changed).limit(0)) == []
    exact = ["day", "column", "model", "slice", "n", "n_null", "mean", "deviation", "low", "high"]
    read = lambda s: {str([round(v, 4) if isinstance(v, float) else v for v in r]) for r in profile_state.read_profile(s).select(*exact).collect()}
    got = read(spark.read.parquet(path))
    assert got == read(profile_state.profile_states(log(late), ["amount", "kind"])) and len(got) == 36


def test_text_columns_in_profiles(spark):
    log = _frame(spark, _log(200, 2, 5))
    out = {(r.column, r.model): r for r in drift.profile_metrics(log, ["amount", "kind"]).where("slice = '*' and window_start = timestamp_ntz'2024-01-01'").collect()}
    assert out["kind", "*"].n == 100 and out["kind", "*"].n_null == 0 and out["kind", "*"]["mean"] is None
    shares = drift.category_profile(log, ["kind", "model_version"]).where("slice = '*' and model = '*'").groupBy("window_start", "column").agg(F.sum("share").alias("s"), F.sum("n").alias("n")).collect()
    assert len(shares) == 4 and all(r.s == pytest.approx(1) and r.n == 100 for r in shares)


def test_exact_split(spark):
    rows = [(f"k{i % 950}", ["a", "b", None][(i % 10 > 6) + (i % 10 > 8)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, label string").repartition(4)
    out = scoring.exact_split(df, "label", "key").collect()
    for label, n in Counter(r[1] for r in rows).items():
        assert sum(r.split == "test" for r in out if r.label == label) == (20 * n + 50) // 100
    assert Counter((r.key, r.label) for r in out) == Counter(rows)
    assert sorted(map(str, out)) == sorted(map(str, scoring.exact_split(df.repartition(2), "label", "key").collect()))
    assert all(r.split == "train" for r in scoring.exact_split(df.limit(2), "label", "key").collect())
    assert {r.split for r in scoring.exact_split(df, "label", "key", 100).collect()} == {"test"} and scoring.exact_split(df.limit(0), "label", "key").isEmpty()
