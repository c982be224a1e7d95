import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import functions as F

from tidewell.functions import features
from tidewell.operators import abtest, contracts, drift, labels, lineage, lookup, quality, scoring
from tidewell.plans.registry import CUSTOMER_FEATURES
from tidewell.sources import tables
from tidewell.streaming import log as streams


def test_psi():
    psi = drift.psi_from_counts
    assert psi([100, 200, 300], [100, 200, 300]) == 0
    assert psi([10, 20, 70], [30, 30, 40]) == pytest.approx(psi([30, 30, 40], [10, 20, 70]))
    assert psi([], []) == 0 == psi([0, 0], [1, 1])
    assert 0 < psi([0, 100, 100], [50, 75, 75]) < math.inf
    with pytest.raises(ValueError):
        psi([1], [1, 2])


def test_drift_report_against_lists(spark):
    before = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit(None).cast("double").alias("gone"))
    live = spark.range(500).select((F.col("id") % 60).cast("double").alias("x"), F.lit(1.0).alias("gone"))
    out = drift.drift_report(before, live, ["x", "gone", "absent"], "t").collect()
    assert [r.feature for r in out] == ["x"]
    values = sorted(i % 97 for i in range(1000))
    edges = sorted({values[math.ceil(1000 * i / 10) - 1] for i in range(1, 10)})
    count = lambda vs: [sum(sum(v > e for e in edges) == b for v in vs) for b in range(len(edges) + 1)]
    assert out[0].psi == pytest.approx(drift.psi_from_counts(count([i % 60 for i in range(500)]), count(values)))
    decision = drift.retrain_decision(drift.drift_report(before, live, ["x"], "t")).first()
    assert decision.retrain_required and decision.worst_feature == "x" and decision.reason.startswith("x PSI=")
    empty = drift.retrain_decision(drift.drift_report(before, live, ["absent"], "t")).first()
    assert not empty.retrain_required and empty.reason == "no breach"


def test_z_test(spark):
    rows = spark.createDataFrame([(50.0, 100.0, 70.0, 100.0), (60.0, 100.0, 60.0, 100.0), (0.0, 0.0, 5.0, 10.0), (10.0, 10.0, 20.0, 20.0)], "a double, n double, b double, m double")
    diff, z = abtest.z_test(F.col("a"), F.col("n"), F.col("b"), F.col("m"))
    got = rows.select(diff.alias("d"), z.alias("z")).withColumn("p", abtest.two_sided_p(F.col("z"))).collect()
    expected = 0.2 / math.sqrt(0.6 * 0.4 * 0.02)
    assert got[0].z == pytest.approx(expected) and got[0].p == pytest.approx(math.erfc(expected / math.sqrt(2))) and got[0].p < 0.05
    assert got[1].z == 0 and got[1].p == 1
    assert got[2].z is None and got[3].z is None and got[3].p is None
    far = spark.createDataFrame([(x / 8,) for x in range(0, 90)], "x double").select("x", abtest.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) < 1e-13 for r in far)


def test_label_backfill(spark):
    log = spark.createDataFrame([(1, None), (2, 0.0), (3, None)], "customer_id long, ground_truth double")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, 1)], "customer_id long, is_default int")
    once = labels.backfill_labels(log, outcomes)
    assert sorted(map(tuple, once.collect())) == [(1, 1.0), (2, 0.0), (3, None)]
    assert sorted(map(tuple, labels.backfill_labels(once, outcomes).collect())) == sorted(map(tuple, once.collect()))
    cover = labels.label_coverage(once).first()
    assert (cover.total, cover.labelled, cover.unlabelled, cover.coverage) == (3, 2, 1, 0.6667)
    assert labels.label_coverage(log.limit(0)).first().coverage == 0.0


@pytest.mark.parametrize("stretch", [2, 3, 1000])
def test_point_in_time(spark, stretch):
    events = spark.createDataFrame([(1, 5), (1, 10), (2, 1), (None, 5)], "k long, t long")
    versions = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 11, "c"), (2, 2, "d"), (None, 1, "e")], "k long, at long, f string")
    got = lookup.point_in_time(events, versions, ["k"], "t", "at", ["f"], stretch)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (2, 1, None), (None, 5, None)], "k long, t long, f string").collect()))
    with pytest.raises(ValueError):
        lookup.point_in_time(events, versions, ["k"], "t", "at", ["t"])


def test_contracts(spark, tmp_path):
    assert contracts.clean_expression("sum(t.x) -- all\n * ${n}", {"n": "2"}) == "sum(t.x) * 2"
    with pytest.raises(ValueError):
        contracts.clean_expression("${missing}", {})
    rows = spark.sql("select 1L as customer_id, 10L as txn_id, timestamp'2001-12-30' as txn_ts, 5.0D as amount, true as is_refund")
    built = contracts.build_features(CUSTOMER_FEATURES, rows, "2002-01-01")
    assert built.schema["txn_count"].dataType.simpleString() == "int"
    assert tuple(built.drop("as_of_date").first()) == (1, 1, 5.0, 2, 0, 5.0)
    spine = spark.sql("select 1L as customer_id union all select 9L")
    assert {r.customer_id: r.days_since_last_txn for r in contracts.build_features(CUSTOMER_FEATURES, rows, "2002-01-01", spine=spine).collect()} == {1: 2, 9: 999}
    with pytest.raises(ValueError):
        contracts.pinned(built, CUSTOMER_FEATURES, [])
    bad = contracts.Contract("t", [contracts.Feature("k", "decimal")], "d", [contracts.Feature("x", "int")])
    assert contracts.problems(bad) == ["k: no type decimal", "x: no expression"]
    assert contracts.analysis_error(CUSTOMER_FEATURES, rows.drop("amount"), "2002-01-01")
    paths = contracts.publish_all(spark, [CUSTOMER_FEATURES], {"customer_features": rows}, "2002-01-01", str(tmp_path))
    assert spark.read.parquet(paths["customer_features"]).count() == 1
    checks = {r["check"]: r.n for r in contracts.key_problems(built.unionByName(built), CUSTOMER_FEATURES).collect()}
    assert checks == {"null customer_id": 0, "null as_of_date": 0, "duplicate keys": 1}


def test_expressions_leave_quoted_text_alone(spark):
    text = "count(case when t.note = 'a -- b  current_date() /* c */' then 1 end) -- current_date()"
    assert contracts.clean_expression(text, {}) == "count(case when t.note = 'a -- b  current_date() /* c */' then 1 end)"
    contract = contracts.Contract("t", [contracts.Feature("k", "int")], "d", [contracts.Feature("x", "string", "concat(max(t.note), ' current_date() ', current_date())")])
    rows = spark.createDataFrame([(1, "n")], "k int, note string")
    assert contracts.build_features(contract, rows, "2002-01-01").first().x == "n current_date() 2002-01-01"


def test_publish_merges(spark, tmp_path):
    make = lambda *names: contracts.Contract("t", [contracts.Feature("k", "bigint")], "d", [contracts.Feature(n, "int", "1") for n in names])
    rows = lambda text, names: spark.createDataFrame(text, "k long, d string, " + names).withColumn("d", F.col("d").cast("date"))
    path, stage = str(tmp_path / "t"), str(tmp_path / "s")
    read = lambda: sorted((r.k, str(r.d), *(r[c] for c in ("x", "y") if c in r)) for r in spark.read.parquet(path).collect())
    contracts.publish(make("x"), rows([(1, "2024-01-01", 1), (2, "2024-01-01", 2), (1, "2024-01-02", 3)], "x int"), path, stage)
    contracts.publish(make("x"), rows([(2, "2024-01-01", 9)], "x int"), path, stage)
    assert read() == [(1, "2024-01-01", 1), (1, "2024-01-02", 3), (2, "2024-01-01", 9)]
    contracts.publish(make("x", "y"), rows([(1, "2024-01-02", 4, 5)], "x int, y int"), path, stage)
    assert read() == [(1, "2024-01-01", 1, None), (1, "2024-01-02", 4, 5), (2, "2024-01-01", 9, None)]
    for bad in ([(1, "2024-01-03", 1, 1)] * 2, [(None, "2024-01-03", 1, 1)]):
        with pytest.raises(ValueError):
            contracts.publish(make("x", "y"), rows(bad, "x int, y int"), path, stage)
    assert len(read()) == 3


def test_consecutive_drift_keeps_the_oldest_day(spark):
    log = spark.range(400).select(F.timestamp_seconds(F.col("id") * 8640 + 1_704_067_200).alias("scored_at"), (F.col("id") % 13).cast("double").alias("x"))
    edges = drift.quantile_edges(drift.unpivoted(log, ["x"]))
    every = {r.day: r for r in drift.consecutive_drift(log, ["x"], edges, last_days=100).collect()}
    assert len(every) == 39
    last = {r.day: r for r in drift.consecutive_drift(log, ["x"], edges, last_days=30).collect()}
    assert len(last) == 30 and all(every[d] == r for d, r in last.items())


def test_profile_table_metrics(spark):
    rows = [(1.0, 1.0, "a"), (1.0, 0.0, "a"), (0.0, 1.0, None), (0.0, None, "b")]
    log = spark.createDataFrame(rows, "prediction double, ground_truth double, part string").withColumns({"scored_at": F.lit("2024-01-01 05:00:00").cast("timestamp"), "model_version": F.lit("v")})
    got = {(r.model, r.slice): r for r in drift.profile_table_metrics(log, by="part").collect()}
    assert set(got) == {(m, s) for m in ("v", "*") for s in ("a", "b", "unknown", "*")}
    whole = got["*", "*"]
    assert (whole.n, whole.n_labelled, whole.tp, whole.fp, whole.fn, whole.tn) == (4, 3, 1, 1, 1, 0) and whole.recall == 0.5
    assert got["v", "b"].accuracy is None


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k long, v string, w int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).select("k", "v", "w").collect())) == [(1, "a", None), (2, "c", 1), (3, "d", 2)]
    path = str(tmp_path / "log")
    tables.append(old, path)
    tables.append(new, path)
    assert tables.read_table(spark, path, merge_schema=True).where("w is null").count() == 2
    parts = str(tmp_path / "parts")
    day = lambda df, d: df.withColumn("d", F.lit(d))
    tables.overwrite(day(old, "x").unionByName(day(old, "y")), parts, ["d"])
    tables.upsert_partitions(spark, parts, day(new.drop("w"), "y"), ["k", "d"], "d", str(tmp_path / "stage"))
    assert sorted((r.d, r.k, r.v) for r in spark.read.parquet(parts).collect()) == [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a"), ("y", 2, "c"), ("y", 3, "d")]
    assert tables.duplicate_keys(old.unionByName(old), ["k"]).count() == 2
    assert tables.audit_row(spark, {"decision": "X"}, {"auc": 0.5}, "2024-01-01").first().evaluation_summary == '{"auc":0.5}'


def test_quality_and_gate(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    got = {r.metric: r.value for r in quality.quality_metrics(rows, "s", "y", 0.3).collect()}
    assert got["roc_auc"] == pytest.approx(3.5 / 4) and got["pr_auc"] == pytest.approx((1 + 2 / 3) / 2)
    assert got["recall"] == 1.0 and got["precision"] == pytest.approx(2 / 3)
    gated = quality.gate(quality.quality_metrics(rows, "s", "y"), [("roc_auc", 0.99, True), ("recall", 0.5, True), ("f9", 1, True)])
    assert {r.metric: r.status for r in gated.collect()} == {"roc_auc": "BREACH", "recall": "PASS", "f9": "WARNING"}
    with pytest.raises(quality.ThresholdBreach):
        quality.enforce(gated)
    assert len(quality.enforce(gated, "dry_run")) == 1 and quality.enforce(gated, "disabled") == []


def test_lineage(spark):
    changes = spark.createDataFrame([("t", "a", "removed"), ("t", "b", "added")], "change_table string, feature string, kind string")
    deps = spark.createDataFrame([("t", "one", ["a"]), ("t", "two", ["b"]), ("t", "all", None)], "dep_table string, name string, features array<string>")
    assert {r.name for r in lineage.downstream_breaks(changes, deps).collect()} == {"one", "all"}
    keys = spark.createDataFrame([("t", "k", "keys")], changes.schema)
    assert {r.name for r in lineage.downstream_breaks(keys, deps).collect()} == {"one", "two", "all"}


def test_scoring(spark):
    scored = spark.createDataFrame([(0.05,), (0.2999,), (0.30,), (0.91,), (None,)], "prediction double").withColumns({"customer_id": F.lit("c"), "duration": F.lit(3), "model_version": F.lit("1"), "scored_at": F.lit("2024-01-01").cast("timestamp")})
    log = scoring.inference_log(scored, features.MONITORED)
    assert [r.prediction for r in log.collect()] == [0.0, 0.0, 1.0, 1.0, None]
    assert "variant" not in log.columns and log.schema["ground_truth"].dataType.simpleString() == "double"
    rows = spark.range(400).select(F.col("id").alias("customer_id"), (F.col("id") % 7).cast("double").alias("f0"), (F.col("id") % 7 > 3).cast("int").alias("class"))
    model = scoring.train_classifier(rows, ["f0"], kind="logistic")
    arms = scoring.score_arms(rows, {"A": (model, "1"), "B": (model, "2")}, ["f0"], "customer_id", "s", 25, "2024-01-01")
    found = {r.variant: r["count"] for r in arms.groupBy("variant").count().collect()}
    assert sum(found.values()) == 400 and 0.15 < found["B"] / 400 < 0.35
    assert arms.groupBy("variant").agg(F.count_distinct("model_version").alias("n")).agg(F.max("n")).first()[0] == 1
    flat = scoring.train_classifier(rows.withColumn("f0", F.lit(1.0)), ["f0"], kind="logistic")
    mixed = scoring.score_arms(rows, {"A": (model, "1"), "B": (flat, "2")}, ["f0"], "customer_id", "s", 25, "2024-01-01")
    for arm, own in (("A", model), ("B", flat)):
        alone = scoring.score_batch(rows, own, ["f0"], "x", "2024-01-01").select("customer_id", F.col("prediction_score").alias("own"))
        assert mixed.where(F.col("variant") == arm).join(alone, "customer_id").where("abs(prediction_score - own) > 1e-12").count() == 0
    other = scoring.score_with(rows, lambda x: x["f0"] / 7, ["f0"], "p", "2024-01-01")
    assert other.where("prediction_score <> f0 / 7").count() == 0


def _credit_rows(spark, n):
    value = lambda i: F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1_000_003)) / 1_000_003
    rows = spark.range(n).select(F.col("id").alias("application_id"), *(value(i).alias(f"f{i}") for i in range(4)), value(9).alias("noise"))
    rows = rows.withColumn("f3", F.when(F.col("application_id") % 11 > 0, F.floor(F.col("f3") * 5)))
    return rows.withColumn("class", ((F.col("f0") * 2 + F.col("f1") * F.col("f2") + F.coalesce("f3", F.lit(2)) / 9 + F.col("noise") / 2) > 1.7).cast("int")).drop("noise")


def test_boosted_trees_are_those_of_spark(spark):
    """Rounds, stops and scores of pyspark.ml's trainer, where both take all rows for the candidate splits."""
    rows, names = _credit_rows(spark, 3000).cache(), ["f0", "f1", "f2", "f3"]
    model = scoring.train_classifier(rows, names)
    filled = [f"__{c}" for c in names]
    held = rows.withColumn("__held", F.pmod(F.xxhash64("application_id", F.lit(42)), F.lit(10)) == 0).withColumns({c: F.col(c).cast("double") for c in names})
    gbt = GBTClassifier(featuresCol="__features", labelCol="class", maxIter=200, stepSize=0.05, maxDepth=5, seed=42, validationIndicatorCol="__held")
    other = Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__features"), gbt]).fit(held)
    assert len(model.stages[-1].trees) == other.stages[-1].getNumTrees > 5
    a, b = (scoring.score_batch(rows, m, names, "v", "2024-01-01").select("application_id", F.col("prediction_score").alias(c)) for m, c in ((model, "a"), (other, "b")))
    assert a.join(b, "application_id").where("abs(a - b) > 1e-9").count() == 0


def test_boosting_does_not_depend_on_layout(spark):
    """Rows in one, seven or badly uneven partitions give the same trees; those of pyspark.ml's trainer differ beyond 10,000 rows."""
    rows, names = _credit_rows(spark, 15_000), ["f0", "f1", "f2", "f3"]
    models = [scoring.train_classifier(r, names, rounds=3) for r in (rows.coalesce(1), rows.repartition(7, "f3"))]
    sample = _credit_rows(spark, 500).cache()
    one, two = ([r.prediction_score for r in scoring.score_batch(sample, m, names, "v", "2024-01-01").orderBy("application_id").collect()] for m in models)
    assert one == pytest.approx(two, abs=1e-12) and len(set(one)) > 20
    dealt = scoring._dealt(_credit_rows(spark, 120_000).repartition(9, "f3"), ["application_id"])
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 1.05 * 40_000
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        scoring.train_classifier(sample.withColumn("class", F.lit(2)), names, rounds=2)


def test_streaming_profile(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600 + 1_704_067_200).alias("scored_at"), F.lit("v1").alias("model_version"), F.lit(0.5).alias("prediction_score"), F.lit(1.0).alias("prediction"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = streams.profile_stream(stream).writeStream.format("memory").queryName("profile").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.table("profile").collect()) == [4, 24, 24, 24, 24]
