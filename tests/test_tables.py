"""Commits, change feeds, stored backfill, batches and contract publication, with losses midway."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidewell.operators import contracts, labels
from tidewell.plans import registry
from tidewell.sources import commits, files, tables

SCHEMA = "k long, day date, x double, s string"


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "k long, day string, x double, s string").withColumn("day", F.col("day").cast("date"))


def _set(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _stamps(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


FIRST = [(1, "2024-01-01", 1.0, "a"), (2, "2024-01-01", None, "b"), (3, "2024-01-02", 3.0, None)]
SECOND = [(1, "2024-01-01", 1.0, "a"), (2, "2024-01-01", None, "c"), (4, "2024-01-01", 4.0, "d")]


def test_change_set(spark):
    out = {(r.k, r._change_type): r for r in commits.change_set(_rows(spark, *FIRST), _rows(spark, *SECOND), ["k"], 7).collect()}
    assert out.keys() == {(2, "update_preimage"), (2, "update_postimage"), (3, "delete"), (4, "insert")}
    assert out[2, "update_preimage"].s == "b" and out[2, "update_postimage"].s == "c" and out[3, "delete"].x == 3.0 and out[4, "insert"]._version == 7
    assert commits.change_set(_rows(spark, *FIRST), _rows(spark, *FIRST), ["k"], 1).isEmpty()


def test_commits_and_replay(spark, tmp_path):
    path, keys = f"{tmp_path}/t", ["k", "day"]
    assert commits.commit(_rows(spark, *FIRST), path, "day", keys, whole=True) == 1
    assert commits.commit(_rows(spark, *SECOND), path, "day", keys) == 2  # the partition of 2024-01-02 stays
    more = _rows(spark, (9, "2024-01-03", 9.0, "i")).withColumn("new", F.lit(1))
    assert commits.commit(tables.upsert(spark.read.parquet(path), more, keys), path, "day", keys, whole=True) == 3
    changes = commits.read_changes(spark, path)
    assert _set(commits.replay(changes, keys)) == _set(spark.read.parquet(path))
    assert _set(commits.replay(commits.read_changes(spark, path, last=2), keys)) == _set(_rows(spark, FIRST[2], *SECOND).withColumn("new", F.lit(None).cast("int")).drop("new"))
    assert {r._version for r in commits.read_changes(spark, path, 2, 2).collect()} == {2}
    assert commits.versions(spark, path) == [1, 2, 3] and not any("rows" in d for d, _, _ in os.walk(f"{path}.commits"))


@pytest.mark.parametrize("whole", [False, True])
def test_losses_midway(spark, tmp_path, whole):
    path, keys = f"{tmp_path}/t", ["k", "day"]
    commits.commit(_rows(spark, *FIRST), path, "day", keys, whole=True)
    at = commits.stage(_rows(spark, *SECOND), path, "day", keys, whole)
    # Lost after it was ready, with half of the table gone: the next one to come carries it out.
    files.delete(spark, f"{path}/day=2024-01-01")
    assert commits.recover(spark, path, "day") == [2] and commits.recover(spark, path, "day") == []
    assert _set(spark.read.parquet(path)) == _set(_rows(spark, *(SECOND if whole else [*SECOND, FIRST[2]])))
    assert _set(commits.replay(commits.read_changes(spark, path), keys)) == _set(spark.read.parquet(path))
    # Lost before it was ready: as if it had never begun.
    before = _stamps(path)
    at = commits.stage(_rows(spark, (8, "2024-01-01", 8.0, "h")), path, "day", keys)
    files.delete(spark, f"{at}/ready")
    assert commits.recover(spark, path, "day") == [] and _stamps(path) == before and commits.versions(spark, path) == [1, 2]


def test_stored_backfill(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = spark.createDataFrame([(i, i % 5, f"2024-01-0{1 + i % 4}", float(i % 2) if i % 4 == 1 else None) for i in range(40)], "event_id long, customer_id long, day string, ground_truth double")
    log.write.partitionBy("day").parquet(path)
    outcomes = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "customer_id long, is_default int")
    old = _stamps(path)
    done = labels.backfill_stored(spark, path, outcomes.where("customer_id = 0"), "day", ["event_id"])
    assert done == ["2024-01-01", "2024-01-03", "2024-01-04"]
    left = {f: t for f, t in _stamps(path).items() if "day=2024-01-02" in f}
    assert left == {f: t for f, t in old.items() if "day=2024-01-02" in f} and not (_stamps(path).items() - left.items()) & old.items()
    labels.backfill_stored(spark, path, outcomes, "day", ["event_id"])
    stored = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    assert _set(stored) == _set(labels.backfill_labels(log, outcomes))
    stamps = _stamps(path)
    assert labels.backfill_stored(spark, path, outcomes, "day", ["event_id"]) == [] and _stamps(path) == stamps
    kinds = {(r._version, r._change_type) for r in commits.read_changes(spark, path).collect()}
    assert kinds == {(v, c) for v in (1, 2) for c in ("update_preimage", "update_postimage")}
    plan = spark.read.parquet(path).where(F.col("day").isin([F.lit("2024-01-01").cast("date")]))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)


def test_batches_come_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.append_batch(_rows(spark, *FIRST), path, "one")
    tables.append_batch(_rows(spark, *SECOND).withColumn("more", F.lit(1)), path, "two")
    once = _set(tables.read_table(spark, path, merge_schema=True))
    tables.append_batch(_rows(spark, *SECOND).withColumn("more", F.lit(1)), path, "two")
    tables.append_batch(_rows(spark, *SECOND).limit(0), path, "three")
    assert _set(tables.read_table(spark, path, merge_schema=True)) == once and len(once) == 6


def test_batches_of_a_stream(spark, tmp_path):
    source, sink = f"{tmp_path}/in", tables.batch_sink(f"{tmp_path}/log", "scores")
    _rows(spark, *FIRST).write.parquet(source)
    run = lambda: spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    sink(_rows(spark, *FIRST), 0)  # the batch is tried again after a loss
    _rows(spark, *SECOND).write.mode("append").parquet(source)
    run()
    assert {(r.batch_id, r.n) for r in spark.read.parquet(f"{tmp_path}/log").groupBy("batch_id").agg(F.count("*").alias("n")).collect()} == {("scores-0", 3), ("scores-1", 3)}


def _contract(**more):
    return contracts.Contract("t", [contracts.Feature("k", "bigint")], "as_of", [contracts.Feature("n", "int", "count(t.x)"), contracts.Feature("top", "double", "max(t.x)")], **more)


def test_rows_are_built_once(spark, tmp_path):
    """What is published is evaluated once for the checks and the write; nulls and duplicates are told with their counts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(k):
        seen.add(1)
        return k

    built = _rows(spark, *FIRST).select(watched("k").alias("k"), F.lit("2024-01-01").cast("date").alias("as_of"), F.lit(1).alias("n"), F.col("x").alias("top"))
    contracts.publish(_contract(), built, f"{tmp_path}/t")
    assert seen.value == 3 and spark.read.parquet(f"{tmp_path}/t").count() == 3
    bad = _rows(spark, *FIRST, *FIRST, (None, None, None, None)).select("k", F.col("day").alias("as_of"), F.lit(1).alias("n"), F.col("x").alias("top"))
    with pytest.raises(ValueError, match="null k: 1; null as_of: 1; duplicate keys: 3"):
        contracts.publish(_contract(), bad, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3 and not os.path.exists(f"{tmp_path}/t.built")


def test_contracts_with_one_source_share_its_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    source = _rows(spark, *FIRST, *SECOND).withColumn("x", watched("x"))
    other = contracts.Contract("u", [contracts.Feature("k", "bigint")], "until", [contracts.Feature("n", "bigint", "count_if(t.x > 1)")])
    paths = contracts.publish_all(spark, [_contract(), other], {"t": source, "u": source}, "2024-02-01", str(tmp_path))
    assert seen.value == 6
    assert _set(spark.read.parquet(paths["t"]).select("k", "n", "top")) == _set(source.groupBy("k").agg(F.count("x").cast("int").alias("n"), F.max("x").alias("top")))
    assert {(r.k, r.n, str(r.until)) for r in spark.read.parquet(paths["u"]).collect()} == {(k, n, "2024-02-01") for k, n in ((1, 0), (2, 0), (3, 1), (4, 1))}
    broken = contracts.Contract("v", [contracts.Feature("k", "bigint")], "until", [contracts.Feature("n", "bigint", "raise_error('no')")])
    with pytest.raises(ValueError, match="v: "):
        contracts.publish_all(spark, [broken, other], {"v": source.select("*"), "u": source}, "2024-03-01", str(tmp_path))


def test_skeletons(spark, tmp_path):
    folder = tmp_path / "features"
    folder.mkdir()
    (folder / "t.yaml").write_text("table: t\nkeys: [{name: k, type: bigint}]\ntimestamp_key: as_of\nsources: {least: '1'}\nfeatures: [{name: n, type: int}, {name: said, type: string}]\n")
    (folder / "n.sql").write_text("count(a.x) -- rows\n")
    (folder / "said.sql").write_text("max('{${least}} -- ' || b.s)")
    (folder / "_base.sql").write_text("-- ${nothing} of this counts\nSELECT a.k, current_date() AS as_of, ${features}\nFROM ${left} a JOIN ${right} b ON a.k = b.k WHERE a.k > ${least} AND '{x}' <> 'current_date()' GROUP BY a.k")
    contract = contracts.load_contract(str(folder))
    frames = {"left": _rows(spark, *FIRST), "right": _rows(spark, *SECOND)}
    out = contracts.build_from_skeleton(contract, frames, "2024-02-01")
    assert [tuple(map(str, r)) for r in out.collect()] == [("2", "2024-02-01", "0", "{1} -- c")] and out.columns == ["k", "as_of", "n", "said"]
    assert contracts.analysis_error(contract, frames, "2024-02-01") is None and contracts.analysis_error(contract, {"left": frames["left"]}, "2024-02-01") == "no value for ${right}"
    for wrong in ("SELECT 1", "SELECT a.k, ${features} FROM ${left} a JOIN ${right} b ON a.k = b.k GROUP BY a.k"):
        contract.skeleton = wrong
        assert contracts.analysis_error(contract, frames, "2024-02-01")


def test_two_runs_are_built_once(spark):
    """The runs that publications and upserts use are read from one written table, not joined again at each use."""
    old, new = registry._two_runs(spark, "/root/testdata/sf0.001")
    assert old.columns == new.columns == ["customer_id", "as_of_date", *(f.name for f in registry.CUSTOMER_FEATURES.features)]
    assert len(set(old.inputFiles()) | set(new.inputFiles())) and set(old.inputFiles()) == set(new.inputFiles())
    assert not any("lineitem" in f for f in [*old.inputFiles(), *new.inputFiles()])
    rows = registry.shape(spark, "/root/testdata/sf0.001", "transactions")
    want = registry.contracts.build_features(registry.CUSTOMER_FEATURES, rows.where("txn_ts < timestamp '1998-06-01'"), registry.AS_OF)
    assert _set(registry._even(old)) == _set(registry._even(want))
    want = registry.contracts.build_features(registry.CUSTOMER_FEATURES, rows, registry.AS_OF).where("days_since_last_txn < 400")
    assert _set(registry._even(new)) == _set(registry._even(want))
