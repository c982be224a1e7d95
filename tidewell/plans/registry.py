"""Every registered query of the library's own operators, and DuckDB SQL with the same result.

The inputs are the shapes of ``sources.adapters`` over the whole tables. Floating sums depend on their order,
so both sides round them alike.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cohorts, features, policy
from ..operators import abtest, contracts, decisions, drift, labels, lineage, lookup, profile_state, quality, scoring
from ..sources import commits, tables
from ..sources.adapters import shape, shape_sql

AS_OF = "2002-01-01"
SCORED_AT = "2024-02-01 00:00:00"
DRIFT_FROM = "2000-01-01"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; its SQL may use the named shapes as tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            shapes = ", ".join(f"{n} as ({shape_sql(n)})" for n in uses.split())
            text = sql.strip()
            if shapes:
                text = f"with {shapes}, {text[5:]}" if text.lower().startswith("with ") else f"with {shapes} {text}"
            ORACLES[f.__name__] = text
        return f

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: The rounding of decimal text, as Spark rounds.
_R2 = "cast(round(cast(cast({0} as varchar) as decimal(38, 18)), 2) as double)"

CUSTOMER_FEATURES = contracts.Contract(
    table="customer_features",
    keys=[contracts.Feature("customer_id", "bigint")],
    timestamp_key="as_of_date",
    timestamp_column="txn_ts",
    max_age_hours=192,
    features=[
        contracts.Feature("txn_count", "int", "count(t.txn_id)"),
        contracts.Feature("txn_amount_sum", "double", "coalesce(sum(t.amount), 0)"),
        contracts.Feature("days_since_last_txn", "int", "coalesce(datediff(current_date(), max(to_date(t.txn_ts))), 999) -- 999 without any"),
        contracts.Feature("purchase_count", "int", "count(CASE WHEN NOT t.is_refund THEN t.txn_id END)"),
        contracts.Feature("txn_amount_avg", "double", "avg(t.amount)"),
    ],
)


def _even(built: DataFrame) -> DataFrame:
    """Sums to 4 places, which all amounts have, and averages to whole amounts: coarser than the noise of sums in another order."""
    return built.withColumns({"txn_amount_sum": F.round("txn_amount_sum", 4), "txn_amount_avg": F.round("txn_amount_avg", 0)})


def _features_at(spark: SparkSession, sf_dir: str, as_of: str, **options) -> DataFrame:
    built = contracts.build_features(CUSTOMER_FEATURES, shape(spark, sf_dir, "transactions"), as_of, **options)
    return _even(built)


_FEATURES_SQL = """
    select customer_id, date '{as_of}' as as_of_date, cast(count(txn_id) as int) as txn_count,
        round(coalesce(sum(amount), 0), 4) as txn_amount_sum,
        cast(coalesce(datediff('day', max(cast(txn_ts as date)), date '{as_of}'), 999) as int) as days_since_last_txn,
        cast(count(case when not is_refund then txn_id end) as int) as purchase_count, round(avg(amount), 0) as txn_amount_avg
    from transactions {where} group by customer_id"""


@query(_FEATURES_SQL.format(as_of=AS_OF, where=""), "transactions")
def contract_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_at(spark, sf_dir, AS_OF)


@query(_FEATURES_SQL.format(as_of="1998-06-01", where="where txn_ts < timestamp '1998-06-01'"), "transactions")
def features_strictly_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_at(spark, sf_dir, "1998-06-01", strictly_before=True)


@query(
    """select c_custkey as customer_id, cast(count(txn_id) as int) as txn_count,
        cast(coalesce(datediff('day', max(cast(txn_ts as date)), date '2002-01-01'), 999) as int) as days_since_last_txn
    from customer left join transactions on customer_id = c_custkey group by c_custkey""",
    "transactions",
)
def features_on_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("customer_id"))
    built = _features_at(spark, sf_dir, AS_OF, spine=spine)
    return contracts.pinned(built, CUSTOMER_FEATURES, ["txn_count", "days_since_last_txn"]).drop("as_of_date")


_UPSERT_SQL = f"""
    with old as ({_FEATURES_SQL.format(as_of=AS_OF, where="where txn_ts < timestamp '1998-06-01'")}),
    new as (select * from ({_FEATURES_SQL.format(as_of=AS_OF, where="")}) where days_since_last_txn < 400)
    select * from new union all select * from old where customer_id not in (select customer_id from new)"""


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A first table from all customers' older transactions, and a later one of those who bought lately.

    Both come from one join and one aggregation, with the run as a further key, and are written once: publications and
    upserts read their rows several times.
    """
    rows = shape(spark, sf_dir, "transactions")
    runs = F.when(F.col("txn_ts") < F.lit("1998-06-01").cast("timestamp"), F.array(F.lit("old"), F.lit("new"))).otherwise(F.array(F.lit("new")))
    by_run = dataclasses.replace(CUSTOMER_FEATURES, keys=[*CUSTOMER_FEATURES.keys, contracts.Feature("run", "string")])
    built = contracts.build_features(by_run, rows.withColumn("run", F.explode(runs)), AS_OF).where("run = 'old' or days_since_last_txn < 400")
    path = tables.shared_path(spark, "two_runs")
    tables.overwrite(built, path)
    held = spark.read.schema(built.schema).parquet(path)
    return tuple(held.where(F.col("run") == run).drop("run") for run in ("old", "new"))


@query(_UPSERT_SQL, "transactions")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(tables.upsert(*_two_runs(spark, sf_dir), CUSTOMER_FEATURES.key_names()))


@query(_UPSERT_SQL, "transactions")
def publish_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by two publications; the second has fewer customers, and the first table lacks a column."""
    path = tables.shared_path(spark, "customer_features")
    old, new = _two_runs(spark, sf_dir)
    first = dataclasses.replace(CUSTOMER_FEATURES, features=CUSTOMER_FEATURES.features[:-1])
    contracts.publish(first, old.drop("txn_amount_avg"), path)
    contracts.publish(CUSTOMER_FEATURES, new, path)  # adds the column
    contracts.publish(CUSTOMER_FEATURES, old.join(new, "customer_id", "left_anti"), path)
    return _even(spark.read.parquet(path))


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The path of a table after two publications."""
    path = tables.shared_path(spark, "customer_features")
    for rows in _two_runs(spark, sf_dir):
        contracts.publish(CUSTOMER_FEATURES, rows, path)
    return path


@query(
    f"""with old as ({_FEATURES_SQL.format(as_of=AS_OF, where="where txn_ts < timestamp '1998-06-01'")}),
    new as (select * from ({_FEATURES_SQL.format(as_of=AS_OF, where="")}) where days_since_last_txn < 400)
    select *, 'insert' as _change_type, cast(1 as bigint) as _version from old
    union all select *, 'insert', 2 from new where customer_id not in (select customer_id from old)
    union all select *, 'update_preimage', 2 from old where customer_id in (select customer_id from new)
    union all select *, 'update_postimage', 2 from new where customer_id in (select customer_id from old)""",
    "transactions",
)
def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two publications changed, row by row."""
    return _even(commits.read_changes(spark, _published(spark, sf_dir)))


@query(_UPSERT_SQL, "transactions")
def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table again, from its changes alone."""
    return _even(commits.replay(commits.read_changes(spark, _published(spark, sf_dir)), CUSTOMER_FEATURES.key_names()))


SEGMENT_FEATURES = contracts.Contract(
    table="customer_segments",
    keys=[contracts.Feature("customer_id", "bigint")],
    timestamp_key="as_of_date",
    features=[
        contracts.Feature("txn_count", "int", "count(t.txn_id) -- 0 for customers without any"),
        contracts.Feature("refund_share", "double", "round(avg(CASE WHEN t.is_refund THEN 1D ELSE 0D END), 6)"),
        contracts.Feature("segment", "string", "max(c.c_mktsegment)"),
        contracts.Feature("days_since_last_txn", "int", "datediff(current_date(), max(to_date(t.txn_ts)))"),
    ],
    sources={"least_balance": "0"},
    skeleton="""
        -- every customer above a balance, with or without transactions; /* ${features} is one row a customer */
        SELECT c.c_custkey AS customer_id, current_date() AS as_of_date, ${features}
        FROM ${customers} c LEFT JOIN ${transactions} t ON t.customer_id = c.c_custkey
        WHERE c.c_acctbal > ${least_balance} GROUP BY c.c_custkey""",
)


@query(
    f"""select c_custkey as customer_id, date '{AS_OF}' as as_of_date, cast(count(txn_id) as int) as txn_count, round(avg(case when is_refund then 1.0 else 0.0 end), 6) as refund_share,
        max(c_mktsegment) as segment, cast(datediff('day', max(cast(txn_ts as date)), date '{AS_OF}') as int) as days_since_last_txn
    from customer left join transactions on customer_id = c_custkey where c_acctbal > 0 group by c_custkey""",
    "transactions",
)
def skeleton_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract whose query joins two tables and filters."""
    frames = {"transactions": shape(spark, sf_dir, "transactions"), "customers": spark.read.parquet(f"{sf_dir}/customer.parquet")}
    return contracts.build_from_skeleton(SEGMENT_FEATURES, frames, AS_OF)


@query(
    f"""with a as ({_FEATURES_SQL.format(as_of=AS_OF, where="")}), b as (select customer_id, round(max(amount), 4) as largest, cast(count(*) filter (where is_refund) as int) as refunds from transactions group by customer_id)
    select a.*, largest, refunds from a join b using (customer_id)""",
    "transactions",
)
def publish_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contracts over one source, published side by side from one aggregation."""
    more = dataclasses.replace(CUSTOMER_FEATURES, table="customer_extremes", features=[contracts.Feature("largest", "double", "round(max(t.amount), 4)"), contracts.Feature("refunds", "int", "count(CASE WHEN t.is_refund THEN 1 END)")])
    rows = shape(spark, sf_dir, "transactions")
    paths = contracts.publish_all(spark, [CUSTOMER_FEATURES, more], {"customer_features": rows, "customer_extremes": rows}, AS_OF, tables.shared_path(spark, "published"))
    return _even(spark.read.parquet(paths["customer_features"])).join(spark.read.parquet(paths["customer_extremes"]), ["customer_id", "as_of_date"])


@query(
    """select o_custkey as customer_id, o_orderkey as txn_count, cast(null as double) as score from orders where o_orderdate < timestamp '1998-01-01'
    union all select o_custkey, o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1998-01-01'"""
)
def append_with_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.shared_path(spark, "appended")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("txn_count"), "o_totalprice", "o_orderdate")
    before = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    tables.overwrite(rows.where(before).select("customer_id", "txn_count"), path)
    tables.append(rows.where(~before).select("customer_id", "txn_count", F.col("o_totalprice").alias("score")), path)
    return tables.read_table(spark, path, merge_schema=True)


@query("select c_custkey as customer_id, c_acctbal as balance, cast(2 as int) as snapshot_version from customer")
def snapshot_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two numbered snapshots, read by its number; the first has other rows."""
    root = tables.shared_path(spark, "snapshots")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"))
    tables.write_version(rows.where("balance > 0"), root, 1)
    return tables.read_table(spark, tables.write_version(rows, root, 2))


@query("select 'good' as contract, true as passes, count(*) as source_rows from transactions union all select 'wrong column', false, count(*) from transactions", "transactions")
def contract_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analyser says of two contracts before anything is built."""
    rows = shape(spark, sf_dir, "transactions")
    wrong = dataclasses.replace(CUSTOMER_FEATURES, features=[contracts.Feature("n", "int", "count(t.no_such_column)")])
    said = [(n, contracts.analysis_error(c, rows, AS_OF) is None) for n, c in (("good", CUSTOMER_FEATURES), ("wrong column", wrong))]
    return spark.createDataFrame(said, "contract string, passes boolean").join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("source_rows"))))


@query("select o_custkey as customer_id, o_orderkey as txn_count, cast(null as double) as score from orders")
def schema_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    have = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("CUSTOMER_ID"), F.col("o_orderkey").alias("Txn_Count"), F.col("o_totalprice").alias("dropped"))
    wanted = T.StructType([T.StructField("txn_count", T.LongType()), T.StructField("score", T.DoubleType())])
    return tables.sync_schema(have, wanted, ["customer_id"])


_R = _R2.format
_CREDIT_SQL = f"""
    select application_id,
        case when duration is null or duration <= 0 then 0.0 else {_R("credit_amount / duration")} end as monthly_instalment,
        case when age is null or age <= 0 then 0.0 else {_R("credit_amount / age")} end as credit_to_age_ratio,
        coalesce(installment_commitment, 0) * coalesce(existing_credits, 1) as total_obligation_load,
        case when coalesce(existing_credits, 0) > 1 then 1 else 0 end as has_multiple_credits,
        {_R("cast(coalesce(num_dependents, 0) as double) / greatest(coalesce(existing_credits, 1), 1)")} as dependents_per_credit,
        case when coalesce(residence_since, 0) < 2 then 'TRANSIENT' when residence_since < 4 then 'SETTLING' else 'STABLE' end as residence_band,
        case when age < 25 then 'YOUNG' when age < 40 then 'PRIME' when age < 60 then 'MATURE' else 'SENIOR' end as age_band
    from applicants"""


@query(_CREDIT_SQL, "applicants")
def credit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.compute_features(shape(spark, sf_dir, "applicants")).select("application_id", *features.DERIVED, *features.BANDS)


@query(
    f"""with f as ({_CREDIT_SQL}) select 'installment_commitment' as "column", count(*) filter (where installment_commitment is null) as n_null from applicants
    union all select 'monthly_instalment', count(*) filter (where monthly_instalment is null) from f
    union all select 'age_band', count(*) filter (where age_band is null) from f""",
    "applicants",
)
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.compute_features(shape(spark, sf_dir, "applicants"))
    return features.null_audit(rows, ["installment_commitment", "monthly_instalment", "age_band"])


@query("select application_id, cast(dense_rank() over (order by channel) - 1 as int) as channel_code, cast(kyc_status = 'PENDING' as int) as is_pending from applicants", "applicants")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = features.label_encode(shape(spark, sf_dir, "applicants"), "channel", "channel_code")
    return coded.select("application_id", "channel_code", features.bad_label("kyc_status", "PENDING").alias("is_pending"))


@query("select event_id, make_timestamp(cast(ceil(epoch_us(ts) / 900000000.0) as bigint) * 900000000) as slot from events")
def ceil_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", features.ceil_timestamp("ts", 15).alias("slot"))


_POLICY_SQL = """
    select *, risk_band in ('BAND_A_LOW_RISK', 'BAND_B_MEDIUM_RISK', 'BAND_C_HIGH_RISK') as is_eligible,
        case risk_band when 'BAND_A_LOW_RISK' then least(credit_amount * 2.0, 1000000.0) when 'BAND_B_MEDIUM_RISK' then least(credit_amount, 500000.0)
            when 'BAND_C_HIGH_RISK' then least(credit_amount * 0.5, 100000.0) else 0.0 end as recommended_limit,
        case when risk_band = 'REJECTED' and upper(kyc_status) <> 'VERIFIED' then 'KYC_NOT_VERIFIED' when risk_band = 'REJECTED' then 'UNDERAGE'
            when risk_band = 'BAND_D_EXCESSIVE_RISK' then 'PD_EXCEEDS_THRESHOLD' else 'NONE' end as rejection_reason
    from (select *, case when upper(kyc_status) <> 'VERIFIED' or age < 18 then 'REJECTED' when prediction <= 0.10 then 'BAND_A_LOW_RISK'
        when prediction <= 0.25 then 'BAND_B_MEDIUM_RISK' when prediction <= 0.50 then 'BAND_C_HIGH_RISK' else 'BAND_D_EXCESSIVE_RISK' end as risk_band from applicants)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.apply_policy(shape(spark, sf_dir, "applicants"), SCORED_AT)


_DECISION_COLUMNS = ["application_id", "is_eligible", "risk_band", "rejection_reason", "recommended_limit"]


@query(f"select {', '.join(_DECISION_COLUMNS)} from ({_POLICY_SQL})", "applicants")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select(*_DECISION_COLUMNS)


@query(f"select {', '.join(_DECISION_COLUMNS)} from ({_POLICY_SQL})", "applicants")
def policy_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy.register_policy_functions(spark)
    rows = shape(spark, sf_dir, "applicants").withColumn("v", F.expr("credit_eligibility(prediction, age, kyc_status)"))
    return rows.select("application_id", F.col("v.eligible").alias("is_eligible"), "v.risk_band", "v.rejection_reason", F.expr("credit_limit(v.risk_band, credit_amount)").alias("recommended_limit"))


@query(
    f"""with d as ({_POLICY_SQL}) select channel, risk_band, count(*) as applicants, round(avg(prediction), 4) as avg_pd, round(avg(recommended_limit), 0) as avg_limit
    from d group by channel, risk_band""",
    "applicants",
)
def decision_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_mix(_decided(spark, sf_dir), ["channel"])


@query(
    f"with d as ({_POLICY_SQL}) select channel, count(*) as n, round(avg(cast(is_eligible as double)), 6) as approval_rate from d group by channel",
    "applicants",
)
def approval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(decisions.approval_rate(_decided(spark, sf_dir), ["channel"]))


@query(f"with d as ({_POLICY_SQL}) select rejection_reason, count(*) as n from d where not is_eligible group by rejection_reason", "applicants")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.rejection_reasons(_decided(spark, sf_dir))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: eight shifts a byte."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))"
    own = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {own}), lambda c, b: {bits}), cast(4294967295 as bigint))"


_COHORT_SQL = "select {key}, cast({crc} % 100 as int) as bucket, case when {crc} % 100 < 25 then 'B' else 'A' end as variant from {table}"


@query(_COHORT_SQL.format(key="c_custkey as customer_id", crc=crc32_sql("('exp1:' || c_custkey)"), table="customer"))
def cohort_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("customer_id"))
    return rows.select("customer_id", cohorts.cohort_bucket("customer_id", "exp1").alias("bucket"), cohorts.cohort("customer_id", "exp1", 25).alias("variant"))


@query(f"select * exclude (class), date '{AS_OF}' as batch_date from applicants where {crc32_sql("('sample 42:' || application_id)")} % 1000000 < 200000", "applicants")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "applicants").where(cohorts.sampled("application_id", 0.2))
    return rows.drop("class").withColumn("batch_date", F.lit(AS_OF).cast("date"))


_LOG_SQL = f"""select customer_id, duration, credit_amount, age, installment_commitment, monthly_instalment, credit_to_age_ratio, cast(case when prediction >= 0.30 then 1 else 0 end as double) as prediction,
    prediction as prediction_score, 'v1' as model_version, cast(null as double) as ground_truth from applicants join ({_CREDIT_SQL}) using (application_id)"""


@query(_LOG_SQL, "applicants")
def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = features.compute_features(shape(spark, sf_dir, "applicants")).withColumns({"model_version": F.lit("v1"), "scored_at": F.lit(SCORED_AT).cast("timestamp")})
    return scoring.inference_log(scored, features.MONITORED).drop("scored_at")


@query("select model_version, count(*) as rows, round(avg(prediction_score), 4) as mean_pd, round(min(prediction_score), 4) as min_pd, round(max(prediction_score), 4) as max_pd from scored_log group by model_version", "scored_log")
def scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.run_summary(shape(spark, sf_dir, "scored_log"), "prediction_score", ["model_version"])


_LABELLED = "labelled as (select l.* exclude (ground_truth), cast(o.is_default as double) as ground_truth from scored_log l left join outcomes o using (customer_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.backfill_labels(shape(spark, sf_dir, "scored_log"), shape(spark, sf_dir, "outcomes"))


@query(f"with {_LABELLED} select event_id, customer_id, prediction, ground_truth from labelled", "scored_log outcomes")
def label_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("event_id", "customer_id", "prediction", "ground_truth")


@query(f"with {_LABELLED} select count(*) as total, count(ground_truth) as labelled, count(*) - count(ground_truth) as unlabelled, round(count(ground_truth) / count(*), 4) as coverage from labelled", "scored_log outcomes")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_coverage(_labelled(spark, sf_dir))


@query(f"with {_LABELLED} select count(*) as total, count(ground_truth) as labelled, count(distinct prediction) as distinct_predictions, count(distinct cast(scored_at as date)) as distinct_days from labelled", "scored_log outcomes")
def log_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.log_health(_labelled(spark, sf_dir))


@query(f"with {_LABELLED} select event_id, customer_id, prediction, ground_truth, cast(scored_at as date) as scored_on from labelled", "scored_log outcomes")
def stored_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log after its labels came in two loads, read back from disk; days whose labels are all set are left alone."""
    path = tables.shared_path(spark, "inference_log")
    log = shape(spark, sf_dir, "scored_log").select("event_id", "customer_id", "prediction", "ground_truth", F.to_date("scored_at").alias("scored_on"))
    tables.overwrite(log, path, ["scored_on"])
    outcomes = shape(spark, sf_dir, "outcomes")
    labels.backfill_stored(spark, path, outcomes.where("is_default = 1"), "scored_on", ["event_id"])
    labels.backfill_stored(spark, path, outcomes, "scored_on", ["event_id"])
    return spark.read.parquet(path)


@query("select event_id, prediction_score, case when scored_at < timestamp '2024-01-15' then 'first' else 'second' end as batch_id from scored_log", "scored_log")
def repeated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a log, the first of them twice."""
    path = tables.shared_path(spark, "batches")
    log = shape(spark, sf_dir, "scored_log").select("event_id", "scored_at", "prediction_score")
    early = F.col("scored_at") < F.lit("2024-01-15").cast("timestamp")
    for batch, rows in (("first", log.where(early)), ("second", log.where(~early)), ("first", log.where(early))):
        tables.append_batch(rows.drop("scored_at"), path, batch)
    return tables.read_table(spark, path, merge_schema=True)


@query("select distinct customer_id, is_default from outcomes", "outcomes")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "outcomes")


_DRIFT = features.MONITORED
_ENRICHED = f"""enriched as (select a.*, monthly_instalment, credit_to_age_ratio from applicants a join ({_CREDIT_SQL}) using (application_id))"""


def _sides(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    rows = shape(spark, sf_dir, "applicants")
    rows = features.compute_features(rows)
    before, live = rows.where(F.col("applied_at") < DRIFT_FROM), rows.where(F.col("applied_at") >= DRIFT_FROM)
    if factor != 1.0:
        live = drift.inject_skew(live, {"credit_amount": factor, "age": factor}, "customer_id", F.col("customer_id") % 5 < 2)
    return before, live


def _drift_sql(live: str, tail: str) -> str:
    stack = " union all ".join(f"select '{c}' as feature, cast({c} as double) as value from {{0}} where {c} is not null" for c in _DRIFT)
    return f"""
        with {_ENRICHED}, base_rows as (select * from enriched where applied_at < timestamp '{DRIFT_FROM}'), live_rows as ({live}),
        b as ({stack.format("base_rows")}), l as ({stack.format("live_rows")}),
        q as (select feature, list_sort(list_distinct(quantile_disc(value, [{", ".join(f"{i / 10}" for i in range(1, 10))}]))) as edges from b group by feature),
        spine as (select feature, unnest(range(0, len(edges) + 1)) as bucket from q),
        cb as (select b.feature, len(list_filter(edges, lambda e: value > e)) as bucket, count(*) as n from b join q on b.feature = q.feature group by all),
        cl as (select l.feature, len(list_filter(edges, lambda e: value > e)) as bucket, count(*) as n from l join q on l.feature = q.feature group by all),
        s as (select spine.feature, spine.bucket, coalesce(cb.n, 0) as n_e, coalesce(cl.n, 0) as n_a,
            coalesce(cb.n, 0) / sum(coalesce(cb.n, 0)) over w as e, coalesce(cl.n, 0) / sum(coalesce(cl.n, 0)) over w as a, sum(coalesce(cl.n, 0)) over w as all_a
            from spine left join cb on spine.feature = cb.feature and spine.bucket = cb.bucket left join cl on spine.feature = cl.feature and spine.bucket = cl.bucket
            window w as (partition by spine.feature)),
        p as (select feature, sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) as psi from s group by feature),
        r as (select feature, psi, case when psi >= 0.25 then 'RETRAIN' when psi >= 0.10 then 'WARN' else 'STABLE' end as verdict from p) {tail}"""


_LIVE = f"select * from enriched where applied_at >= timestamp '{DRIFT_FROM}'"
_SKEWED = f"""select {", ".join(_DRIFT)} from enriched where applied_at >= timestamp '{DRIFT_FROM}'
    union all select {", ".join(c + " * 3" * (c in ("credit_amount", "age")) for c in _DRIFT)} from enriched where applied_at >= timestamp '{DRIFT_FROM}' and customer_id % 5 < 2"""


@query(_drift_sql(_LIVE, "select feature, round(psi, 6) as psi, verdict, 'now' as checked_at from r"), "applicants")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.newest_first(drift.drift_report(*_sides(spark, sf_dir), _DRIFT, "now")))


@query(_drift_sql(_SKEWED, "select feature, round(psi, 6) as psi, verdict, 'now' as checked_at from r"), "applicants")
def drift_report_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.drift_report(*_sides(spark, sf_dir, 3.0), _DRIFT, "now"))


@query(
    _drift_sql(
        _SKEWED,
        """select count(*) as n_features, count(*) filter (where verdict = 'WARN') as n_warned, coalesce(string_agg(feature, ',' order by feature) filter (where verdict = 'WARN'), '') as warned,
        arg_max(feature, psi) as worst_feature, round(max(psi), 6) as worst_psi, bool_or(verdict = 'RETRAIN') as retrain_required,
        coalesce(string_agg(format('{} PSI={:.4f}', feature, psi), '; ' order by feature) filter (where verdict = 'RETRAIN'), 'no breach') as reason from r""",
    ),
    "applicants",
)
def retrain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.retrain_decision(drift.drift_report(*_sides(spark, sf_dir, 3.0), _DRIFT, "now")))


@query(
    _drift_sql(
        _SKEWED,
        """, d as (select feature, sqrt(greatest(sum(case when e > 0 then e * log2(e / ((e + a) / 2)) else 0 end + case when a > 0 then a * log2(a / ((e + a) / 2)) else 0 end) / 2, 0)) as js,
            sum(case when e > 0 then (n_a - e * all_a) * (n_a - e * all_a) / (e * all_a) else 0 end) as chi2, sum(abs(a - e)) / 2 as tv, max(abs(a - e)) as linf from s group by feature),
        v as (select feature, value, sum(x) as x, sum(y) as y from (select feature, value, 1 as x, 0 as y from b union all select feature, value, 0, 1 from l) group by feature, value),
        c as (select feature, value, lead(value) over (partition by feature order by value) as next,
            abs(sum(x) over (partition by feature order by value) / sum(x) over (partition by feature) - sum(y) over (partition by feature order by value) / sum(y) over (partition by feature)) as gap from v),
        k as (select feature, max(gap) as ks, sum(gap * coalesce(next - value, 0)) as wasserstein from c group by feature)
        select feature, round(psi, 6) as psi, round(js, 6) as js, round(chi2, 4) as chi2, round(tv, 6) as tv, round(linf, 6) as linf, round(ks, 6) as ks, round(wasserstein, 4) as wasserstein
        from p join d using (feature) join k using (feature)""",
    ),
    "applicants",
)
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_metrics(*_sides(spark, sf_dir, 3.0), _DRIFT)
    return out.select("feature", *(F.round(c, 4 if c in ("chi2", "wasserstein") else 6).alias(c) for c in out.columns[1:]))


_CATEGORIES = ["channel", "kyc_status", "reference"]
_CATEGORY_SQL = f"""all_rows as (select *, 'a' || cast(application_id as varchar) as reference from applicants),
    b as ({" union all ".join(f"select '{c}' as feature, {c} as value from all_rows where {c} is not null and applied_at < timestamp '{DRIFT_FROM}'" for c in _CATEGORIES)}),
    l as ({" union all ".join(f"select '{c}' as feature, {c} as value from all_rows where {c} is not null and applied_at >= timestamp '{DRIFT_FROM}'" for c in _CATEGORIES)}),
    t as (select feature, value, count(*) as n, sum(count(*)) over (partition by feature) as total from b group by feature, value),
    heavy as (select feature, value, row_number() over (partition by feature order by value) - 1 as bucket from t where n >= 0.001::double * total),
    m as (select f.feature, count(h.value) as rest from (select distinct feature from b) f left join heavy h on h.feature = f.feature group by f.feature),
    spine as (select feature, unnest(range(0, rest + 1)) as bucket from m),
    cb as (select b.feature, coalesce(h.bucket, m.rest) as bucket, count(*) as n from b join m on m.feature = b.feature left join heavy h on h.feature = b.feature and h.value = b.value group by all),
    cl as (select l.feature, coalesce(h.bucket, m.rest) as bucket, count(*) as n from l join m on m.feature = l.feature left join heavy h on h.feature = l.feature and h.value = l.value group by all),
    s as (select spine.feature, spine.bucket, coalesce(cb.n, 0) as n_e, coalesce(cl.n, 0) as n_a,
        coalesce(cb.n, 0) / sum(coalesce(cb.n, 0)) over w as e, coalesce(cl.n, 0) / sum(coalesce(cl.n, 0)) over w as a, sum(coalesce(cl.n, 0)) over w as all_a, sum(coalesce(cb.n, 0)) over w as all_e
        from spine left join cb on spine.feature = cb.feature and spine.bucket = cb.bucket left join cl on spine.feature = cl.feature and spine.bucket = cl.bucket
        window w as (partition by spine.feature))"""
_DISTANCES_SQL = """sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) as psi,
    sqrt(greatest(sum(case when e > 0 then e * log2(e / ((e + a) / 2)) else 0 end + case when a > 0 then a * log2(a / ((e + a) / 2)) else 0 end) / 2, 0)) as js,
    sum(case when e > 0 then (n_a - e * all_a) * (n_a - e * all_a) / (e * all_a) else 0 end) as chi2, sum(abs(a - e)) / 2 as tv, max(abs(a - e)) as linf"""


def _category_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two columns of few values and one that has another value in each row."""
    rows = shape(spark, sf_dir, "applicants").withColumn("reference", F.concat(F.lit("a"), F.col("application_id").cast("string")))
    return rows.where(F.col("applied_at") < DRIFT_FROM), rows.where(F.col("applied_at") >= DRIFT_FROM)


@query(
    f"""with {_CATEGORY_SQL}, d as (select feature, {_DISTANCES_SQL} from s group by feature)
    select feature, round(psi, 6) as psi, round(js, 6) as js, round(chi2, 4) as chi2, round(tv, 6) as tv, round(linf, 6) as linf, cast(null as double) as ks, cast(null as double) as wasserstein from d""",
    "applicants",
)
def category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_metrics(*_category_sides(spark, sf_dir), _CATEGORIES)
    return out.select("feature", *(F.round(c, 4 if c == "chi2" else 6).alias(c) for c in out.columns[1:]))


@query(
    """with r as (select cast(scored_at as date) as day, event_type as value from scored_log where event_type is not null),
    heavy as (select value, row_number() over (order by value) - 1 as bucket from (select value, count(*) as n, sum(count(*)) over () as total from r group by value) where n >= 0.001::double * total),
    c as (select day, coalesce(bucket, (select count(*) from heavy)) as bucket, count(*) as n from r left join heavy using (value) group by all),
    d as (select day, before from (select day, lag(day) over (order by day) as before, max(day) over () as newest from (select distinct day from c)) where before is not null and day > newest - interval 10 day),
    s as (select d.day, k.bucket, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_e from d, (select unnest(range(0, (select count(*) from heavy) + 1)) as bucket) k
        left join c x on x.day = d.day and x.bucket = k.bucket left join c y on y.day = d.before and y.bucket = k.bucket),
    h as (select *, n_a / sum(n_a) over (partition by day) as a, n_e / sum(n_e) over (partition by day) as e, sum(n_a) over (partition by day) as all_a from s)
    select 'event_type' as feature, day, round(psi, 6) as psi, round(js, 6) as js, round(chi2, 4) as chi2, round(tv, 6) as tv, round(linf, 6) as linf from (select day, """
    + _DISTANCES_SQL
    + " from h group by day)",
    "scored_log",
)
def consecutive_category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.consecutive_category_drift(shape(spark, sf_dir, "scored_log"), ["event_type"], last_days=10)
    return out.select("feature", "day", *(F.round(c, 4 if c == "chi2" else 6).alias(c) for c in out.columns[2:]))


@query(
    """with r as (select date_trunc('day', scored_at) as window_start, model_version as model, variant as slice, event_type, 'e' || cast(event_id as varchar) as event_key from scored_log),
    v as (select window_start, model, slice, 'event_type' as "column", event_type as value from r where event_type is not null union all select window_start, model, slice, 'event_key', event_key from r where event_key is not null),
    t as (select "column", value, count(*) as n, sum(count(*)) over (partition by "column") as total from v group by "column", value),
    g as (select window_start, v."column", model, slice, t.value from v left join t on t."column" = v."column" and t.value = v.value and t.n >= 0.001::double * t.total),
    c as (select window_start, "column", model, slice, value, count(*) as n from g group by grouping sets ((window_start, "column", value, model, slice), (window_start, "column", value, model), (window_start, "column", value, slice), (window_start, "column", value)))
    select cast(window_start as timestamp) as window_start, "column", coalesce(model, '*') as model, coalesce(slice, '*') as slice, value, n, round(n / sum(n) over (partition by window_start, "column", model, slice), 6) as share from c""",
    "scored_log",
)
def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = shape(spark, sf_dir, "scored_log").withColumn("event_key", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return _rounded(drift.category_profile(log, ["event_type", "event_key"], by="variant"))


_STATE_SQL = """
    with r as (select {at} as moment, model_version as model, variant as slice, amount, prediction_score, event_type from {log}),
    v as (select moment, model, slice, 'amount' as "column", amount as x, cast(amount as varchar) as text from r union all select moment, model, slice, 'prediction_score', prediction_score, cast(prediction_score as varchar) from r
        union all select moment, model, slice, 'event_type', null, event_type from r)
    select moment as {name}, "column", {keys}, count(*) as n, count(*) - count(text) as n_null, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as deviation, round(min(x), 6) as low, round(max(x), 6) as high
    from v group by {group}"""
_PROFILED = ["amount", "prediction_score", "event_type"]


@query(
    _STATE_SQL.format(
        at="cast(make_timestamp(epoch_us(scored_at) // (7 * 86400000000) * (7 * 86400000000)) as timestamp)",
        log="scored_log",
        name="window_start",
        keys="coalesce(model, '*') as model, coalesce(slice, '*') as slice",
        group='grouping sets ((moment, "column", model, slice), (moment, "column", model), (moment, "column", slice), (moment, "column"))',
    ),
    "scored_log",
)
def profile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks, merged from days; the sketched columns are tested against their stated errors elsewhere."""
    states = profile_state.profile_states(shape(spark, sf_dir, "scored_log"), _PROFILED, by="variant")
    return _rounded(profile_state.read_profile(profile_state.windows(states, "7 days")).drop("quantiles", "distinct"))


@query(
    _STATE_SQL.format(at="cast(scored_at as date)", log="scored_log", name="day", keys="model, slice", group='moment, "column", model, slice')
    .replace("amount, prediction_score, event_type from", "amount, prediction_score, event_type, ground_truth from")
    .replace("union all select moment, model, slice, 'event_type', null", "union all select moment, model, slice, 'ground_truth', ground_truth, cast(ground_truth as varchar) from r union all select moment, model, slice, 'event_type', null")
    .replace("from scored_log)", "from labelled)")
    .replace("\n    with r", f"\n    with {_LABELLED}, r", 1),
    "scored_log outcomes",
)
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored profile after three refreshes: the first rows, the later rows, then labels that came late."""
    path, names = tables.shared_path(spark, "profile"), [*_PROFILED, "ground_truth"]
    log, late = shape(spark, sf_dir, "scored_log"), F.col("scored_at") >= F.lit("2024-01-15").cast("timestamp")
    refresh = lambda rows, changed: profile_state.refresh_profile(path, rows, names, changed, by="variant")
    refresh(log.where(~late), None)
    refresh(log, log.where(late))
    labelled = _labelled(spark, sf_dir)
    refresh(labelled, labelled.where("ground_truth is not null"))
    return _rounded(profile_state.read_profile(spark.read.parquet(path)).drop("quantiles", "distinct"))


#: Tails of the test statistics by the series of the lower incomplete gamma function and of Kolmogorov's distribution.
_CHI2_P_SQL = "case when chi2 <= 0 then 1 else greatest(0, 1 - list_sum(list_transform(range(0, cast(chi2 + 200 as bigint)), lambda i: exp((degrees / 2 + i) * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(degrees / 2 + i + 1))))) end"
_KS_P_SQL = "least(1, greatest(0, 2 * list_sum(list_transform(range(1, 400), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * ks * ks * (n_e * n_a / (n_e + n_a)))))))"


@query(
    _drift_sql(
        _LIVE,
        f""", d as (select feature, sum(case when e > 0 then (n_a - e * all_a) * (n_a - e * all_a) / (e * all_a) else 0 end) as chi2, sum(n_e) as n_e, sum(n_a) as n_a, count(*) filter (where e > 0) - 1 as degrees from s group by feature),
        v as (select feature, value, sum(x) as x, sum(y) as y from (select feature, value, 1 as x, 0 as y from b union all select feature, value, 0, 1 from l) group by feature, value),
        c as (select feature, value, abs(sum(x) over (partition by feature order by value) / sum(x) over (partition by feature) - sum(y) over (partition by feature order by value) / sum(y) over (partition by feature)) as gap from v),
        k as (select feature, max(gap) as ks from c group by feature)
        select feature, cast(n_e as bigint) as n_e, cast(n_a as bigint) as n_a, round(chi2, 4) as chi2, degrees, round({_CHI2_P_SQL}, 6) as chi2_p_value, round(ks, 6) as ks, round({_KS_P_SQL}, 6) as ks_p_value from d join k using (feature)""",
    ),
    "applicants",
)
def drift_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_tests(*_sides(spark, sf_dir), _DRIFT)
    return out.select("feature", "n_e", "n_a", F.round("chi2", 4).alias("chi2"), "degrees", *(F.round(c, 6).alias(c) for c in ("chi2_p_value", "ks", "ks_p_value")))


@query(
    f"""with {_CATEGORY_SQL}, d as (select feature, sum(case when e > 0 then (n_a - e * all_a) * (n_a - e * all_a) / (e * all_a) else 0 end) as chi2, sum(n_e) as n_e, sum(n_a) as n_a, count(*) filter (where e > 0) - 1 as degrees from s group by feature)
    select feature, cast(n_e as bigint) as n_e, cast(n_a as bigint) as n_a, round(chi2, 4) as chi2, degrees, case when degrees > 0 then round({_CHI2_P_SQL}, 6) end as chi2_p_value from d""",
    "applicants",
)
def category_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_tests(*_category_sides(spark, sf_dir), _CATEGORIES)
    return out.select("feature", "n_e", "n_a", F.round("chi2", 4).alias("chi2"), "degrees", F.round("chi2_p_value", 6).alias("chi2_p_value"))


@query(
    """with q as (select list_sort(list_distinct(quantile_disc(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as edges from scored_log where scored_at < timestamp '2024-01-08'),
    r as (select cast(scored_at as date) as day, amount as value from scored_log where amount is not null),
    c as (select day, len(list_filter(edges, lambda e: value > e)) as bucket, count(*) as n from r, q group by all),
    d as (select day, before from (select day, lag(day) over (order by day) as before, max(day) over () as newest from (select distinct day from c)) where before is not null and day > newest - interval 10 day),
    s as (select d.day, k.bucket, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_e from d, (select unnest(range(0, len(edges) + 1)) as bucket from q) k
        left join c x on x.day = d.day and x.bucket = k.bucket left join c y on y.day = d.before and y.bucket = k.bucket),
    h as (select *, n_a / sum(n_a) over (partition by day) as a, n_e / sum(n_e) over (partition by day) as e, sum(n_a) over (partition by day) as all_a from s),
    p as (select day, sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) as psi,
        sqrt(greatest(sum(case when e > 0 then e * log2(e / ((e + a) / 2)) else 0 end + case when a > 0 then a * log2(a / ((e + a) / 2)) else 0 end) / 2, 0)) as js,
        sum(case when e > 0 then (n_a - e * all_a) * (n_a - e * all_a) / (e * all_a) else 0 end) as chi2, sum(abs(a - e)) / 2 as tv, max(abs(a - e)) as linf from h group by day),
    w as (select day, value, sum(x) as x, sum(y) as y from (select d.day, value, 1 as x, 0 as y from d join r on r.day = d.before union all select d.day, value, 0, 1 from d join r on r.day = d.day) group by day, value),
    g as (select day, value, lead(value) over (partition by day order by value) as next,
        abs(sum(x) over (partition by day order by value) / sum(x) over (partition by day) - sum(y) over (partition by day order by value) / sum(y) over (partition by day)) as gap from w),
    k as (select day, max(gap) as ks, sum(gap * coalesce(next - value, 0)) as wasserstein from g group by day)
    select 'amount' as feature, day, round(psi, 6) as psi, round(js, 6) as js, round(chi2, 4) as chi2, round(tv, 6) as tv, round(linf, 6) as linf, round(ks, 6) as ks, round(wasserstein, 4) as wasserstein
    from p join k using (day)""",
    "scored_log",
)
def consecutive_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten days, the oldest of them against a day before them."""
    log = shape(spark, sf_dir, "scored_log")
    edges = drift.quantile_edges(drift.unpivoted(log.where("scored_at < timestamp '2024-01-08'"), ["amount"]))
    out = drift.consecutive_drift(log, ["amount"], edges, last_days=10)
    return out.select("feature", "day", *(F.round(c, 4 if c in ("chi2", "wasserstein") else 6).alias(c) for c in out.columns[2:]))


@query(
    """with r as (select date_trunc('day', scored_at) as window_start, model_version as model, event_type as slice, amount, prediction_score from scored_log),
    v as (select window_start, model, slice, 'amount' as "column", amount as value from r union all select window_start, model, slice, 'prediction_score', prediction_score from r)
    select cast(window_start as timestamp) as window_start, "column", coalesce(model, '*') as model, coalesce(slice, '*') as slice, count(*) as n, count(*) - count(value) as n_null,
        round(avg(value), 6) as mean, round(stddev_samp(value), 6) as deviation, round(min(value), 6) as low, round(max(value), 6) as high
    from v group by grouping sets ((window_start, "column", model, slice), (window_start, "column", model), (window_start, "column", slice), (window_start, "column"))""",
    "scored_log",
)
def profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.profile_metrics(shape(spark, sf_dir, "scored_log"), ["amount", "prediction_score"], by="event_type"))


@query(
    f"""with {_LABELLED}, r as (select date_trunc('day', scored_at) as window_start, model_version as model, event_type as slice, prediction as p, ground_truth as y from labelled),
    m as (select window_start, coalesce(model, '*') as model, coalesce(slice, '*') as slice, count(*) as n, count(*) filter (where p = 1 and y = 1) as tp, count(*) filter (where p = 1 and y = 0) as fp,
        count(*) filter (where p = 0 and y = 1) as fn, count(*) filter (where p = 0 and y = 0) as tn
        from r group by grouping sets ((window_start, model, slice), (window_start, model), (window_start, slice), (window_start)))
    select cast(window_start as timestamp) as window_start, model, slice, n, tp + fp + fn + tn as n_labelled, tp, fp, fn, tn,
        round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from m""",
    "scored_log outcomes",
)
def profile_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.profile_table_metrics(_labelled(spark, sf_dir), by="event_type"))


_CONFUSION_SQL = """select variant, count(*) filter (where p = 1 and y = 1) as tp, count(*) filter (where p = 1 and y = 0) as fp,
    count(*) filter (where p = 0 and y = 1) as fn, count(*) filter (where p = 0 and y = 0) as tn from (select variant, prediction as p, ground_truth as y from labelled) group by variant"""


@query(
    f"""with {_LABELLED}, m as ({_CONFUSION_SQL}) select variant, tp, fp, fn, tn, tp + fp + fn + tn as n_labelled, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as accuracy,
        round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from m""",
    "scored_log outcomes",
)
def arm_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(abtest.confusion(_labelled(spark, sf_dir), ["variant"]))


#: The chance of a standard normal value beyond z on either side: 1 - erf, by the series with gamma functions.
_P_SQL = "1 - exp(-z * z / 2) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - lgamma(n + 1.5))))"
_SCORE_PSI_SQL = """q as (select list_sort(list_distinct(quantile_disc(prediction_score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as edges from scored_log where variant = 'A'),
    c as (select variant, len(list_filter(edges, lambda e: prediction_score > e)) as bucket, count(*) as n from scored_log, q group by all),
    s as (select v.variant, k.bucket, coalesce(x.n, 0) as n_a, coalesce(y.n, 0) as n_e from (select variant from arms) v, (select unnest(range(0, len(edges) + 1)) as bucket from q) k
        left join c x on x.variant = v.variant and x.bucket = k.bucket left join c y on y.variant = 'A' and y.bucket = k.bucket),
    h as (select variant, greatest(n_a / sum(n_a) over (partition by variant), 1e-4) as a, greatest(n_e / sum(n_e) over (partition by variant), 1e-4) as e from s),
    psi as (select variant, sum((a - e) * ln(a / e)) as psi from h group by variant)"""
_ARMS_SQL = "arms as (select variant, count(*) as n, avg(prediction) as positive_pred_rate, string_agg(distinct model_version, ',' order by model_version) as model_version from scored_log group by variant)"
_AB_SQL = f"""
    with {_LABELLED}, m as ({_CONFUSION_SQL}),
    {_ARMS_SQL}, {_SCORE_PSI_SQL},
    t as (select max(tp + tn) filter (where variant = 'A') as sa, max(tp + fp + fn + tn) filter (where variant = 'A') as na,
        max(tp + tn) filter (where variant = 'B') as sb, max(tp + fp + fn + tn) filter (where variant = 'B') as nb from m),
    z as (select (sb / nb - sa / na) / sqrt((sa + sb) / (na + nb) * (1 - (sa + sb) / (na + nb)) * (1.0 / na + 1.0 / nb)) as z from t)
    select arms.variant, model_version, n, cast(null as double) as approval_rate, round(positive_pred_rate, 6) as positive_pred_rate,
        round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall,
        round(psi, 6) as psi, 'accuracy' as primary_metric, round(z, 6) as z, round({_P_SQL}, 6) as p_value, 'batch' as serving_mode, 'now' as checked_at
    from arms join m using (variant) join psi using (variant), z"""


@query(_AB_SQL, "scored_log outcomes")
def ab_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(abtest.compare_arms(_labelled(spark, sf_dir), None, "now"))


@query(
    f"""with {_ARMS_SQL}, {_SCORE_PSI_SQL},
    r as (select variant, avg(cast(prediction_score <= 0.5 as double)) as approval_rate, count(*) as n_decided, count(*) filter (where prediction_score <= 0.5) as n_approved from scored_log group by variant),
    t as (select max(n_approved) filter (where variant = 'A') as sa, max(n_decided) filter (where variant = 'A') as na,
        max(n_approved) filter (where variant = 'B') as sb, max(n_decided) filter (where variant = 'B') as nb from r),
    z as (select (sb / nb - sa / na) / sqrt((sa + sb) / (na + nb) * (1 - (sa + sb) / (na + nb)) * (1.0 / na + 1.0 / nb)) as z from t)
    select arms.variant, model_version, n, round(approval_rate, 6) as approval_rate, round(positive_pred_rate, 6) as positive_pred_rate,
        cast(null as double) as accuracy, cast(null as double) as precision, cast(null as double) as recall,
        round(psi, 6) as psi, 'approval_rate' as primary_metric, round(z, 6) as z, round({_P_SQL}, 6) as p_value, 'batch' as serving_mode, 'now' as checked_at
    from arms join r using (variant) join psi using (variant), z""",
    "scored_log",
)
def ab_comparison_with_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = shape(spark, sf_dir, "scored_log")
    decided = log.select("variant", (F.col("prediction_score") <= 0.5).alias("is_eligible"))
    return _rounded(abtest.compare_arms(log, decided, "now"))


@query(
    """with v as (select prediction as s, cast(class as bigint) as y from applicants),
    g as (select s, sum(y) as pos, count(*) - sum(y) as neg from v group by s),
    c as (select *, sum(pos) over (order by s desc) as cp, sum(neg) over (order by s desc) as cn from g),
    t as (select count(*) filter (where s >= 0.3 and y = 1) as tp, count(*) filter (where s >= 0.3 and y = 0) as fp, count(*) filter (where s < 0.3 and y = 1) as fn from v)
    select 'roc_auc' as metric, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 6) as value from c
    union all select 'pr_auc', round(sum(pos * (cp / (cp + cn))) / sum(pos), 6) from c
    union all select 'precision', round(tp / (tp + fp), 6) from t union all select 'recall', round(tp / (tp + fn), 6) from t
    union all select 'f1', round(2 * tp / (2 * tp + fp + fn), 6) from t union all select 'base_rate', round(avg(y), 6) from v""",
    "applicants",
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.quality_metrics(shape(spark, sf_dir, "applicants"), "prediction", "class"))


@query(
    """with t as (select count(*) filter (where prediction >= 0.3 and class = 1) as tp, count(*) filter (where prediction >= 0.3 and class = 0) as fp,
        count(*) filter (where prediction < 0.3 and class = 1) as fn from applicants), m as (select tp / (tp + fp) as p, tp / (tp + fn) as r from t)
    select 'precision' as metric, round(p, 6) as value, 0.4 as bound, case when p < 0.4 then 'BREACH' else 'PASS' end as status from m
    union all select 'recall', round(r, 6), 0.4, case when r < 0.4 then 'BREACH' else 'PASS' end from m
    union all select 'lift', null, 1.5, 'WARNING'""",
    "applicants",
)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = quality.quality_metrics(shape(spark, sf_dir, "applicants"), "prediction", "class")
    return _rounded(quality.gate(metrics, [("precision", 0.4, True), ("recall", 0.4, True), ("lift", 1.5, True)]).drop("message"))


@query(
    """with f as (select customer_id, txn_ts as feature_ts, max(round(amount, 4)) as amount from transactions group by customer_id, txn_ts)
    select a.application_id, a.customer_id, f.amount as last_amount
    from applicants a asof left join f on a.customer_id = f.customer_id and a.applied_at >= f.feature_ts""",
    "transactions applicants",
)
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "transactions").select("customer_id", F.col("txn_ts").alias("feature_ts"), F.round("amount", 4).alias("last_amount"))
    events = shape(spark, sf_dir, "applicants").select("application_id", "customer_id", "applied_at")
    return lookup.point_in_time(events, rows, ["customer_id"], "applied_at", "feature_ts", ["last_amount"]).drop("applied_at")


_READERS_SQL = """
    with recent as (select * from reads where event_date >= date '2024-01-10'),
    latest as (select entity_type, entity_id, max(row(event_time, entity_run_id, created_by)) as last from recent group by all),
    l as (select entity_type, entity_id, struct_extract(last, 1) as last_read, struct_extract(last, 2) as run, struct_extract(last, 3) as created_by from latest)
    select l.entity_type, l.entity_id, l.last_read, l.created_by, l.entity_id in (select entity_id from writers) as producer, l.entity_type not in ('NOTEBOOK', 'QUERY', 'DASHBOARD') as blocking,
        '[' || string_agg(distinct '"' || r.source_column_name || '"', ',' order by '"' || r.source_column_name || '"') || ']' as columns
    from l join recent r on r.entity_id = l.entity_id and r.entity_run_id is not distinct from l.run group by all"""


def _readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.latest_readers(shape(spark, sf_dir, "reads"), shape(spark, sf_dir, "writers"), F.lit("2024-01-10").cast("date"))


@query(_READERS_SQL, "reads writers")
def lineage_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readers(spark, sf_dir)


@query("""with d as (select entity_id, list(distinct source_column_name) as features from reads group by entity_id)
    select 'events' as change_table, c.feature, c.kind, 'e' || cast(d.entity_id as varchar) as name,
        case when c.kind = 'keys' and d.entity_id % 7 <> 0 then 'the keys change' when d.entity_id % 7 = 0 then 'may read any column' else 'reads the column' end as why
    from d, (values ('c1', 'removed'), ('c2', 'changed'), ('id', 'keys')) c(feature, kind)
    where d.entity_id % 7 = 0 or c.kind = 'keys' or list_contains(d.features, c.feature)""", "reads")
def downstream_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = shape(spark, sf_dir, "reads").groupBy("entity_id").agg(F.collect_set("source_column_name").alias("features"))
    deps = deps.select(F.lit("events").alias("dep_table"), F.concat(F.lit("e"), "entity_id").alias("name"), F.when(F.col("entity_id") % 7 != 0, F.col("features")).alias("features"))
    changes = spark.createDataFrame([("events", "c1", "removed"), ("events", "c2", "changed"), ("events", "c3", "added"), ("events", "id", "keys")], "change_table string, feature string, kind string")
    return lineage.downstream_breaks(changes, deps)


@query("""with pins as (select distinct 't' || cast(entity_id % 5 as varchar) as "table", source_column_name as feature from reads),
    catalog as (select distinct 't' || cast(entity_id % 4 as varchar) as "table", source_column_name as feature,
        case when source_column_name = 'c1' then 'deprecated' else 'active' end as status from reads where source_column_name <> 'c3')
    select p."table", p.feature, case when c.feature is null then 'not in the producer contract' else 'deprecated, sunset 2025-01-01, migrate to c2' end as warning
    from pins p left join catalog c on p."table" = c."table" and p.feature = c.feature
    where p."table" in (select "table" from catalog) and (c.feature is null or c.status = 'deprecated')""", "reads")
def pin_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "reads")
    named = lambda n: F.concat(F.lit("t"), (F.col("entity_id") % n).cast("string"))
    pins = rows.select(named(5).alias("pin_table"), F.col("source_column_name").alias("pin_feature")).distinct()
    old = F.col("source_column_name") == "c1"
    catalog = rows.where("source_column_name <> 'c3'").select(named(4).alias("table"), F.col("source_column_name").alias("feature"), F.when(old, "deprecated").otherwise("active").alias("status"), F.when(old, "2025-01-01").alias("sunset_date"), F.when(old, "c2").alias("replaced_by"))
    return lineage.pin_warnings(pins, catalog.distinct())


@query("""select source_column_name as "table", 'src.t' || cast(entity_id % 3 as varchar) as upstream, entity_type, event_time from reads group by all""", "reads")
def lineage_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "reads").select("entity_type", "event_time", F.concat(F.lit("src.t"), (F.col("entity_id") % 3).cast("string")).alias("source_table_full_name"), F.lit("gold").alias("target_table_schema"), F.col("source_column_name").alias("target_table_name"))
    return lineage.upstream(rows, "gold")


@query("""select source_column_name as "table", 'gold.t' || cast(entity_id % 3 as varchar) as downstream, entity_type, entity_run_id, event_time from reads group by all""", "reads")
def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape(spark, sf_dir, "reads").select("entity_type", "entity_run_id", "event_time", F.concat(F.lit("gold.t"), (F.col("entity_id") % 3).cast("string")).alias("target_table_full_name"), F.lit("raw").alias("source_table_schema"), F.col("source_column_name").alias("source_table_name"))
    return lineage.downstream(rows, "raw")


@query(f"""with f as ({_FEATURES_SQL.format(as_of=AS_OF, where="")}) select 'null customer_id' as "check", count(*) filter (where customer_id is null) as n from f
    union all select 'null as_of_date', count(*) filter (where as_of_date is null) from f
    union all select 'duplicate keys', count(*) from (select customer_id, as_of_date from f group by all having count(*) > 1)""", "transactions")
def contract_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.key_problems(_features_at(spark, sf_dir, AS_OF), CUSTOMER_FEATURES)


@query("select max(cast(ts as date)) as latest, round(datediff('hour', cast(max(cast(ts as date)) as timestamp), timestamp '2024-02-05'), 6)::double as age_hours, datediff('hour', cast(max(cast(ts as date)) as timestamp), timestamp '2024-02-05') <= 192 as fresh from events")
def contract_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("as_of_date"))
    return contracts.freshness(days, CUSTOMER_FEATURES, F.lit("2024-02-05"))


@query("""select 'txn_count' as "column", 'int' as wanted, 'string' as found, count(*) filter (where o_orderpriority is not null and try_cast(o_orderpriority as int) is null) as n_lost from orders""")
def contract_type_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("as_of_date"), F.col("o_orderpriority").alias("txn_count"))
    return contracts.type_problems(rows, CUSTOMER_FEATURES)


@query("select event_id, ts, event_type from events order by ts desc, event_id limit 20")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type"), "ts", 20, "event_id")


@query(f"with f as ({_FEATURES_SQL.format(as_of=AS_OF, where='')}) select * from f order by customer_id limit 20", "transactions")
def feature_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preview(_features_at(spark, sf_dir, AS_OF), ["customer_id", "as_of_date"], 20)


@query()
def audit_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {r["metric"]: r["value"] for r in quality.quality_metrics(shape(spark, sf_dir, "applicants"), "prediction", "class").collect()}
    return tables.audit_row(spark, {"model_name": "credit", "decision": "REPORTED"}, found, SCORED_AT)


def _trained(spark: SparkSession, sf_dir: str, *kinds: str) -> tuple[DataFrame, list[scoring.PipelineModel], list[str]]:
    rows = features.compute_features(shape(spark, sf_dir, "applicants").drop("prediction"))
    names = [*features.MONITORED, *features.DERIVED[2:], "num_dependents", "residence_since", "existing_credits"]
    parts = scoring.stratified_split(rows, "class", "application_id")
    return parts, [scoring.train_classifier(parts.where("split = 'train'"), names, kind=k) for k in kinds], names


@query(
    f"""with a as (select application_id, class, {crc32_sql("('split 42:' || application_id)")} as draw from applicants)
    select application_id, class, case when row_number() over (partition by class order by draw, application_id) <= (count(*) over (partition by class) * 20 + 50) // 100 then 'test' else 'train' end as split from a""",
    "applicants",
)
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exact_split(shape(spark, sf_dir, "applicants").select("application_id", "class"), "class", "application_id")


@query()
def train_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, (model,), names = _trained(spark, sf_dir, "gbt")
    scored = scoring.score_batch(parts.where("split = 'test'"), model, names, "v1", SCORED_AT).select("prediction_score", "class")
    path = tables.shared_path(spark, "test_scores")  # the metrics read it several times
    tables.overwrite(scored, path)
    return quality.gate(quality.quality_metrics(spark.read.schema(scored.schema).parquet(path), "prediction_score", "class"))


@query()
def baseline_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, (model,), names = _trained(spark, sf_dir, "logistic")
    return scoring.baseline_snapshot(scoring.score_batch(parts.where("split = 'train'"), model, names, "v1", SCORED_AT), features.MONITORED)


@query()
def score_two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applicants, each by its arm's model: a logistic one and boosted trees, both fitted on the train split."""
    parts, (champion, challenger), names = _trained(spark, sf_dir, "logistic", "gbt")
    scored = scoring.score_arms(parts, {"A": (champion, "v1"), "B": (challenger, "v2")}, names, "customer_id", "exp1", 25, SCORED_AT)
    return scored.select("application_id", "customer_id", "variant", "model_version", "prediction_score", "scored_at")


@query(
    f"""with s as (select application_id, 1 / (1 + exp(-(credit_amount / 400000 + coalesce(duration, 0) / 100 - age / 50))) as prediction_score from applicants)
    select application_id, round(prediction_score, 6) as prediction_score, 'plain' as model_version, timestamp '{SCORED_AT}' as scored_at from s""",
    "applicants",
)
def score_with_plain_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is any Python function of a batch of feature columns."""

    def predict(rows):
        return 1 / (1 + (-(rows["credit_amount"] / 400_000 + rows["duration"].fillna(0) / 100 - rows["age"] / 50)).map(math.exp))

    out = scoring.score_with(shape(spark, sf_dir, "applicants"), predict, ["credit_amount", "duration", "age"], "plain", SCORED_AT)
    return _rounded(out.select("application_id", "prediction_score", "model_version", "scored_at"))


#: Two models of fixed coefficients: score = 1 / (1 + exp(age / by_age - credit_amount / by_amount)).
_ARM_MODELS = {"A": (50, 400_000, "v1"), "B": (40, 300_000, "v2")}
_ARM_SCORES_SQL = f"""s as (select *, case when {crc32_sql("('exp1:' || customer_id)")} % 100 < 25 then 'B' else 'A' end as variant from applicants),
    scored as (select *, case variant {" ".join(f"when '{a}' then 1 / (1 + exp(age / {x} - credit_amount / {y}))" for a, (x, y, _) in _ARM_MODELS.items())} end as prediction_score,
        case variant {" ".join(f"when '{a}' then '{v}'" for a, (_, _, v) in _ARM_MODELS.items())} end as model_version from s)"""


def _scored_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda x, y: lambda rows: 1 / (1 + (rows["age"] / x - rows["credit_amount"] / y).map(math.exp))
    arms = {a: (of(x, y), v) for a, (x, y, v) in _ARM_MODELS.items()}
    return scoring.score_arms_with(shape(spark, sf_dir, "applicants").drop("prediction"), arms, ["credit_amount", "age"], "customer_id", "exp1", 25, SCORED_AT)


@query(f"with {_ARM_SCORES_SQL} select application_id, customer_id, variant, model_version, round(prediction_score, 6) as prediction_score, timestamp '{SCORED_AT}' as scored_at from scored", "applicants")
def score_fixed_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applicants, each by its arm's model, in one pass."""
    return _rounded(_scored_arms(spark, sf_dir).select("application_id", "customer_id", "variant", "model_version", "prediction_score", "scored_at"))


@query(
    f"""with {_ARM_SCORES_SQL} select customer_id, credit_amount, age, duration, cast(prediction_score >= 0.30 as double) as prediction, round(prediction_score, 6) as prediction_score,
        cast(class as double) as ground_truth, model_version, timestamp '{SCORED_AT}' as scored_at from scored""",
    "applicants",
)
def fixed_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that drift is measured against, of models with fixed coefficients."""
    return _rounded(scoring.baseline_snapshot(_scored_arms(spark, sf_dir), ["customer_id", "credit_amount", "age", "duration"]))


_AUDIT_SQL = """with t as (select count(*) filter (where prediction >= 0.3 and class = 1) as tp, count(*) filter (where prediction >= 0.3 and class = 0) as fp,
        count(*) filter (where prediction < 0.3 and class = 1) as fn from applicants)
    select 'REPORTED' as decision, 'credit' as model_name, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, timestamp '{at}' as recorded_at from t"""


@query(_AUDIT_SQL.format(at=SCORED_AT), "applicants")
def stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row appended twice as one batch, its metrics read back out of the JSON column."""
    path = tables.shared_path(spark, "audit")
    found = {r["metric"]: r["value"] for r in quality.quality_metrics(shape(spark, sf_dir, "applicants"), "prediction", "class").collect()}
    for _ in range(2):
        tables.append_batch(tables.audit_row(spark, {"model_name": "credit", "decision": "REPORTED"}, found, SCORED_AT), path, "run-1")
    rows, metric = tables.read_table(spark, path), lambda k: F.get_json_object("evaluation_summary", f"$.{k}").cast("double").alias(k)
    return _rounded(rows.select("decision", "model_name", metric("precision"), metric("recall"), "recorded_at"))
