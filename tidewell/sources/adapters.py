"""The shapes the operators work on, made from the provided tables.

Each is a SQL text that Spark and DuckDB read alike; in Spark the names in braces are DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHAPES: dict[str, str] = {
    "transactions": """
        select o.o_custkey as customer_id, l.l_orderkey as txn_id, l.l_shipdate as txn_ts, l.l_returnflag = 'R' as is_refund,
            case when l.l_returnflag = 'R' then -1.0 else 1.0 end * l.l_extendedprice * (1 - l.l_discount) as amount
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    "applicants": """
        select o_custkey as customer_id, o_orderkey as application_id, o_totalprice as credit_amount,
            cast(o_orderkey % 61 as int) as duration, cast(17 + o_custkey % 60 as int) as age,
            case when o_orderkey % 13 = 0 then null else cast(1 + o_orderkey % 4 as int) end as installment_commitment,
            case when o_orderkey % 11 = 0 then null else cast(o_orderkey % 5 as int) end as existing_credits,
            cast(o_custkey % 3 as int) as num_dependents, cast(o_custkey % 8 as int) as residence_since,
            case when (o_totalprice > 375000) <> (o_orderkey % 10 = 0) then 1 else 0 end as class,
            case when o_orderkey % 17 = 0 then 'PENDING' else 'verified' end as kyc_status,
            cast(o_orderkey % 1000 as double) / 1000 as prediction, o_orderdate as applied_at, o_orderpriority as channel
        from {orders}""",
    "scored_log": """
        select user_id as customer_id, event_id, ts as scored_at, value as amount, value / (value + 20) as prediction_score,
            cast(case when value / (value + 20) >= 0.30 then 1 else 0 end as double) as prediction,
            case when user_id % 10 < 3 then 'B' else 'A' end as variant,
            case when user_id % 10 < 3 then 'v2' else 'v1' end as model_version, event_type, cast(null as double) as ground_truth
        from {events}""",
    "outcomes": """
        select user_id as customer_id, cast(case when user_id % 3 = 0 then 1 else 0 end as int) as is_default
        from {events} group by user_id having min(ts) < timestamp '2024-01-01 12:00:00'""",
    "reads": """
        select upper(event_type) as entity_type, user_id as entity_id, cast(cast(ts as date) as varchar(10)) as entity_run_id,
            'c' || cast(event_id % 5 as varchar(9)) as source_column_name, ts as event_time, cast(ts as date) as event_date,
            'user' || cast(user_id % 7 as varchar(9)) as created_by, event_id
        from {events}""",
    "writers": "select distinct user_id as entity_id from {events} where user_id % 10 = 0",
}


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named shape over the tables of a data folder."""
    text = SHAPES[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", text))}
    return spark.sql(text, **tables)


def shape_sql(name: str) -> str:
    """The same in DuckDB's SQL, over views named as the tables are."""
    return re.sub(r"{(\w+)}", r"\1", SHAPES[name])
