"""Who reads a table, and what a change to it would break, from read and write logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readers of these kinds run by hand; they are warned, not blocked.
AD_HOC = ["NOTEBOOK", "QUERY", "DASHBOARD"]
BREAKING = ["changed", "removed", "keys"]


def latest_readers(reads: DataFrame, writers: DataFrame, since: Column, ad_hoc: list[str] | None = None) -> DataFrame:
    """entity_type, entity_id, last_read, created_by, producer, blocking, columns (JSON) of each reader's latest run.

    Of reads at one time the greatest run and user count. A reader whose run is unknown is matched with its
    other reads without one. Writers of the table are marked as its producers.
    """
    recent = reads.where(F.col("entity_id").isNotNull() & (F.col("event_date") >= since))
    latest = recent.groupBy("entity_type", "entity_id").agg(
        F.max(F.struct("event_time", "entity_run_id", "created_by")).alias("last"),
    )
    own = recent.select("entity_id", F.col("entity_run_id").alias("run"), "source_column_name")
    at = latest.select("entity_type", "entity_id", F.col("last.event_time").alias("last_read"), F.col("last.entity_run_id").alias("last_run"), F.col("last.created_by").alias("created_by"))
    joined = at.join(own, (at["entity_id"] == own["entity_id"]) & at["last_run"].eqNullSafe(own["run"])).drop(own["entity_id"])
    columns = F.to_json(F.sort_array(F.collect_set("source_column_name")))
    found = joined.groupBy("entity_type", "entity_id", "last_read", "created_by").agg(columns.alias("columns"))
    known = writers.where(F.col("entity_id").isNotNull()).select("entity_id", F.lit(True).alias("__writes")).distinct()
    out = found.join(known, "entity_id", "left")
    blocking = ~F.col("entity_type").isin(*(AD_HOC if ad_hoc is None else ad_hoc))
    return out.select("entity_type", "entity_id", "last_read", "created_by", F.coalesce("__writes", F.lit(False)).alias("producer"), blocking.alias("blocking"), "columns")


def readers_of_column(readers: DataFrame, column: str) -> DataFrame:
    """The consumers among ``latest_readers`` that read the column."""
    return readers.where(~F.col("producer") & F.array_contains(F.from_json("columns", "array<string>"), column))


def retirement_verdict(readers: DataFrame) -> DataFrame:
    """n_active, n_ad_hoc, blocked: whether readers that must not break are left."""
    own = readers.where("not producer")
    return own.agg(F.count_if("blocking").alias("n_active"), F.count_if(~F.col("blocking")).alias("n_ad_hoc")).withColumn("blocked", F.col("n_active") > 0)


def downstream_breaks(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """change_table, feature, kind, name, why for each dependency that a change breaks.

    ``changes``: change_table, feature, kind. ``dependencies``: dep_table, name, features (null: reads all).
    A change of keys breaks every reader. Three equi-joins, since one with OR would compare all pairs.
    """
    breaking = changes.where(F.col("kind").isin(*BREAKING)).distinct()
    whole = dependencies.where("features is null")
    named = dependencies.where("features is not null")
    by_table = lambda c, d, why: c.join(d, c["change_table"] == d["dep_table"]).select("change_table", "feature", "kind", "name", F.lit(why).alias("why"))
    single = named.select("dep_table", "name", F.explode(F.array_distinct("features")).alias("reads"))
    hit = breaking.where("kind <> 'keys'")
    exact = hit.join(single, (hit["change_table"] == single["dep_table"]) & (hit["feature"] == single["reads"]))
    exact = exact.select("change_table", "feature", "kind", "name", F.lit("reads the column").alias("why"))
    return exact.unionByName(by_table(breaking, whole, "may read any column")).unionByName(by_table(breaking.where("kind = 'keys'"), named, "the keys change"))


def pin_warnings(pins: DataFrame, catalog: DataFrame) -> DataFrame:
    """table, feature, warning for pins of features that are missing or deprecated.

    ``pins``: pin_table, pin_feature. ``catalog``: table, feature, status, sunset_date, replaced_by. Pins of
    tables without a contract are not judged.
    """
    tables = catalog.select(F.col("table").alias("pin_table")).distinct()
    known = pins.join(tables, "pin_table", "left_semi")
    both = known.join(catalog, (known["pin_table"] == catalog["table"]) & (known["pin_feature"] == catalog["feature"]), "left")
    gone = F.when(F.col("feature").isNull(), F.lit("not in the producer contract"))
    said = gone.when(F.col("status") == "deprecated", F.concat(F.lit("deprecated, sunset "), F.coalesce("sunset_date", F.lit("unknown")), F.lit(", migrate to "), F.coalesce("replaced_by", F.lit("nothing"))))
    return both.select(F.col("pin_table").alias("table"), F.col("pin_feature").alias("feature"), said.alias("warning")).where("warning is not null")


def upstream(lineage: DataFrame, schema: str, table: str | None = None) -> DataFrame:
    """Sources that the table (or each table of the schema) was built from, newest first."""
    rows = lineage.where((F.col("target_table_schema") == schema) & F.col("source_table_full_name").isNotNull())
    rows = rows if table is None else rows.where(F.col("target_table_name") == table)
    own = [F.col("target_table_name").alias("table")] * (table is None)
    return rows.select(*own, F.col("source_table_full_name").alias("upstream"), "entity_type", "event_time").distinct().orderBy(F.desc("event_time"))


def downstream(lineage: DataFrame, schema: str, table: str | None = None) -> DataFrame:
    """Tables and runs that read the table (or each table of the schema), newest first."""
    rows = lineage.where(F.col("source_table_schema") == schema)
    rows = rows if table is None else rows.where(F.col("source_table_name") == table)
    own = [F.col("source_table_name").alias("table")] * (table is None)
    return rows.select(*own, F.col("target_table_full_name").alias("downstream"), "entity_type", "entity_run_id", "event_time").distinct().orderBy(F.desc("event_time"))
