"""Feature tables from contracts: a key, an as-of date and one aggregate expression per feature."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files, tables

#: The types a contract may give a feature.
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


@dataclass
class Feature:
    name: str
    dtype: str
    expression: str = ""  # an aggregate over the source, whose alias is t
    status: str = "active"
    sunset_date: str | None = None
    replaced_by: str | None = None

    def type(self) -> T.DataType:
        if self.dtype not in TYPES:
            raise ValueError(f"{self.name}: a feature can't be of type {self.dtype}; possible are {', '.join(TYPES)}")
        return TYPES[self.dtype]


@dataclass
class Contract:
    table: str
    keys: list[Feature]
    timestamp_key: str
    features: list[Feature]
    timestamp_column: str = ""  # of the source, for point-in-time builds
    max_age_hours: int | None = None
    sources: dict[str, str] = field(default_factory=dict)
    skeleton: str = ""  # a query with ${features} and ${<source>} in it, for contracts with a FROM, WHERE or JOIN of their own

    def schema(self) -> T.StructType:
        keys = [T.StructField(k.name, k.type(), False) for k in self.keys]
        return T.StructType([*keys, T.StructField(self.timestamp_key, T.DateType(), False), *(T.StructField(f.name, f.type()) for f in self.features)])

    def key_names(self) -> list[str]:
        return [*(k.name for k in self.keys), self.timestamp_key]


def load_contract(folder: str) -> Contract:
    """A contract folder: one YAML file, ``<feature>.sql`` with each feature's expression, and maybe ``_base.sql``, the skeleton."""
    import yaml

    root = Path(folder)
    (path,) = sorted(root.glob("*.yaml"))
    raw: dict[str, Any] = yaml.safe_load(path.read_text(encoding="utf-8"))
    make = lambda x: Feature(x["name"], x["type"], x.get("expression") or "", x.get("status", "active"), x.get("sunset_date"), x.get("replaced_by"))
    features = [make(x) for x in raw["features"]]
    for f in features:
        if not f.expression and (own := root / f"{f.name}.sql").exists():
            f.expression = own.read_text(encoding="utf-8")
    base = root / "_base.sql"
    skeleton = base.read_text(encoding="utf-8") if base.exists() else ""
    return Contract(raw["table"], [make(x) for x in raw["keys"]], raw["timestamp_key"], features, raw.get("timestamp_column", ""), raw.get("max_age_hours"), raw.get("sources", {}), skeleton)


#: Quoted text of SQL, in which nothing is replaced.
_QUOTED = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"


def _outside_quotes(text: str, pattern: str, put: str) -> str:
    """``put`` for what matches the pattern outside quoted text."""
    return re.sub(f"({_QUOTED})|{pattern}", lambda m: m[1] if m[1] is not None else put, text, flags=re.S | re.I)


def clean_expression(text: str, values: dict[str, str]) -> str:
    """SQL without comments, with ${names} filled in; a name without a value is an error. Quoted text keeps its comments and spaces."""
    text = _outside_quotes(text, r"--[^\n]*|/\*.*?\*/", " ")
    text = re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], m[0]), text)
    if m := re.search(r"\$\{\w+\}", text):
        raise ValueError(f"no value for {m[0]}")
    if not text.strip():
        raise ValueError("a feature needs an expression")
    return _outside_quotes(text, r"\s+", " ").strip()


def problems(contract: Contract) -> list[str]:
    """What keeps the contract from being published; empty if nothing does."""
    found = []
    if not contract.keys:
        found.append("no key")
    names = [n.lower() for n in [*contract.key_names(), *(f.name for f in contract.features)]]
    found += [f"{n}: named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for f in [*contract.keys, *contract.features]:
        if f.dtype not in TYPES:
            found.append(f"{f.name}: no type {f.dtype}")
    found += [f"{f.name}: no expression" for f in contract.features if not f.expression.strip()]
    found += [f"{f.name}: deprecated without a sunset date" for f in contract.features if f.status == "deprecated" and not f.sunset_date]
    return found


def build_features(contract: Contract, source: DataFrame, as_of: str, spine: DataFrame | None = None, strictly_before: bool = False) -> DataFrame:
    """The feature table at ``as_of``: one aggregation over the source, each feature cast to its type.

    All rows of the source count, as contracts say, unless ``strictly_before`` limits them to those before
    the date. With a ``spine`` of keys, keys without any row get the expressions' value over no rows. In
    expressions ``current_date()`` means the as-of date.
    """
    if found := problems(contract):
        raise ValueError("; ".join(found))
    date = f"date'{as_of}'"
    keys = [k.name for k in contract.keys]
    rows = source
    if strictly_before:
        if not contract.timestamp_column:
            raise ValueError("strictly_before needs the contract's timestamp_column")
        rows = rows.where(F.col(contract.timestamp_column) < F.lit(as_of).cast("timestamp"))
    if spine is not None:
        rows = spine.select(*keys).distinct().join(rows, keys, "left")
    made = [F.expr(_outside_quotes(clean_expression(f.expression, contract.sources), r"\bcurrent_date\(\)", date)).cast(f.type()).alias(f.name) for f in contract.features]
    table = rows.alias("t").groupBy(*(F.col(f"t.{k.name}").cast(k.type()).alias(k.name) for k in contract.keys)).agg(*made)
    return table.withColumn(contract.timestamp_key, F.lit(as_of).cast("date")).select(*contract.key_names(), *(f.name for f in contract.features))


def build_from_skeleton(contract: Contract, frames: dict[str, DataFrame], as_of: str) -> DataFrame:
    """The feature table by the contract's own query, with the ``frames`` in place of its ``${<source>}`` names.

    ``${features}`` becomes the list of the features, each cast to its type; ``current_date()`` means the as-of date; comments go. A
    name without a frame or a value is an error, like a query that lacks a key, the date or the slot. Frames are parameters of
    ``spark.sql``, so no view is made and a text in braces stays text.
    """
    if found := problems(contract):
        raise ValueError("; ".join(found))
    bare = _outside_quotes(contract.skeleton, r"--[^\n]*|/\*.*?\*/", " ")
    if bare.count("${features}") != 1:
        raise ValueError(f"{contract.table}: the skeleton needs ${{features}} once")
    escaped = lambda text: text.replace("{", "{{").replace("}", "}}")
    made = ", ".join(f"CAST({clean_expression(f.expression, contract.sources)} AS {f.type().simpleString()}) AS `{f.name}`" for f in contract.features)
    parts = re.split(r"\$\{(\w+)\}", bare)
    text = escaped(parts[0])
    for name, rest in zip(parts[1::2], parts[2::2], strict=True):
        if name == "features":
            text += escaped(made)
        elif name in frames:
            text += f"{{{name}}}"
        elif name in contract.sources:
            text += escaped(contract.sources[name])
        else:
            raise ValueError(f"no value for ${{{name}}}")
        text += escaped(rest)
    text = _outside_quotes(text, r"\bcurrent_date\(\)", f"date'{as_of}'")
    spark = next(iter(frames.values())).sparkSession
    table = spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})
    if missing := [k for k in contract.key_names() if k not in table.columns]:
        raise ValueError(f"{contract.table}: the skeleton selects no {', '.join(missing)}")
    return table.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in contract.schema()))


def analysis_error(contract: Contract, source: DataFrame | dict[str, DataFrame], as_of: str) -> str | None:
    """What Spark's analyser says against the feature SQL; no job runs."""
    from pyspark.errors import PySparkException

    try:
        _built(contract, source, as_of).schema  # noqa: B018
    except (PySparkException, ValueError) as e:
        return str(e).splitlines()[0]
    return None


def _built(contract: Contract, source: DataFrame | dict[str, DataFrame], as_of: str) -> DataFrame:
    return build_from_skeleton(contract, source, as_of) if isinstance(source, dict) else build_features(contract, source, as_of)


def staged_with_checks(contract: Contract, built: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """``built`` written under ``path``, and what its keys say against it: null keys and duplicate keys with their counts.

    ``built`` is evaluated once, for the write; the checks read the key columns of what was written. (An ``Observation`` of the write would
    save that read, but a session that has used one can't run the models of ``pyspark.ml`` any more in Spark 4.1.)
    """
    built.write.mode("overwrite").parquet(path)
    staged = built.sparkSession.read.schema(built.schema).parquet(path)
    return staged, {r["check"]: r["n"] for r in key_problems(staged, contract).collect() if r["n"]}


def publish(contract: Contract, built: DataFrame, path: str, staging: str | None = None) -> int:
    """Merge ``built`` into the contract's table: rows with the same keys and as-of date are replaced, all others stay.

    Nothing is merged if a key is null or occurs twice. A table of an earlier form of the contract gets the
    contract's columns first: new ones null, dropped ones gone. Returns the table's version, whose change set
    ``commits.read_changes`` reads; a publication that was lost midway is finished or forgotten by the next one. The rows are written
    once under ``staging`` (beside the table, if not given), which is deleted at the end.
    """
    spark, at = built.sparkSession, staging or f"{path.rstrip('/')}.built"
    try:
        staged, wrong = staged_with_checks(contract, built, at)
        if wrong:
            raise ValueError(f"{contract.table}: " + "; ".join(f"{k}: {n}" for k, n in wrong.items()))
        return tables.publish_upsert(spark, path, staged, contract.schema(), contract.key_names(), contract.timestamp_key)
    finally:
        files.delete(spark, at)


def combined(contracts: list[Contract]) -> Contract:
    """One contract with the features of all, which have the same keys; ``part_of`` takes each one's table from its table."""
    if len({tuple((k.name, k.dtype) for k in c.keys) for c in contracts}) != 1:
        raise ValueError("contracts that are built together have the same keys")
    features = [replace(f, name=f"{i}_{f.name}", expression=clean_expression(f.expression, c.sources)) for i, c in enumerate(contracts) for f in c.features]
    return replace(contracts[0], features=features)


def part_of(together: DataFrame, contracts: list[Contract], i: int) -> DataFrame:
    c, date = contracts[i], F.col(contracts[0].timestamp_key)
    return together.select(*(k.name for k in c.keys), date.alias(c.timestamp_key), *(F.col(f"{i}_{f.name}").alias(f.name) for f in c.features))


def publish_all(spark: SparkSession, contracts: list[Contract], sources: dict[str, DataFrame | dict[str, DataFrame]], as_of: str, root: str) -> dict[str, str]:
    """Build and merge every contract's table under ``root``; all contracts are checked before the first is written.

    Contracts with the same keys over the same source share one scan and one aggregation of it, whose result is written once and read
    by each. The tables are published side by side, each from a thread with a scheduler pool of its own.
    """
    bad = {c.table: e for c in contracts if (e := "; ".join(problems(c)) or analysis_error(c, sources[c.table], as_of))}
    if bad:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in bad.items()))
    alike: dict[tuple, list[Contract]] = {}
    for c in contracts:
        alike.setdefault((id(sources[c.table]), isinstance(sources[c.table], dict) and c.table, *((k.name, k.dtype) for k in c.keys)), []).append(c)
    paths, failed = {c.table: f"{root}/{c.table}" for c in contracts}, []

    def run(group: list[Contract], at: str) -> None:
        source = sources[group[0].table]
        try:
            if len(group) == 1:
                publish(group[0], _built(group[0], source, as_of), paths[group[0].table])
                return
            together = build_features(combined(group), source, as_of)
            together.write.mode("overwrite").parquet(at)
            held = spark.read.schema(together.schema).parquet(at)
            for i, c in enumerate(group):
                publish(c, part_of(held, group, i), paths[c.table])
        except Exception as e:  # noqa: BLE001  told below, after all threads have ended
            failed.append((group[0].table, e))
        finally:
            files.delete(spark, at)

    threads = []
    for i, group in enumerate(alike.values()):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"publish-{i}")
        threads.append(InheritableThread(target=run, args=(group, f"{root}/.shared-{i}")))
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise ValueError("; ".join(f"{t}: {e}" for t, e in failed)) from failed[0][1]
    return paths


def pinned(table: DataFrame, contract: Contract, names: list[str]) -> DataFrame:
    """Keys and the pinned features; reading all columns by default is refused."""
    if not names:
        raise ValueError("name the features to read")
    return table.select(*contract.key_names(), *names)


def key_problems(table: DataFrame, contract: Contract) -> DataFrame:
    """check, n: nulls in each key column and keys that occur more than once."""
    keys = contract.key_names()
    nulls = table.agg(*(F.count_if(F.col(k).isNull()).alias(f"null {k}") for k in keys)).unpivot([], [f"null {k}" for k in keys], "check", "n")
    twice = table.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate keys").alias("check"), "n")
    return nulls.unionByName(twice)


def freshness(table: DataFrame, contract: Contract, now: Column) -> DataFrame:
    """latest, age_hours, fresh: the newest as-of date against the contract's limit."""
    out = table.agg(F.max(contract.timestamp_key).alias("latest"))
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("latest").cast("timestamp"))) / 3600
    out = out.withColumn("age_hours", age)
    fresh = F.lit(True) if contract.max_age_hours is None else F.coalesce(F.col("age_hours") <= contract.max_age_hours, F.lit(False))
    return out.withColumn("fresh", fresh)


def type_problems(table: DataFrame, contract: Contract) -> DataFrame:
    """column, wanted, found, n_lost: columns of another type, and the values a cast would lose."""
    spark = table.sparkSession
    have = {f.name.lower(): f for f in table.schema}
    off = [f for f in contract.schema() if f.name.lower() in have and have[f.name.lower()].dataType != f.dataType]
    if not off:
        return spark.createDataFrame([], "column string, wanted string, found string, n_lost long")
    lost = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in off]
    counts = table.agg(*lost).unpivot([], [f.name for f in off], "column", "n_lost")
    of = lambda g: F.element_at(F.create_map(*(x for f in off for x in (F.lit(f.name), F.lit(g(f))))), F.col("column"))
    return counts.select("column", of(lambda f: f.dataType.simpleString()).alias("wanted"), of(lambda f: have[f.name.lower()].dataType.simpleString()).alias("found"), "n_lost")
