"""Splits, training, batch scoring with one model or one per arm, and the inference log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cohorts import cohort
from .boosting import boost

#: Columns of a scored table that are no model input.
NOT_FEATURES = ["customer_id", "application_id", "class", "batch_date", "variant", "model_version", "scored_at", "prediction", "prediction_score", "ground_truth", "split"]
THRESHOLD = 0.30


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns that are not excluded."""
    out = set(NOT_FEATURES if exclude is None else exclude)
    return [c for c, t in df.dtypes if c not in out and (t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"))]


def stratified_split(df: DataFrame, label: str, key: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with split 'train' or 'test' by a hash of label and key: repeatable, and even in every class."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(10_000))
    return df.withColumn("split", F.when(draw < test_percent * 100, "test").otherwise("train"))


def exact_split(df: DataFrame, label: str, key: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with split 'train' or 'test', each class's test rows being exactly its percentage, rounded half up.

    The rows of a class with the smallest CRC-32 of seed and key are its test rows, ties by the key. The boundary is found by two
    histograms of the hash, of its upper and of its lower half, and among the few rows with just that hash by the key, so
    nothing is sorted in one task. Rows of a class with one key come out on different sides only if the boundary runs through them.
    """
    draw = F.crc32(F.concat(F.lit(f"split {seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = df.withColumns({"__class": F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-")), "__draw": draw})
    high, low = F.shiftright("__draw", 16), F.col("__draw").bitwiseAND(F.lit(0xFFFF))

    def crossed(counts: DataFrame, bin_: str) -> DataFrame:
        """__class, the bin in which the running count passes what is wanted, and what is wanted of that bin."""
        upto = F.sum("n").over(Window.partitionBy("__class").orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))  # at most 65,536 bins
        placed = counts.withColumn("upto", upto).where((F.col("want") <= F.col("upto")) & (F.col("want") > F.col("upto") - F.col("n")))
        return placed.select("__class", bin_, (F.col("want") - F.col("upto") + F.col("n")).alias("want"))

    sizes = rows.groupBy("__class").agg(F.floor((F.count(F.lit(1)) * test_percent + 50) / 100).cast("long").alias("want"))
    top = rows.groupBy("__class", high.alias("__high")).agg(F.count(F.lit(1)).alias("n")).join(sizes, "__class")
    first = crossed(top, "__high")
    inside = rows.join(first, (rows["__class"] == first["__class"]) & (high == first["__high"]), "left_semi")
    fine = inside.groupBy("__class", low.alias("__low")).agg(F.count(F.lit(1)).alias("n")).join(first.select("__class", "want"), "__class")
    second = crossed(fine, "__low")
    ends = first.drop("want").join(second, "__class").select("__class", (F.shiftleft("__high", 16) + F.col("__low")).alias("__end"), F.col("want").alias("__want"))
    marked = rows.join(ends, "__class", "left")
    # Only rows at the boundary have a place among each other; a class of n rows has some n / 2**32 of them.
    at_end = F.coalesce(F.col("__draw") == F.col("__end"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("__class").orderBy(key))
    rest = marked.where(~at_end).withColumn("__test", F.coalesce(F.col("__draw") < F.col("__end"), F.lit(False)))
    both = rest.unionByName(marked.where(at_end).withColumn("__test", place <= F.col("__want")))
    return both.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).select(*df.columns, "split")


#: Rows that are worth a task of their own, and the most that a task of a full cluster gets.
LEAST_ROWS, MOST_ROWS = 50_000, 1_000_000


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in tasks of even counts and in a fixed order, whatever files or partitions they come from; a task a core, or equally many for each."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores * -(-n // (cores * MOST_ROWS)) if n > cores * MOST_ROWS else max(1, min(cores, -(-n // LEAST_ROWS)))
    return rows.repartition(tasks, *order).sortWithinPartitions(*order)


def train_classifier(train: DataFrame, features: list[str], label: str = "class", kind: str = "gbt", rounds: int = 200, rate: float = 0.05, seed: int = 42, key: str = "application_id") -> PipelineModel:
    """Medians for missing values, then boosted trees (or ``kind="logistic"``), all in Spark.

    A tenth of the rows, by a hash of ``key``, stops the boosting when it gains no more there; ``rounds`` is the most. For it the rows
    are prepared once, dealt evenly and kept on the executors' disks.
    """
    filled = [f"__{c}" for c in features]
    imputer = Imputer(strategy="median", inputCols=features, outputCols=filled)
    rows = train.drop("prediction", "probability", "rawPrediction").withColumns({c: F.col(c).cast("double") for c in features}).withColumn("__label", F.col(label).cast("double"))
    if kind == "gbt":
        rows = rows.select(key, *features, "__label", (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10)) == 0).alias("__held_out"))
        rows = _dealt(rows, [key, *features]).persist(StorageLevel.DISK_ONLY)
        try:
            medians = imputer.fit(rows)
            return PipelineModel([medians, boost(medians.transform(rows), filled, "__label", "__held_out", key, rounds, rate, seed)])
        finally:
            rows.unpersist()
    stages = [imputer, VectorAssembler(inputCols=filled, outputCol="__features", handleInvalid="keep")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="__features", labelCol="__label", maxIter=50, standardization=True)]).fit(rows)


def score_batch(df: DataFrame, model: Transformer, features: list[str], version: str, scored_at: str) -> DataFrame:
    """``df`` with prediction_score (probability of the event), model_version and scored_at (a parameter: reruns agree)."""
    rows = df.select(*(c for c in df.columns if c not in ("prediction", "prediction_score")))
    scored = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in features}))
    out = {c: scored[c].cast(df.schema[c].dataType).alias(c) for c in rows.columns}
    return scored.select(*out.values(), vector_to_array("probability")[1].alias("prediction_score")).withColumns({"model_version": F.lit(version), "scored_at": F.lit(scored_at).cast("timestamp")})


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: list[str], version: str, scored_at: str) -> DataFrame:
    """The same for a model that is no Spark transformer: ``predict`` gets Arrow batches of the feature columns."""

    @F.pandas_udf("double")
    def run(rows: pd.DataFrame) -> pd.Series:
        return predict(rows)

    score = run(F.struct(*features))
    return df.withColumns({"prediction_score": score, "model_version": F.lit(version), "scored_at": F.lit(scored_at).cast("timestamp")})


def score_arms(df: DataFrame, models: dict[str, tuple[Transformer, str]], features: list[str], key: str, salt: str, split_percent: int, scored_at: str) -> DataFrame:
    """Each row scored by its arm's model ('A' and 'B': model, version); every row comes out once."""
    assigned = df.withColumn("variant", cohort(key, salt, split_percent))
    scored = [score_batch(assigned.where(F.col("variant") == arm), model, features, version, scored_at) for arm, (model, version) in sorted(models.items())]
    out = scored[0]
    for other in scored[1:]:
        out = out.unionByName(other)
    return out


def score_arms_with(df: DataFrame, arms: dict[str, tuple[Callable[[pd.DataFrame], pd.Series], str]], features: list[str], key: str, salt: str, split_percent: int, scored_at: str) -> DataFrame:
    """``score_arms`` for models that are plain functions, in one pass: each Arrow batch goes to the functions of the arms that it has rows of."""

    @F.pandas_udf("double")
    def run(variant: pd.Series, rows: pd.DataFrame) -> pd.Series:
        out = pd.Series(float("nan"), index=rows.index)
        for arm, (predict, _) in arms.items():
            own = variant == arm
            if own.any():
                out[own] = predict(rows[own])
        return out

    assigned = df.withColumn("variant", cohort(key, salt, split_percent))
    version = F.coalesce(*(F.when(F.col("variant") == arm, version) for arm, (_, version) in arms.items()))
    return assigned.withColumns({"prediction_score": run("variant", F.struct(*features)), "model_version": version, "scored_at": F.lit(scored_at).cast("timestamp")})


def as_class(score: Column | str = "prediction_score", threshold: float = THRESHOLD) -> Column:
    """1.0 from the threshold on, else 0.0; an unknown score stays unknown."""
    value = F.col(score) if isinstance(score, str) else score
    return (value >= threshold).cast("double")


def inference_log(scored: DataFrame, monitored: list[str], score: str = "prediction", threshold: float = THRESHOLD, key: str = "customer_id") -> DataFrame:
    """The log's shape: key and arm if there are any, monitored columns that exist, class, score, version, time, empty label."""
    kept = [c for c in [key, "variant", *monitored] if c in scored.columns]
    return scored.select(
        *dict.fromkeys(kept),
        as_class(score, threshold).alias("prediction"),
        F.col(score).cast("double").alias("prediction_score"),
        "model_version",
        "scored_at",
        F.lit(None).cast("double").alias("ground_truth"),
    )


def baseline_snapshot(scored: DataFrame, monitored: list[str], label: str = "class", threshold: float = THRESHOLD) -> DataFrame:
    """The training distribution to measure drift against, with class and score both, as the log has them."""
    kept = [c for c in monitored if c in scored.columns]
    return scored.select(*kept, as_class("prediction_score", threshold).alias("prediction"), "prediction_score", F.col(label).cast("double").alias("ground_truth"), "model_version", "scored_at")


def run_summary(scored: DataFrame, score: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """rows and mean, least and greatest score (4 places) of a scoring run, by arm if asked."""
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(score), 4).alias("mean_pd"), F.round(F.min(score), 4).alias("min_pd"), F.round(F.max(score), 4).alias("max_pd")
    )


def event_rate(df: DataFrame, label: str = "class") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("event_rate"))


def latest_per_key(df: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(by))
    return df.withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")
