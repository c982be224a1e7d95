"""Intermediate tables in the folder that driver and executors share, and decisions about rows.

A written table cuts lineage and survives the loss of executors. The folder is the session's
``spark.checkpoint.dir``; only a single-machine session without that setting gets a local one. Tables made
inside ``scratch`` are deleted when the block ends, so an operator leaves no more behind than its lazy result needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Files whose rows are known by file and place; the list that names them is the only thing broadcast for it.
MOST_FILES = 100_000
_open: ContextVar[list[str] | None] = ContextVar("tidewell_scratch", default=None)
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; on a cluster without the setting this is an error, not a local path."""
    base = spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} must name a folder shared by driver and executors")
    # One folder a session; the session's own settings stay as they are.
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewell-"))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tidewell/{uuid.uuid4().hex}"
    if (made := _open.get()) is not None:
        made.append(path)
    return f"{path}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end, except those made by ``kept``."""
    made: list[str] = []
    token = _open.set(made)
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            delete(spark, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for what has to outlast the block of ``scratch`` that it is made in."""
    outer = _open.set(None)
    try:
        return materialize(df, name)
    finally:
        _open.reset(outer)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, whatever its extra columns are called."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = "_" + name
    return name


def tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row tag (long) that is the same whenever it is read, so that decisions can be joined back.

    Rows that are read straight from whole files are known by file and place in it, however the files are
    split; no copy is made. Of any other frame, or beyond ``MOST_FILES`` files, a tagged copy is written.
    """
    tag = fresh_name(docs, "__row")
    found = _whole_files(docs)
    if not found:
        return materialize(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged"), tag
    file, number = tag + "_file", tag + "_number"
    numbers = docs.sparkSession.createDataFrame([(h, i) for i, h in enumerate(found)], f"`{file}` long, `{number}` long")
    rows = docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(tag))
    rows = rows.join(F.broadcast(numbers), file)  # at most MOST_FILES rows
    return rows.select(*docs.columns, (F.shiftleft(number, 40) + F.col(tag)).alias(tag)), tag


def _whole_files(docs: DataFrame) -> list[int] | None:
    """The hashes of the files' names in order, if the rows are exactly those of whole files, each once."""
    if not 0 < len(docs.inputFiles()) <= MOST_FILES or "_metadata" in (c.lower() for c in docs.columns):
        return None
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        places = docs.select(F.xxhash64(path).alias("file"), path.alias("path"), row.alias("row"), row.cast("decimal(38,0)").alias("x"))
    except AnalysisException:  # no plain reader of files
        return None
    sums = [F.count(F.lit(1)).cast("decimal(20,0)").alias("n"), F.max("row").alias("top"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("squares")]
    files = places.groupBy("file").agg(*sums, F.min("path").alias("a"), F.max("path").alias("b"))
    n = F.col("n")
    whole = (n == F.col("top") + 1) & (F.col("sum") * 2 == n * (n - 1)) & (F.col("squares") * 6 == n * (n - 1) * (2 * n - 1)) & (F.col("a") == F.col("b"))
    got = files.select("file", whole.alias("whole")).collect()  # at most MOST_FILES rows
    return sorted(r["file"] for r in got) if all(r["whole"] for r in got) else None


_PAGE = 15  # a bitmap holds 2**15 tags


def decided(tags: DataFrame, tag: str, outlast: bool = True) -> DataFrame:
    """A table with one bit a row for the tags of ``tags``: an eighth of a byte for each row that they were chosen from."""
    at = F.col(tag)
    pages = tags.groupBy(F.shiftright(at, _PAGE).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("bits"))
    return (kept if outlast else materialize)(pages, "decided")


def only(rows: DataFrame, tag: str, pages: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose tag is set in ``decided`` pages, or the ``others``. Spark broadcasts the pages below its own threshold and shuffles beyond it."""
    page, bits = fresh_name(rows, "__page"), fresh_name(rows, "__bits")
    pages = pages.select(F.col("page").alias(page), F.col("bits").alias(bits))
    joined = rows.withColumn(page, F.shiftright(tag, _PAGE)).join(pages, page, "left" if others else "inner")
    bit = F.col(tag).bitwiseAND(F.lit((1 << _PAGE) - 1))
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return joined.where(~F.coalesce(is_set, F.lit(False)) if others else is_set).select(*rows.columns)
