"""Exact dedup by a tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition yields one run: its distinct digests, each with the row to keep and the number
of rows. Partitions then exchange runs in rounds (``fan_in`` runs meet in each, two for binomial
rounds): a round groups by (node, digest), which Spark executes as a sort-based merge, and retains one
verified entry per digest. A digest therefore brings at most ``fan_in`` rows to any group, however
many rows of the corpus share it, and the way back down passes through the runs for the same reason.
Entries are equal only if the 64-bit digest, the SHA-256 and the byte length all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import decided, materialize, only, scratch, tagged

_KEY = ["digest", "sha", "n_bytes"]


def digest_rows(docs: DataFrame, tag: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        tag.alias("tag"),
        F.xxhash64(text).alias("digest"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def merge_runs(digests: DataFrame, keep: str = "smallest", fan_in: int = 16) -> tuple[DataFrame, DataFrame]:
    """(leaf runs, root): the runs of the partitions and the merged run over all of them."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    best = {"smallest": F.min, "largest": F.max}[keep]
    # Rows without an identifier lose to any that has one.
    rank = F.struct((F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()).alias("has"), "doc_id", "tag")
    leaves = digests.groupBy("run", *_KEY).agg(best(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    top = digests.agg(F.max("run")).first()[0]
    runs, nodes = leaves.withColumnRenamed("run", "node"), (top or 0) + 1
    while nodes > 1:
        runs = (
            runs.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
            .groupBy("node", *_KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
        nodes = -(-nodes // fan_in)
    return leaves, runs.drop("node")


def duplicate_groups(digests: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """``digests`` with keep_id, group_size and kept; exactly one row of each group is kept."""
    leaves, root = merge_runs(digests, keep, fan_in)
    down = leaves.select("run", *_KEY).join(root, _KEY)
    return digests.join(down, ["run", *_KEY]).select(
        "doc_id",
        "tag",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, keep: str = "smallest", fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts form a group like any other. Of equal texts the row with
    the smallest (or ``keep="largest"``) identifier stays; a null identifier stays only if the group has
    no other, and of repeated rows with one identifier exactly one is kept. An empty table gives an
    empty result; further columns of ``docs`` are ignored.
    """
    rows = digest_rows(docs, F.monotonically_increasing_id(), id_col, text_col)
    rows = rows.withColumn("run", F.shiftright("tag", 33))
    return duplicate_groups(materialize(rows, "digests"), keep, fan_in).drop("tag")


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the cases are those of ``exact_groups``.

    The merged run names the rows to keep, so nothing goes back down the tree, and the texts are not exchanged.
    """
    copy, tag = tagged(docs)
    with scratch(docs.sparkSession):
        rows = materialize(digest_rows(copy, F.col(tag)).withColumn("run", F.spark_partition_id().cast("long")), "digests")
        stay = decided(merge_runs(rows, keep, fan_in)[1].select("best.tag"), "tag")
    return only(copy, tag, stay).select(*docs.columns)
