"""Shards of near-equal bytes by a k-d tree over document metadata, with DataFrame functions only.

What the tree places are groups of equal texts; only a group that outweighs a leaf is cut, into pieces of at most
an eighth of one. A node with k leaves is split at the weighted k//2 : k - k//2 point of its widest dimension, the
weights being bytes. The split point is found by distributed histograms: along the dimension first, then, inside the
boundary bin, by weight, so that heavy groups are not the ones at the boundary, and last by a hash. The nodes'
extents, histograms and cuts are tables like the groups themselves: nothing comes to the driver but the total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import block_of, running_sum
from .store import kept, materialize, scratch

BINS = 1024
_DIMS = ["by_lang", "by_source", "by_size", "by_id"]
_GROUP = ["text_hash", "text_crc32", "size"]


def _metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the coordinates in [0, 1] and hashes; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lane = lambda c: F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20)), F.lit(0.0))
    # Identifiers are spread over [0, 1] by their whole range.
    low, high = docs.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    by_id = (F.col("doc_id").cast("double") - F.lit(low or 0.0)) / F.lit(max((high or 0.0) - (low or 0.0), 1.0))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        lane("lang").alias("by_lang"),
        lane("source").alias("by_source"),
        (F.log2(F.octet_length(text) + F.lit(1.0)) / 31).alias("by_size"),
        F.coalesce(by_id, F.lit(0.0)).alias("by_id"),
        F.xxhash64("doc_id", text).bitwiseAND(F.lit(2**63 - 1)).alias("order_hash"),
    )


def _widest(of) -> Column:
    """``of`` the widest dimension (the first of ties)."""
    width = [F.col(f"high_{d}") - F.col(f"low_{d}") for d in _DIMS]
    most = F.greatest(*width)
    return reduce(lambda rest, i: F.when(width[i] >= most, of(i)).otherwise(rest), reversed(range(len(_DIMS))), F.lit(None))


def _cross(rows: DataFrame, bin_: str, target: str, cut: str, rest: str, nearest: bool = False) -> DataFrame:
    """node, cut, rest: the bin in which the running weight of each node passes its target, and what is left of the target there."""
    sums = rows.groupBy("node", bin_).agg(F.sum("weight").alias("w"), F.first(target).alias("t"))
    by_bin = Window.partitionBy("node").orderBy(bin_)  # at most BINS rows a node
    upto = F.sum("w").over(by_bin.rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).withColumn("last", F.lead(bin_).over(by_bin).isNull())
    here = sums.where((F.col("t") < F.col("upto")) | F.col("last")).groupBy("node").agg(F.min(F.struct(bin_, "t", "w", "upto")).alias("at"))
    left = F.col("at.t") - (F.col("at.upto") - F.col("at.w"))
    at = F.col(f"at.{bin_}")
    return here.select("node", (at + F.when(left > F.col("at.w") / 2, 1).otherwise(0) if nearest else at).alias(cut), left.alias(rest))


def _split(units: DataFrame) -> DataFrame:
    """``units`` with every node of several leaves split in two; a node is named by its first leaf."""
    busy = units.where("leaves > 1")
    extents = [f(d).alias(f"{n}_{d}") for d in _DIMS for f, n in ((F.min, "low"), (F.max, "high"))]
    half = F.floor(F.col("leaves") / 2)
    nodes = busy.groupBy("node", "leaves").agg(F.sum("weight").alias("all"), *extents)
    nodes = materialize(
        nodes.select(
            "node",
            _widest(lambda i: F.lit(i)).alias("dim"),
            _widest(lambda i: F.col(f"low_{_DIMS[i]}")).alias("low"),
            _widest(lambda i: F.when(F.col(f"high_{_DIMS[i]}") > F.col(f"low_{_DIMS[i]}"), BINS / (F.col(f"high_{_DIMS[i]}") - F.col(f"low_{_DIMS[i]}"))).otherwise(0.0)).alias("scale"),
            (F.col("all") * half / F.col("leaves")).alias("target"),
        ),
        "nodes",
    )
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.get(F.array(*_DIMS), F.col("dim")) - F.col("low")) * F.col("scale")).cast("int")))
    binned = busy.join(nodes, "node").withColumn("bin", place)
    first = _cross(binned, "bin", "target", "cut", "rest")
    inside = binned.join(first, "node").where("bin = cut")
    second = materialize(first.join(_cross(inside, "weight_bin", "rest", "weight_cut", "weight_rest"), "node"), "cuts")
    inside = binned.join(second, "node").where("bin = cut and weight_bin = weight_cut")
    cuts = materialize(second.join(_cross(inside, "hash_bin", "weight_rest", "hash_cut", "hash_rest", nearest=True), "node").join(nodes, "node"), "cuts")
    rows = units.join(cuts.select("node", "dim", "low", "scale", "cut", "weight_cut", "hash_cut"), "node", "left").withColumn("bin", place)
    last = (F.col("weight_bin") < F.col("weight_cut")) | ((F.col("weight_bin") == F.col("weight_cut")) & (F.col("hash_bin") < F.col("hash_cut")))
    left = (F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & last)
    one = F.col("leaves") == 1
    node = F.when(one | left, F.col("node")).otherwise(F.col("node") + half)
    leaves = F.when(one, F.col("leaves")).when(left, half).otherwise(F.col("leaves") - half)
    return materialize(rows.withColumns({"node": node, "leaves": leaves}).select(*units.columns), "placed")


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, rows_a_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs``.

    The tree has ``shards`` leaves, or as many as bring a leaf to ``target_bytes``. Rows with equal texts share a
    shard unless they outweigh one together. A null text counts as empty and weighs its 8 bytes of overhead; null
    metadata count as the lowest coordinate. Repeated rows are rows of their own, an empty table gives
    an empty result. Slots are gapless from 0 in each shard. Needs the columns doc_id, text, lang, source;
    others are ignored.
    """
    with scratch(docs.sparkSession):
        rows = kept(_metadata(docs), "metadata")
        groups = rows.groupBy(*_GROUP).agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in _DIMS))
        groups = materialize(groups, "groups")
        total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        leaves = shards or max(1, -(-total // target_bytes))
        if leaves < 1:
            raise ValueError("there must be a shard")
        pieces = F.when(F.col("weight") * leaves > total, F.ceil(F.col("weight") * (8 * leaves) / F.lit(max(total, 1)))).otherwise(1).cast("int")
        groups = groups.withColumn("pieces", pieces)
        large = kept(groups.where("pieces > 1").select(*_GROUP, "pieces"), "large")  # fewer than leaves
        units = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        units = units.select(
            *_GROUP,
            "piece",
            (F.col("weight") / F.col("pieces")).alias("weight"),
            *_DIMS,
            F.least(F.lit(BINS - 1), F.floor(F.log2(F.col("weight") / F.col("pieces")) * 16)).cast("int").alias("weight_bin"),
            F.pmod(F.xxhash64(*_GROUP, "piece"), F.lit(BINS)).cast("int").alias("hash_bin"),
            F.lit(0).cast("long").alias("node"),
            F.lit(leaves).cast("long").alias("leaves"),
        )
        units = materialize(units, "units")
        for _ in range((leaves - 1).bit_length()):
            units = _split(units)
        units = kept(units.select(*_GROUP, "piece", F.col("node").cast("int").alias("shard")), "shards")
    count = rows.count()
    placed = rows.join(large, _GROUP, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("order_hash"), "pieces").cast("int"), F.lit(0)))
    placed = placed.join(units, [*_GROUP, "piece"]).select("doc_id", "size", "text_crc32", "order_hash", "shard", F.lit(1).alias("one"))
    placed = placed.withColumn("block", block_of(F.col("order_hash"), max(1, count // rows_a_block)))
    return running_sum(placed, ["shard"], "block", ["order_hash", "doc_id", "text_crc32", "size"], "one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
