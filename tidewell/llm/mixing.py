"""Mixing sources to target weights along a low-discrepancy schedule.

Each source's documents are shuffled by a hash and cut into blocks of equal words. The schedule has one
slot a block: golden-ratio points go through the cumulative weights and name each slot's source, slots are
ranked within their source, and rank k takes block k of the source, from its start again after each pass.
Since the points fill every interval evenly, any stretch of the mix has the sources in their shares.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import block_of, running_sum
from .store import fresh_name, kept, materialize, scratch, tagged

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most_passes: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """lane, source, source_size, target: shares by weight, the excess over ``most_passes`` reshared.

    Sources take the weights of ``cycle`` in turn, by code point with null last. With the sources ordered
    by the level at which they fill up, the reshared level is the first that the next source can hold.
    One row a source: the only windows over everything here are over the list of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    lanes = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    lanes = lanes.withColumn("lane", F.row_number().over(order) - 1)
    lanes = lanes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("lane") % len(cycle) + 1).cast("int")))
    fill = Window.orderBy("full_at", "lane")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lanes = lanes.withColumn("most", F.col("source_size") * most_passes).withColumn("full_at", F.col("most") / F.col("weight"))
    lanes = lanes.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    lanes = lanes.withColumn("level", F.col("rest") / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "lane", "level"))).over(every)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return lanes.select("lane", "source", "source_size", "most", target.alias("target"))


def _golden(i):
    """The fraction of i times the golden ratio, exact enough for any long: high and low half apart."""
    getcontext().prec = 60
    step = (Decimal(5).sqrt() - 1) / 2
    half = 1 << 26
    big = float(step * half % 1)
    x = F.floor(i / half) * F.lit(big) + (i % half) * F.lit(float(step))
    return x - F.floor(x)


def schedule(lanes: DataFrame, block_words: int) -> DataFrame:
    """slot, lane, rank, block, words: the mix as a sequence of blocks.

    ``lanes`` has lane, source_size and words (what the mix takes of the source). A source gets exactly its
    number of slots: points beyond it are passed over, slots that the points have not reached come last.
    """
    spark = lanes.sparkSession
    size, words, block = F.col("source_size"), F.col("words"), F.lit(block_words)
    lanes = lanes.where("words > 0").withColumn("blocks", F.ceil(size / block)).withColumn("rest", words % size)
    lanes = lanes.withColumn("slots", F.floor(words / size) * F.col("blocks") + F.ceil(F.col("rest") / block))
    lanes = materialize(lanes, "lanes")
    total, n_lanes = lanes.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    cells = 4 * n_lanes + 1
    upto = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    spans = lanes.withColumn("hi", F.sum("slots").over(upto) / F.lit(float(max(total, 1)))).withColumn("lo", F.col("hi") - F.col("slots") / F.lit(float(max(total, 1))))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells - 1e-6).cast("long"), F.floor(F.col("hi") * cells + 1e-6).cast("long"))))
    points = spark.range(total).select(F.col("id").alias("slot"), _golden(F.col("id") + 1).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    hit = points.join(spans.select("lane", "lo", "hi", "cell"), "cell").where("x >= lo and x < hi").dropDuplicates(["slot"])
    hit = hit.select("slot", "lane", F.shiftright("slot", 16).alias("stretch"), F.lit(1).alias("one"))
    ranked = running_sum(hit, ["lane"], "stretch", ["slot"], "one", "rank").select("slot", "lane", "rank")
    reached = ranked.groupBy("lane").agg(F.count(F.lit(1)).alias("reached"))
    missing = lanes.join(reached, "lane", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < slots")
    missing = missing.select("lane", F.explode(F.sequence("reached", F.col("slots") - 1)).alias("rank"))
    missing = missing.select((F.lit(total) + F.col("rank")).alias("slot"), "lane", "rank")
    taken = ranked.unionByName(missing).join(lanes, "lane").where("rank < slots")
    block_no = F.col("rank") % F.col("blocks")
    whole = F.least(block, size - block_no * block)
    last = F.col("rest") - (F.ceil(F.col("rest") / block) - 1) * block
    trimmed = F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), last).otherwise(whole)
    return taken.select("slot", "lane", "rank", block_no.cast("long").alias("block"), trimmed.cast("long").alias("words"))


def _shuffled(docs: DataFrame, block_words: int, most_passes: int, seed: int, rows_a_block: int, tag: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with lanes, lanes, slots, places): what the mix takes, and where each row lies in its source's shuffled order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).bitwiseAND(F.lit(2**63 - 1)).alias("order_hash"),
        (F.col(tag) if tag else F.monotonically_increasing_id()).alias("tag"),
    )
    rows = materialize(rows, "sizes")
    lanes = source_targets(rows, most_passes).withColumn("words", F.least(F.col("most"), F.floor(F.col("target") + 0.5)).cast("long"))
    lanes = materialize(lanes, "targets")
    slots = schedule(lanes.select("lane", "source_size", "words"), block_words)
    count = rows.count()
    placed = rows.join(lanes, rows["source"].eqNullSafe(lanes["source"])).drop(lanes["source"])
    own = placed.where("size > 0").select("tag", "lane", "size", "order_hash").withColumn("stretch", block_of(F.col("order_hash"), max(1, count // rows_a_block)))
    return placed, lanes, slots, running_sum(own, ["lane"], "stretch", ["order_hash", "tag"], "size", "start")


def mix_sources(docs: DataFrame, block_words: int = 2048, most_passes: int = 3, seed: int = 7, rows_a_block: int = 4096, tag: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (and the tag, if named).

    ``taken`` counts the words of the row that the mix has, repeats included: never over ``most_passes``
    times its size. A null or empty text has size 0 and is never taken; a null source is a source, the last.
    Each source's taken words equal its target to the nearest word. The order depends only on the seed and
    the row, so reruns agree; repeated rows are rows of their own. An empty table gives an empty result.
    """
    placed, _, slots, own = _shuffled(docs, block_words, most_passes, seed, rows_a_block, tag)
    own = own.withColumn("stop", F.col("start") + F.col("size"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words)
    pieces = own.withColumn("block", F.explode(F.sequence(first, last)))
    at = F.col("block") * block_words
    pieces = pieces.select("tag", "lane", "block", (F.greatest("start", at) - at).alias("since"), (F.least(F.col("stop"), at + block_words) - at).alias("until"))
    words = F.greatest(F.lit(0), F.least("until", "words") - F.col("since"))
    taken = pieces.join(slots.drop("rank"), ["lane", "block"]).groupBy("tag").agg(F.sum(words).alias("taken"))
    found = placed.join(taken, "tag", "left")
    return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *([F.col("tag").alias(tag)] if tag else []))


def mixed_documents(docs: DataFrame, block_words: int = 2048, most_passes: int = 3, seed: int = 7, rows_a_block: int = 4096) -> DataFrame:
    """The mix itself, in the order of its slots: whole documents, each where the block begins that it begins in.

    A source goes through its shuffled documents as often as its target holds them; of the one document in
    which the target ends, a row has as many words as are left, so every source meets its target to the
    word. Other columns are the document's own. Rows without words are never taken; the further cases are
    those of ``mix_sources``, whose ``taken`` the words of a document's rows add up to.
    """
    copy, tag = tagged(docs)
    slot, start, words = (fresh_name(copy, c) for c in ("__slot", "__start", "__words"))
    with scratch(docs.sparkSession):
        _, lanes, slots, own = _shuffled(copy, block_words, most_passes, seed, rows_a_block, tag)
        lanes = lanes.select("lane", "source_size", "words", F.ceil(F.col("source_size") / block_words).alias("blocks"))
        own = own.join(lanes, "lane").where("words > 0")  # one row a source
        passes = F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int"))
        turns = own.withColumn("turn", F.explode(passes)).withColumn("left", F.col("words") - F.col("turn") * F.col("source_size") - F.col("start")).where("left > 0")
        turns = turns.withColumn("rank", F.col("turn") * F.col("blocks") + F.floor(F.col("start") / block_words))
        placed = turns.join(slots.select("lane", "rank", "slot"), ["lane", "rank"])
        placed = kept(placed.select(F.col("tag").alias(tag), F.col("slot").alias(slot), F.col("start").alias(start), F.when(F.col("left") < F.col("size"), F.col("left")).alias(words)), "placed")
    text = next(c for c in docs.columns if c.lower() == "text")
    led = F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col(words).isNull(), F.col(text)).otherwise(F.array_join(F.slice(led, F.lit(1), F.col(words).cast("int")), ""))
    mix = copy.join(placed, tag).withColumn(text, cut.cast(dict(docs.dtypes)[text]))
    return mix.repartitionByRange(slot, start).sortWithinPartitions(slot, start).select(*docs.columns)
