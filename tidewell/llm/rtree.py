"""Hard negatives by best-first search in R-trees that sort-tile-recursive packing fills.

Rows are cut into tiles by label and then by the two widest dimensions, with distributed sorts; every tile is packed into a
small R-tree (further dimensions, full leaves) and written. Every row is indexed. A node's minimum bounding box gives an
interval for its rows' inner products with an anchor, coordinate by coordinate; a queue visits boxes by their upper
ends and leaves out those outside every score window or strictly below the k-th best score so far.

Trees are dealt into groups, a task reads the trees of a group and then streams the anchors past them, so no task holds
more than a group of trees and a batch of anchors. Each anchor first asks the square root of all groups; the k-th score found
there bounds what the other groups are asked. The anchors are the stated query set, each meets every group of trees once.
"""

from __future__ import annotations

import heapq
import io
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions
from .store import kept, materialize, scratch

TILE_ROWS, LEAF_ROWS, FANOUT, ROWS_A_GROUP = 2048, 64, 8, 1 << 19
_NO_END = 1 << 62
_EXACT = 2.0**53  # whole numbers below it are exact as doubles


def str_order(x: np.ndarray, leaf: int, dims: list[int]) -> list[np.ndarray]:
    """The leaves of a packing: rows sorted by the first of ``dims`` into slabs, each slab by the next, cut into full leaves."""

    def cut(rows: np.ndarray, dims: list[int]) -> list[np.ndarray]:
        rows = rows[np.argsort(x[rows, dims[0]], kind="stable")] if dims else rows
        if len(dims) <= 1:
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        leaves = -(-len(rows) // leaf)
        slab = -(-leaves // math.ceil(leaves ** (1 / len(dims)))) * leaf
        return [p for i in range(0, len(rows), slab) for p in cut(rows[i : i + slab], dims[1:])]

    return cut(np.arange(len(x)), dims)


def quantized(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; shorter vectors are padded with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
    return out


def packed_tree(ids: list, rows: np.ndarray, x: np.ndarray, label: str, leaf: int = LEAF_ROWS, fanout: int = FANOUT) -> bytes:
    """A tree as bytes: leaves first, each level after the one below, the root last."""
    widest = np.argsort(-x.var(axis=0), kind="stable")[:3].tolist() if x.size else []
    parts = str_order(x, leaf, widest)
    order = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    first, last = [0, *ends[:-1].tolist()], ends.tolist()
    low, high = [x[p].min(axis=0) for p in parts], [x[p].max(axis=0) for p in parts]
    begin, end = 0, len(parts)
    while end - begin > 1:
        for i in range(begin, end, fanout):
            j = min(i + fanout, end)
            first.append(i)
            last.append(j)
            low.append(np.min(low[i:j], axis=0))
            high.append(np.max(high[i:j], axis=0))
        begin, end = end, len(first)
    small = next((t for t in (np.int8, np.int16, np.int32) if not x.size or np.abs(x).max() < np.iinfo(t).max), np.float64)
    out = io.BytesIO()
    known = np.array([i is not None for i in ids])
    np.savez(
        out, ids=np.array([i if i is not None else 0 for i in ids], np.int64)[order], known=known[order], rows=rows[order], x=x[order].astype(small), leaves=len(parts),
        first=first, last=last, low=np.array(low).reshape(len(first), -1).astype(small), high=np.array(high).reshape(len(first), -1).astype(small), label=label,
    )
    return out.getvalue()


class Tree:
    """A packed tree, read for searching."""

    def __init__(self, payload: bytes) -> None:
        held = np.load(io.BytesIO(payload))
        self.ids, self.known, self.rows, self.x = held["ids"], held["known"], held["rows"], held["x"]
        self.low, self.high = held["low"].astype(np.float64), held["high"].astype(np.float64)
        self.first, self.last, self.leaves, self.label = held["first"].tolist(), held["last"].tolist(), int(held["leaves"]), str(held["label"])
        self.most = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))

    def exact(self, q: np.ndarray) -> bool:
        """Whether inner products with ``q`` are exact as sums of doubles."""
        return len(q) * self.most * np.abs(q).max(initial=0) < _EXACT

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, node): least and greatest inner product that the node's box allows; no ends where doubles aren't exact."""
        q = anchors[:, : self.low.shape[1]]
        low, high = self.low[:, : q.shape[1]], self.high[:, : q.shape[1]]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        rough = [i for i in range(len(q)) if not self.exact(q[i])]
        least[rough], most[rough] = -np.inf, np.inf
        return least, most

    def scores(self, leaf: int, q: np.ndarray) -> np.ndarray:
        x = self.x[self.first[leaf] : self.last[leaf]]
        q = q[: x.shape[1]]
        if self.exact(q):
            return x[:, : len(q)].astype(np.float64) @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=False)) for r in x], dtype=object)


class Ask:
    """One question of an anchor: the best k scores in [low, high], and the score below which none can matter any more."""

    def __init__(self, low: int, high: int, bound: int, k: int) -> None:
        self.high, self.floor, self.k, self.best = high, max(low, bound), k, []

    def add(self, tree: Tree, leaf: int, scores: np.ndarray, own: int) -> None:
        at = tree.first[leaf]
        hits = np.flatnonzero((scores >= self.floor) & (scores <= self.high) & (tree.rows[at : at + len(scores)] != own))
        for i in hits.tolist():
            j = at + i
            insort(self.best, (-int(scores[i]), not tree.known[j], int(tree.ids[j]), int(tree.rows[j])))
        if len(self.best) >= self.k:
            del self.best[self.k :]
            self.floor = max(self.floor, -self.best[-1][0])

    def wants(self, least: float, most: float) -> bool:
        return most >= self.floor and least <= self.high


def search(trees: list[Tree], least: list[np.ndarray], most: list[np.ndarray], q: np.ndarray, own: int, windows: list[Ask]) -> int:
    """Fill the windows of one anchor from a forest, given its row of every tree's intervals; the number of nodes visited."""
    queue = [(-m[-1], t, len(m) - 1) for t, m in enumerate(most)]
    heapq.heapify(queue)
    seen = 0
    while queue:
        top, t, node = heapq.heappop(queue)
        if -top < min(w.floor for w in windows):
            break
        if not any(w.wants(least[t][node], -top) for w in windows):
            continue
        seen += 1
        tree = trees[t]
        if node < tree.leaves:
            scores = tree.scores(node, q)
            for w in windows:
                if w.wants(least[t][node], -top):
                    w.add(tree, node, scores, own)
        else:
            for child in range(tree.first[node], tree.last[node]):
                heapq.heappush(queue, (-most[t][child], t, child))
    return seen


def _searcher(scale: float, k: int, chunk: int = 128):
    """Batches of (group, kind, payload, anchor, label, same, vec, asks), in order of group and kind, to the windows' rows."""

    def answers(trees: list[Tree], rows: list[dict]) -> pa.RecordBatch:
        out: list[tuple] = []
        q = quantized([r["vec"] for r in rows], scale)
        ends = [t.intervals(q) for t in trees]
        for i, r in enumerate(rows):
            mine = [j for j, t in enumerate(trees) if (t.label == r["label"]) == r["same"]]
            windows = [Ask(a["low"], a["high"], a["bound"], k) for a in r["asks"]]
            search([trees[j] for j in mine], [ends[j][0][i] for j in mine], [ends[j][1][i] for j in mine], q[i], r["anchor"], windows)
            out += [(r["anchor"], a["ask"], -s, None if lost else n, row) for a, w in zip(r["asks"], windows, strict=True) for s, lost, n, row in w.best]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "ask", "score", "id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees = None, []
        for batch in batches:
            groups, kinds = batch.column("group").to_pylist(), batch.column("kind").to_pylist()
            at = 0
            while at < len(groups):
                end = at + 1
                while end < len(groups) and end - at < chunk and groups[end] == groups[at] and kinds[end] == kinds[at]:
                    end += 1
                if groups[at] != group:
                    group, trees = groups[at], []
                part = batch.slice(at, end - at)
                if kinds[at] == 0:
                    trees += [Tree(p) for p in part.column("payload").to_pylist()]
                elif trees:
                    yield answers(trees, part.select(["anchor", "label", "same", "vec", "asks"]).to_pylist())
                at = end

    return run


_ANSWERS = "anchor long, ask int, score long, id long, row long"
_ASKS = "array<struct<ask: int, low: bigint, high: bigint, bound: bigint>>"


def _best(answers: DataFrame, k: int) -> DataFrame:
    """anchor, ask, rank, score, id: of at most k answers a group the first k."""
    order = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(trees: DataFrame, anchors: DataFrame, asks: DataFrame, same: bool, k: int, groups: int, scale: float) -> DataFrame:
    """anchor, ask, rank, score, id: the best k rows of the anchors' own label or of all others, in each ask's window."""
    home = math.isqrt(groups - 1) + 1 if groups > 1 else 1

    def round_(asks: DataFrame, begin: int, end: int) -> DataFrame:
        listed = asks.groupBy("anchor").agg(F.collect_list(F.struct("ask", "low", "high", "bound")).cast(_ASKS).alias("asks"))
        turn = F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))
        sent = anchors.join(listed, "anchor").withColumn("turn", turn).withColumn("group", F.pmod(F.xxhash64("anchor") + F.col("turn"), F.lit(groups)))
        sent = sent.select("group", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "anchor", "label", F.lit(same).alias("same"), "vec", "asks")
        both = trees.select("group", F.lit(0).alias("kind"), "payload").unionByName(sent, allowMissingColumns=True)
        dealt = both.repartition("group").sortWithinPartitions("group", "kind")
        return materialize(dealt.mapInArrow(_searcher(scale, k), _ANSWERS), "answers")

    found = round_(asks, 0, home)
    if home < groups:
        kth = _best(found, k).where(F.col("rank") == k).select("anchor", "ask", F.col("score").alias("kth"))
        bounded = asks.join(kth, ["anchor", "ask"], "left").withColumn("bound", F.greatest("bound", "kth")).drop("kth")
        found = found.unionByName(round_(bounded, home, groups))
    return _best(found, k)


def _tiles(points: DataFrame, tile_rows: int) -> DataFrame:
    """row, label, slab, tile: tiles of at most ``tile_rows`` rows of one label, by the two widest dimensions."""
    widths = points.select(F.posexplode("vec")).groupBy("pos").agg(F.var_pop(F.col("col").cast("double")).alias("width"))
    dims = [r["pos"] for r in widths.orderBy(F.desc("width"), "pos").limit(2).collect()]
    at = lambda i: F.get("vec", F.lit(dims[i])).cast("double") if i < len(dims) else F.lit(0.0)
    sizes = points.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles"))
    slab_rows = F.ceil(F.col("tiles") / F.ceil(F.sqrt("tiles"))) * tile_rows
    placed = positions(points.select("row", "label", at(0).alias("a"), at(1).alias("b")), "label", ["a", "row"])
    slabs = placed.join(sizes.select("label", slab_rows.alias("slab_rows")), "label").select("row", F.struct("label", F.floor(F.col("pos") / F.col("slab_rows")).alias("slab")).alias("of"), "b")
    return positions(slabs, "of", ["b", "row"]).select("row", "of.label", "of.slab", F.floor(F.col("pos") / tile_rows).alias("tile"))


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile_rows: int = TILE_ROWS, leaf_rows: int = LEAF_ROWS, groups: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every row that meets ``anchors`` and each of its best ``positives`` rows of the same label (others than itself): the best
    ``negatives`` rows of another label with low % <= negative / positive score <= high %, ranked from 1. Scores are inner products of
    floor(scale * x), exact whole numbers; higher first, ties by the smaller identifier, rows without one last. Rows with
    a null label, a null vector or a null or non-finite component take no part. Repeated rows are rows of their own; a
    shorter vector counts as padded with zeros, an empty one scores 0. Anchors without positives or negatives give no
    rows, like an empty table; other columns are ignored. A score beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))
    with scratch(spark):
        rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
        points = kept(rows, "points")
        n = points.count()
        tiles = _tiles(points, tile_rows)
        n_tiles = points.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("n")).agg(F.sum("n")).first()[0] or 1
        groups = groups or min(n_tiles, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_GROUP)))
        placed = points.select("row", "id", "vec").join(tiles, "row").withColumn("group", F.pmod(F.xxhash64("label", "slab", "tile"), F.lit(groups)))

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row")
            x = quantized(part["vec"].tolist(), scale)
            ids = [None if lost else int(i) for i, lost in zip(part["id"].fillna(0), part["id"].isna(), strict=True)]
            return pd.DataFrame({"group": [part["group"].iloc[0]], "payload": [packed_tree(ids, part["row"].to_numpy(), x, part["label"].iloc[0], leaf_rows)]})

        # A tile has tile_rows rows at most. Identifiers travel as decimals, which keep nulls and all 64 bits.
        of_tile = placed.withColumn("id", F.col("id").cast("decimal(20,0)")).groupBy("label", "slab", "tile")
        trees = kept(of_tile.applyInPandas(pack, "group long, payload binary"), "trees")
        asking = points.where("asks").select(F.col("row").alias("anchor"), "id", "label", "vec")
        sent = asking.drop("id")
        open_ = asking.select("anchor", F.lit(0).alias("ask"), *(F.lit(v).cast("long").alias(c) for c, v in (("low", -_NO_END), ("high", _NO_END), ("bound", -_NO_END))))
        near = kept(_asked(trees, sent, open_, True, positives, groups, scale), "positives")
        floor = lambda text: F.expr(f"(({text}) - pmod({text}, 100)) div 100")
        windows = near.select("anchor", F.col("rank").alias("ask"), (-floor(f"{-low} * score")).alias("low"), floor(f"{high} * score").alias("high"), F.lit(-_NO_END).cast("long").alias("bound"))
        far = kept(_asked(trees, sent, windows.where("low <= high"), False, negatives, groups, scale), "negatives")
    pairs = near.select("anchor", F.col("rank").alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("anchor", "ask", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "ask"])
    return out.join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
