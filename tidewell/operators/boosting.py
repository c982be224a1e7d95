"""Boosted trees over blocks of binned features: those of ``pyspark.ml``'s GBTClassifier in far less memory.

That trainer keeps each row as objects, by estimate 200 bytes, and walks them five times a round. Here a feature value is its bin, one byte,
and a block of rows one Spark row of byte arrays; tasks count histograms of a level's nodes, and the driver picks splits from their sums.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

# Tasks get this module's functions themselves, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, BINS = 5, 32
#: Rows whose values give the candidate splits, as many as pyspark.ml takes; every row is binned and counted.
CANDIDATE_ROWS = 10_000
#: Gain of the held-out rows' loss, as a share of it, below which boosting stops: pyspark.ml's validationTol.
TOLERANCE = 0.01
#: Whether its rows are held out, then a byte a row and feature, a byte a row (-1 or 1) and a double a row (the margin).
Block = tuple[bool, bytes, bytes, bytes]


@dataclass
class Tree:
    """Nodes by heap index from 1 on: the feature and the last bin that goes left, and means; what is not split goes left with its mean."""

    feature: np.ndarray
    upto: np.ndarray
    mean: np.ndarray

    @staticmethod
    def empty() -> Tree:
        inner = 1 << DEPTH
        return Tree(np.zeros(inner, np.intp), np.full(inner, 255, np.uint8), np.zeros(2 * inner))

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """The node of each row on a level; bins: a row of bytes a feature."""
        flat, m = bins.reshape(-1), bins.shape[1]
        at, node = np.arange(m), np.ones(m, np.intp)
        for _ in range(level):
            node = 2 * node + (flat[self.feature[node] * m + at] > self.upto[node])
        return node


def candidate_splits(values: np.ndarray) -> np.ndarray:
    """Midpoints between values that cut them into bins of near equal counts; between all values if those are few."""
    most = min(BINS, len(values))
    found, counts = np.unique(values, return_counts=True)
    middles, upto = (found[:-1] + found[1:]) / 2, counts.cumsum()
    if len(middles) < most:
        return middles
    out, stride = [], len(values) / most
    for before, now, middle in zip(upto[:-1], upto[1:], middles, strict=True):
        target = stride * (len(out) + 1)
        if abs(before - target) < abs(now - target):
            out.append(middle)
    return np.array(out)


def _binned(rows: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(s, v, side="left").astype(np.uint8) for s, v in zip(splits, rows, strict=True)])


def _counted(bins: np.ndarray, slot: np.ndarray, residual: np.ndarray, slots: int) -> np.ndarray:
    """Of each feature and slot the sums of residuals and the counts by bin."""
    base, size = slot * BINS, slots * BINS
    out = np.empty((2, len(bins), size))
    for f, own in enumerate(bins):
        at = base + own
        out[0, f], out[1, f] = np.bincount(at, residual, size), np.bincount(at, minlength=size)
    return out.reshape(2, len(bins), slots, BINS)


def _residual(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return 4 * label / (1 + np.exp(2 * label * margin))


def _read(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(block[1], np.uint8).reshape(width, -1), np.frombuffer(block[2], np.int8), np.frombuffer(block[3])


def _blocks(rows: DataFrame, features: list[str], label: str, held: str, splits: list[np.ndarray]) -> RDD[Block]:
    """A block of the held-out and one of the other rows for each Arrow batch, with labels -1 and 1 and margins 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, out = (batch.column(c).to_numpy(zero_copy_only=False) for c in (label, held))
            if not np.isin(given, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            y, bins = (2 * given - 1).astype(np.int8), _binned([batch.column(f).to_numpy(zero_copy_only=False) for f in features], splits)
            for own in sorted({bool(x) for x in out}):
                at = out == own
                yield pa.RecordBatch.from_pydict({"held": [own], "bins": [bins[:, at].tobytes()], "label": [y[at].tobytes()]})

    found = rows.select(*features, label, held).mapInArrow(run, "held boolean, bins binary, label binary")
    return found.rdd.map(lambda r: (r[0], bytes(r[1]), bytes(r[2]), bytes(8 * len(r[2]))))


def _advanced(state: RDD[Block], tree: Tree, weight: float, width: int) -> RDD[Block]:
    """The blocks with the margins after one more tree."""

    def run(block: Block) -> Block:
        bins, _, margin = _read(block, width)
        return (*block[:3], (margin + weight * tree.mean[tree.nodes(bins, DEPTH)]).tobytes())

    return state.map(run)


def _level(state: RDD[Block], tree: Tree, level: int, first: bool, width: int) -> tuple[np.ndarray, float]:
    """The histograms of a level's nodes and, at the root, the held-out rows' mean loss (NaN without any). The first tree is fitted
    to the labels themselves. The driver gets one array a task, of 6 KB a node."""

    def run(blocks: Iterator[Block]) -> Iterator[tuple[np.ndarray, float, int]]:
        total, error, n = np.zeros((2, width, 1 << level, BINS)), 0.0, 0
        for block in blocks:
            if block[0] and level:
                continue
            bins, label, margin = _read(block, width)
            if block[0]:
                error, n = error + float(2 * np.log1p(np.exp(-2 * label * margin)).sum()), n + len(label)
            else:
                total += _counted(bins, tree.nodes(bins, level) - (1 << level), label.astype(float) if first else _residual(label, margin), 1 << level)
        yield total, error, n

    got = state.mapPartitions(run).collect()
    n = sum(g[2] for g in got)
    return sum(g[0] for g in got), sum(g[1] for g in got) / n if n else np.nan


def _split(tree: Tree, level: int, hist: np.ndarray, sizes: np.ndarray) -> bool:
    """Split the level's nodes where the variance falls most; whether any was. Of equal gains the first feature and bin is taken."""
    sums, counts = hist.transpose(0, 2, 1, 3)
    any_split = False
    for i, (s, n) in enumerate(zip(sums, counts, strict=True)):
        node = (1 << level) + i
        all_s, all_n = s[0].sum(), n[0].sum()
        if level == 0:
            tree.mean[1] = all_s / all_n
        tree.mean[2 * node] = tree.mean[2 * node + 1] = tree.mean[node]
        left_s, left_n = s.cumsum(1)[:, :-1], n.cumsum(1)[:, :-1]
        ok = (left_n > 0) & (left_n < all_n) & (np.arange(BINS - 1) < sizes[:, None])
        if not ok.any():
            continue
        right_s, right_n = all_s - left_s, all_n - left_n
        gain = np.full(ok.shape, -np.inf)
        gain[ok] = (left_s[ok] ** 2 / left_n[ok] + right_s[ok] ** 2 / right_n[ok] - all_s**2 / all_n) / all_n
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] > 0:
            tree.feature[node], tree.upto[node], any_split = f, b, True
            tree.mean[2 * node], tree.mean[2 * node + 1] = left_s[f, b] / left_n[f, b], right_s[f, b] / right_n[f, b]
    return any_split


class BoostedTrees(Transformer):
    """Adds ``probability``, a vector of both classes' probabilities."""

    def __init__(self, features: list[str], splits: list[np.ndarray], trees: list[Tree], rate: float):
        super().__init__()
        self.features, self.splits, self.trees, self.rate = features, splits, trees, rate

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, splits, trees, rate = self.features, self.splits, self.trees, self.rate

        @F.pandas_udf("double")
        def run(rows: pd.DataFrame) -> pd.Series:
            bins = _binned([rows[f].to_numpy() for f in features], splits)
            margin = sum((rate if i else 1.0) * t.mean[t.nodes(bins, DEPTH)] for i, t in enumerate(trees))
            return pd.Series(1 / (1 + np.exp(-2 * margin)), index=rows.index)

        p = run(F.struct(*features))
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def boost(rows: DataFrame, features: list[str], label: str, held: str, key: str, rounds: int, rate: float, seed: int) -> BoostedTrees:
    """Trees of depth 5 fitted to the residuals of the logistic loss, until the rows marked ``held`` gain no more by another one.

    Of the blocks' states the newest is cached; every tenth goes to the checkpoint folder, if there is one, so that lineage stays short.
    """
    spark, width, own = rows.sparkSession, len(features), rows.where(~F.col(held))
    n, draw = own.count(), F.pmod(F.xxhash64(F.lit(seed + 1), key, *features), F.lit(1 << 30))
    if not n:
        raise ValueError("no rows to train on")
    chosen = own if n <= CANDIDATE_ROWS else own.where(draw < int(CANDIDATE_ROWS / n * (1 << 30))).limit(4 * CANDIDATE_ROWS)
    some = chosen.select(*features).toPandas()
    splits = [candidate_splits(some[f].to_numpy()) for f in features]
    sizes = np.array([len(s) for s in splits])

    disk = StorageLevel.MEMORY_AND_DISK
    state, before = _blocks(rows, features, label, held, splits).persist(disk), []
    trees, best = [], np.inf
    try:
        while True:
            hist, error = _level(state, Tree.empty(), 0, not trees, width)  # fills the cache
            _dropped(spark, before)
            if len(trees) > 1 and not best - error >= TOLERANCE * max(error, 0.01):
                return BoostedTrees(features, splits, trees[:-1], rate)
            if len(trees) == rounds:
                return BoostedTrees(features, splits, trees, rate)
            best, tree = error, Tree.empty()
            going = _split(tree, 0, hist, sizes)
            for level in range(1, DEPTH):
                hist = _level(state, tree, level, not trees, width)[0] if going else np.zeros((2, width, 1 << level, BINS))
                going = _split(tree, level, hist, sizes)
            trees.append(tree)
            before, state = [state], _advanced(state, tree, rate if len(trees) > 1 else 1.0, width).persist(disk)
            if len(trees) % 10 == 0 and spark.sparkContext.getCheckpointDir():
                state.checkpoint()
    finally:
        _dropped(spark, [*before, state])


def _dropped(spark: SparkSession, states: list[RDD[Block]]) -> None:
    for old in states:
        old.unpersist()
        if path := old.getCheckpointFile():
            files.delete(spark, path)
