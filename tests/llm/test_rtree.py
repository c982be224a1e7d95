"""Hard negatives against all pairs, with ties, nulls, repeated rows, other lengths and tiny trees."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int, row long, `group` long, anchor long, vec string, tile int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    held = []
    for at, (i, vec, label, *_) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held.append((at, i, label, [math.floor(256 * x) for x in vec]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for at, i, label, q in held:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), j, k == label) for other, j, k, v in held if other != at]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            hits = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p), key=order)[:negatives]
            out += [(i, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(hits)]
    return out


def _rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(700):
        c = centres[i % 4]
        rows.append((i, [round(x + rng.gauss(0, 0.4), 1) for x in c], 1 if rng.random() < 0.4 else i % 4))
    rows += [(1000 + i, [0.5] * 6, 2) for i in range(150)]  # ties
    rows += [(2000, None, 1), (2010, [1.0, None, 2.0], 1), (2020, [math.nan] * 6, 1), (2030, [math.inf, 1.0], 1), (2040, [1.0] * 6, None), (2050, [], 1), (2060, [1.0, 2.0], 3), (2070, [1.0] * 9, 0), (None, [0.6] * 6, 2)]
    rows += [rows[20], rows[20], rows[700]]
    return [(*r, 1, 2, 3, "v", 4) for r in rows]


@pytest.mark.parametrize(("tile", "leaf", "groups"), [(40, 5, 7), (2048, 64, None), (300, 16, 1)])
def test_hard_negatives(spark, tile, leaf, groups):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rtree.mine_hard_negatives(table, F.col("vec_id") % 10 == 0, tile_rows=tile, leaf_rows=leaf, groups=groups)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute(rows, lambda i: i % 10 == 0))


def test_no_rows_and_large_components(spark):
    assert rtree.mine_hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).isEmpty()
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**17 for _ in range(3)], i % 2, 1, 2, 3, "v", 4) for i in range(60)]
    got = rtree.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, tile_rows=8, leaf_rows=2)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute(rows, lambda i: i % 10 == 0))


def test_boxes_are_pruned():
    """On rows in clusters the queue leaves out most of the tree, and what it visits holds the answer."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 8)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(64, 8)) for c in centres]))
    tree = rtree.Tree(rtree.packed_tree(list(range(len(x))), np.arange(len(x)), x, "a"))
    assert all((tree.low[-1] <= x.min(axis=0)) & (tree.high[-1] >= x.max(axis=0))) and tree.last[tree.leaves - 1] == len(x)
    least, most = tree.intervals(x[:64])
    for i in range(64):
        ask = rtree.Ask(-(1 << 62), 1 << 62, -(1 << 62), 5)
        seen = rtree.search([tree], [least[i : i + 1][0]], [most[i]], x[i], i, [ask])
        want = sorted((-(x @ x[i])[j], j) for j in range(len(x)) if j != i)[:5]
        assert [(s, n) for s, _, n, _ in ask.best] == want and seen < 30 < tree.leaves
