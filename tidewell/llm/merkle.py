"""Merkle manifest of a dataset: one tree of row digests a partition value, one over the trees' roots.

Only every ``step``-th level is persisted (and each root). A proof names the siblings on the way from a row to the
root; the levels between two persisted ones are grown again from the ``2**step`` stored nodes of each aligned subtree,
give their siblings, and are dropped. No task holds more than such a subtree, whatever the size of a tree.

A node is the SHA-256 of its children's digests as lowercase hex, one after the other; the last node of a level may have
one child only. A proof is a byte string from the bottom up: for every level 0 (no sibling), or 1 (the sibling is on
the left) or 2 (on the right) and the sibling's 32 bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import positions
from .store import materialize, scratch

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 8


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 (binary) of a row: of each value its UTF-8 length, a colon and itself, or a dash for null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(said, columns)).cast("binary"), 256))


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def grown(nodes: list[bytes], up: int) -> list[list[bytes]]:
    """The levels of a subtree from ``nodes`` to ``up`` levels above them."""
    levels = [list(nodes)]
    for _ in range(up):
        below = levels[-1]
        levels.append([parent(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path_piece(levels: list[list[bytes]], at: int) -> bytes:
    """The part of a proof inside a subtree, for its node ``at``."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(bytes([1 if other < at else 2]) + level[other] if other < len(level) else b"\0")
        at >>= 1
    return b"".join(out)


def proof_steps(proof: bytes) -> list[tuple[int, bytes]]:
    """(side, sibling) by level; the sibling is empty where there is none."""
    out, at = [], 0
    while at < len(proof):
        size = 33 if proof[at] else 1
        out.append((proof[at], proof[at + 1 : at + size]))
        at += size
    return out


def fold_proof(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for side, other in proof_steps(proof):
        leaf = parent(*((other, leaf) if side == 1 else (leaf, other) if side else (leaf,)))
    return leaf


@F.pandas_udf(T.BinaryType())
def _top_of(nodes: pd.Series, up: pd.Series) -> pd.Series:
    return pd.Series([grown(n, u)[-1][0] for n, u in zip(nodes, up, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _pieces_of(nodes: pd.Series, up: pd.Series) -> pd.Series:
    out = []
    for n, u in zip(nodes, up, strict=True):
        levels = grown(n, u)
        out.append([path_piece(levels, i) for i in range(len(n))])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StructType().add("folded", T.BinaryType()).add("siblings", T.BinaryType()))
def _folded(leaf: pd.Series, proof: pd.Series) -> pd.DataFrame:
    siblings = [parent(*(s for _, s in proof_steps(p))) for p in proof]
    return pd.DataFrame({"folded": [fold_proof(x, p) for x, p in zip(leaf, proof, strict=True)], "siblings": siblings})


@dataclass
class Manifest:
    """The written tables. ``leaves``: tree, pos, node, height, doc_id, claim; ``rounds``: the persisted levels above them."""

    leaves: DataFrame
    rounds: list[DataFrame]
    trees: DataFrame  # tree, pos (the rank of its root), node (its root), height (of the top tree), own_height
    top_rounds: list[DataFrame]
    root: str | None
    step: int


def _height(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _grow_rounds(rows: DataFrame, path: str, step: int) -> list[DataFrame]:
    """Persist the levels step, 2 * step, ... and the roots of the trees over ``rows`` (tree, pos, node, height)."""
    top = rows.agg(F.max("height")).first()[0] or 0
    rounds = []
    for base in range(0, top, step):
        live = rows.where(F.col("height") > base)
        blocks = live.groupBy("tree", "height", F.shiftright("pos", step).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("rows"))
        node = _top_of(F.col("rows.node"), F.least(F.lit(step), F.col("height") - base))
        rows = _written(blocks.select("tree", F.col("block").alias("pos"), node.alias("node"), "height"), f"{path}/{base + step}")
        rounds.append(rows)
    return rounds


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _roots(leaves: DataFrame, rounds: list[DataFrame], step: int) -> DataFrame:
    """tree, node, height: the highest persisted node of each tree."""
    out = leaves.where("height = 0").select("tree", "node", "height")
    for i, r in enumerate(rounds):
        out = out.unionByName(r.where((F.col("height") > i * step) & (F.col("height") <= (i + 1) * step)).select("tree", "node", "height"))
    return out


def write_manifest(docs: DataFrame, path: str, tree: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, claim: Column | None = None, step: int = STEP) -> Manifest:
    """Digest every row of ``docs`` and persist the manifest's tables under ``path``.

    Rows with the same ``tree`` value form a tree, null values one of their own, the first; in it they lie by ``order``, nulls
    first, and by digest where that is equal, so repeated rows are leaves of their own. A row's digest covers the named
    columns, others are ignored; null and empty text differ. ``claim`` is a digest to hold against the row's leaf later
    (its own by default). No rows give no leaves and a root of None.
    """
    spark, leaf = docs.sparkSession, row_digest([F.col(c) for c in columns])
    with scratch(spark):
        named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # "-" comes before all others
        digests = docs.select(named.alias("tree"), F.col(order).alias("doc_id"), leaf.alias("node"), (leaf if claim is None else claim).alias("claim"))
        placed = positions(materialize(digests, "digests"), "tree", ["doc_id", "node"])
        sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).select("tree", _height(F.col("n")).alias("height"))
        leaves = _written(placed.join(sizes, "tree"), f"{path}/leaves")
        rounds = _grow_rounds(leaves, f"{path}/levels", step)
        roots = materialize(_roots(leaves, rounds, step).select(F.lit("").alias("all"), "tree", "node", F.col("height").alias("own_height")), "roots")
        height = _height(F.lit(roots.count()))
        trees = positions(roots, "all", ["tree"]).select("all", "tree", "pos", "node", height.alias("height"), "own_height")
        trees = _written(trees, f"{path}/trees")
    tops = trees.select(F.col("all").alias("tree"), "pos", "node", "height")
    top_rounds = _grow_rounds(tops, f"{path}/top", step)
    last = _roots(tops, top_rounds, step).first()
    return Manifest(leaves, rounds, trees, top_rounds, last["node"].hex() if last else None, step)


def _proofs(rows: DataFrame, rounds: list[DataFrame], above: DataFrame, step: int, chosen: Column | None = None) -> DataFrame:
    """``rows`` with further columns of ``above`` and ``proof``: the siblings up to each tree's root, then above's proof.

    ``above``: tree, height, proof and what else each tree's rows are to get, one row a tree.
    """
    more = [c for c in above.columns if c not in ("tree", "height", "proof")]
    levels, upper = [rows, *rounds[:-1]] if rounds else [rows], None
    for i in reversed(range(len(levels))):
        base, level = i * step, levels[i]
        ends = above.where((F.col("height") > base) & (F.col("height") <= base + step)).select("tree", F.lit(0).cast("long").alias("block"), "proof", *more)
        upper = ends if upper is None else ends.unionByName(upper.select("tree", F.col("pos").alias("block"), "proof", *more))
        of_row = [c for c in level.columns if c not in ("tree", "height", "pos", "node")]
        blocks = level.where(F.col("height") > base).groupBy("tree", "height", F.shiftright("pos", step).alias("block"))
        wanted = [F.bool_or(chosen).alias("wanted")] if chosen is not None and i == 0 else []
        blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("pos", "node", *of_row))).alias("rows"), *wanted)
        blocks = blocks.where("wanted").drop("wanted") if wanted else blocks
        pieces = blocks.withColumn("pieces", _pieces_of(F.col("rows.node"), F.least(F.lit(step), F.col("height") - base)))
        each = pieces.join(upper, ["tree", "block"]).select("tree", "height", "proof", *more, F.explode(F.arrays_zip("rows", "pieces")).alias("x"))
        upper = each.select("tree", "x.rows.pos", "x.rows.node", "height", *(f"x.rows.{c}" for c in of_row), *more, F.concat("x.pieces", "proof").alias("proof"))
    alone = rows.where("height = 0").join(above.drop("height"), "tree").select(*upper.columns)
    out = upper.unionByName(alone)
    return out if chosen is None else out.where(chosen)


def extract_proofs(manifest: Manifest, chosen: Column | None = None) -> DataFrame:
    """tree, pos, node, height, doc_id, claim, subroot, proof of every leaf, or of the ``chosen`` (a condition on the leaves' columns).

    Of the lowest levels only the subtrees that hold a chosen row are grown again.
    """
    trees = manifest.trees.select(F.col("all").alias("tree"), "pos", "node", "height", F.col("tree").alias("name"), "own_height")
    none = trees.select("tree", "height", F.lit(b"").alias("proof")).distinct()
    above = _proofs(trees, manifest.top_rounds, none, manifest.step)
    above = above.select(F.col("name").alias("tree"), F.col("own_height").alias("height"), F.col("node").alias("subroot"), "proof")
    return _proofs(manifest.leaves, manifest.rounds, above, manifest.step, chosen)


def check_proofs(manifest: Manifest, chosen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings, for every row.

    The claim of a row is folded with its siblings; it is verified if that leads to the root. ``proof_sha256`` is the
    digest of the siblings' digests as text.
    """
    hex_of = lambda c: F.lower(F.hex(c))
    rows = extract_proofs(manifest, chosen).withColumn("said", _folded("claim", "proof"))
    return rows.select(
        "doc_id",
        hex_of("node").alias("leaf"),
        hex_of("subroot").alias("subroot"),
        F.lit(manifest.root).alias("root"),
        hex_of("said.siblings").alias("proof_sha256"),
        hex_of("said.folded").alias("folded_root"),
        (hex_of("said.folded") == F.lit(manifest.root)).alias("verified"),
    )


def tampered_digest(altered: dict[str, Column], columns: tuple[str, ...] = COLUMNS) -> Column:
    """The digest of a row some of whose columns are replaced."""
    return row_digest([altered.get(c, F.col(c)) for c in columns])


def read_manifest(spark: SparkSession, path: str, step: int = STEP) -> Manifest:
    """A manifest that was written under ``path`` with the same ``step``."""
    leaves, trees = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/trees")
    tops = trees.select(F.col("all").alias("tree"), "pos", "node", "height")
    levels = lambda rows, name: [spark.read.parquet(f"{path}/{name}/{b + step}") for b in range(0, rows.agg(F.max("height")).first()[0] or 0, step)]
    top_rounds = levels(tops, "top")
    last = _roots(tops, top_rounds, step).first()
    return Manifest(leaves, levels(leaves, "levels"), trees, top_rounds, last["node"].hex() if last else None, step)
