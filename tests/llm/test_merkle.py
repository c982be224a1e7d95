"""The Merkle manifest against a tree built in plain Python, with awkward rows and small steps."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import merkle
from tidewell.llm.store import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, node string, height int, claim string, proof string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row[:5]
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(said, (doc_id, source, lang, n if n is None else n + more, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 2 * 2
        out.append([(level[run:at], level[at + 1 : run + 2])])
        at //= 2
    return [x for part in out for x in part]


def brute(rows, odd):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        own[n] = levels_of([leaf_of(r) for r in trees[n]])
    top = levels_of([own[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(trees[n]):
            path, x = way(own[n], i) + way(top, k), leaf_of(r, 1 if odd(r) else 0)
            for left, right in path:
                x = H(*left, x, *right)
            out.append((r[0], leaf_of(r), own[n][-1][0], top[-1][0], H(*(s for left, right in path for s in left + right)), x, x == top[-1][0]))
    return out


@pytest.fixture(scope="module")
def rows():
    langs = ["en"] * 23 + ["fr"] * 8 + ["de"] * 5 + ["es", "", None, None, "é", "z"]
    out = [(i * 7 % 101, None if i % 9 == 0 else "" if i % 9 == 1 else f"text {i} é\n" * (i % 4), lang, None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i, lang in enumerate(langs)]
    out += [out[3], out[3], (None, "no id", "en", "s", 4), (None, None, None, None, None), (5, "long " * 60_000, "fr", "s", 1)]
    return [(*r, *("x", 1, "x", 1, "x", "x")) for r in out]


@pytest.mark.parametrize("step", [2, 3, 8])
def test_manifest(spark, rows, step):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    claim = merkle.tampered_digest({"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    path = new_path(spark, "manifest")
    manifest = merkle.write_manifest(docs, path, claim=claim, step=step)
    want = brute(rows, lambda r: r[0] is not None and r[0] % 3 == 0)
    got = [tuple(r) for r in merkle.check_proofs(manifest).collect()]
    assert Counter(got) == Counter(want) and {r[6] for r in got} == {True, False}
    assert manifest.root == want[0][3] == merkle.read_manifest(spark, path, step).root
    some = [tuple(r) for r in merkle.check_proofs(merkle.read_manifest(spark, path, step), F.col("doc_id") < 20).collect()]
    assert Counter(some) == Counter(w for w in want if w[0] is not None and w[0] < 20)
    levels = {r.height for r in manifest.leaves.select("height").distinct().collect()}
    assert len(manifest.rounds) == -(-max(levels) // step)


def test_no_rows_and_one_row(spark, rows):
    none = merkle.write_manifest(spark.createDataFrame([], SCHEMA), new_path(spark, "manifest"))
    assert none.root is None and merkle.check_proofs(none).isEmpty()
    one = merkle.write_manifest(spark.createDataFrame(rows[:1], SCHEMA), new_path(spark, "manifest"))
    (r,) = merkle.check_proofs(one).collect()
    assert r.verified and r.leaf == r.subroot == r.root == leaf_of(rows[0]) and r.proof_sha256 == H()
