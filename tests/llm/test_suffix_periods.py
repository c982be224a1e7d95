"""Removal of repeats in texts that repeat themselves at short distances, against every window."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import suffix


def _texts():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    units = ["x", "ab", "ab\n", "aaaaaaaaaaaaaaab", "=-=-=+", word(17), word(40), word(63), word(64), word(65), word(100)]
    out = []
    for unit in units:
        for n in (399, 400, 401, 400 + len(unit), 400 + len(unit) * 3 // 2, 437, 520, 900, 2600):
            run = (unit * (n // len(unit) + 2))[rng.randrange(len(unit)) :][:n]
            out += [run] if n in (400, 401, 2600) else []
            out.append(word(rng.randrange(300)) + run + word(rng.randrange(500)))
    out += [("x" * 300 + "y") * 9, ("x" * 340 + rng.choice("yz")) * 5 + word(50), "x" * 1500 + "y" + "x" * 700, "x" * 450 + "z" + "x" * 330 + "y", word(400) + "ab" * 600 + "c" + "ab" * 250, word(1200), "é" * 700, "日本" * 300]
    out += [out[5], word(20) + out[30], "", None]
    return out


def _brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + 400] for t in data for s in range(len(t) - 399))
    want = []
    for i, t in enumerate(data):
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        want.append((i, len(t), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("most_contexts, a_bucket", [(50_000, 20_000), (1, 5000)])
def test_periods(spark, most_contexts, a_bucket):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(docs, most_contexts=most_contexts, a_bucket=a_bucket).collect()
    assert sorted(tuple(r)[:5] for r in got) == _brute(texts)


@pytest.mark.parametrize("chunk", [700, 1 << 20])
def test_anchors_name_every_window_once(monkeypatch, chunk):
    """Each window has one anchor, equal windows have it at one distance, those without equal one that has."""
    monkeypatch.setattr(suffix, "_CHUNK", chunk)
    offsets = {}
    for t in _texts():
        data = (t or "").encode()
        named, settled = Counter(), []
        for p, a, b in suffix.anchors(data):
            if p < 0:
                settled.append((a, b))
                continue
            for s in range(a, b + 1):
                named[s] += 1
                assert 0 <= p - s < suffix.SPAN and offsets.setdefault(data[s : s + 400], p - s) == p - s
        inside = [s for a, b in settled for s in range(a, b + 1)]
        assert named.keys() | set(inside) == set(range(max(0, len(data) - 399))) and max(named.values(), default=1) == 1
        windows = Counter(data[s : s + 400] for s in range(max(0, len(data) - 399)))
        have = {data[s : s + 400] for s in named}
        assert all(windows[data[s : s + 400]] > 1 and data[s : s + 400] in have for s in inside)
        assert all(data[s : s + 400] in have for s in range(max(0, len(data) - 399)))


def test_long_periodic_texts(spark):
    texts = ["x" * 5_000_000, "ab\n" * 500_000, "aaaaaaaaaaaaaaab" * 60_000, "unlike\n" + "0123456789" * 41 + "0"]
    assert all(sum(1 for _ in suffix.anchors(t.encode())) < 500 for t in texts)
    began = time.time()
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(4)] == [5_000_000, 1_500_000, 960_000, 411] and time.time() - began < 120
