"""Quality classifier: ordinal regression with a cumulative logit link on graded ratings.

All grades share one vector of hashed-text weights; ordered thresholds cut the score: P(grade <= k) is
logistic(threshold k - score). The grades of the labels are 0 for toxic texts, 1 for others of low quality and
2 for good ones. Scores give the expected grade and the tail probability of the highest grade.

Features are hashed strings: the distinct lower-cased words, their first four letters, and binned
measures of the text (share of capitals, symbols and digits, distinct words, repeated lines, length).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(65, 91)]] = 3


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def _measures(text: str, words: list[str], distinct: int) -> list[str]:
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=4)
    n, lines = max(1, len(text)), text.split("\n")
    shares = {
        "symbols": kinds[1] / n,
        "digits": kinds[2] / n,
        "capitals": kinds[3] / n,
        "distinct": distinct / max(1, len(words)),
        "lines": 1 - len(set(lines)) / len(lines),
    }
    return [f"\n{k} {int(12 * np.sqrt(v))}" for k, v in shares.items()] + [f"\nlength {len(words).bit_length()}"]


def tokens(text: str | None) -> tuple[set[str], list[str]]:
    """The distinct words and the measures of a text; both are empty for a text without words."""
    words = _WORDS((text or ""))
    if not words:
        return set(), []
    own = set(_WORDS(text.lower()))
    return own, _measures(text, words, len(own))


def features(text: str | None) -> np.ndarray:
    words, rest = tokens(text)
    return np.unique(np.array([_bucket(t) for t in [*words, *{"\npre " + w[:4] for w in words}, *rest]], np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int = 3, rounds: int = 120, rate: float = 0.05, penalty: float = 1e-4) -> OrdinalModel:
    """Maximum penalised likelihood by Adam over the whole sample; thresholds stay in order.

    Grades of which the sample has none keep a threshold beside their neighbour's; an empty sample gives the
    model without weights.
    """
    whole = np.zeros(1 << BITS)
    shares = np.array([np.sum(grades <= k) + 1.0 for k in range(levels - 1)]) / (len(grades) + levels)
    cuts = np.log(shares / (1 - shares))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    if not len(rows):
        return OrdinalModel(whole, cuts)
    # Only buckets that the sample has move; the others stay 0.
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    weights = np.zeros(len(used))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, first = len(rows), cuts[:1].copy()
    state = [weights, first, gaps]
    mean, square = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, rounds + 1):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights[flat], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigma(edges[grades + 1] - score), sigma(edges[grades] - score)
        share = np.maximum(high - low, 1e-12)
        by_score = -(-high * (1 - high) + low * (1 - low)) / share / n
        by_cut = np.zeros(levels - 1)
        for k in range(levels - 1):
            by_cut[k] = -(np.sum((high * (1 - high) / share)[grades == k]) - np.sum((low * (1 - low) / share)[grades == k + 1])) / n
        slopes = [
            np.bincount(flat, by_score[row], minlength=len(weights)) + penalty * weights,
            np.array([by_cut.sum()]),
            np.array([by_cut[k + 1 :].sum() for k in range(levels - 2)]) * np.exp(gaps),
        ]
        for x, m, s, g in zip(state, mean, square, slopes, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    whole[used] = weights
    return OrdinalModel(whole, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, **options) -> OrdinalModel:
    """Fit on at most ``most_rows`` labelled texts, those with the smallest hashes of their doc_id.

    Labels without a quality or a toxic value count as not low, not toxic in that respect; those with
    neither, or without doc_id, are not used. Only hashed features of the sample come to the driver.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and (toxic is not null or quality is not null)").select(F.col("doc_id").alias("rated_id"), grade.alias("grade"))
    rated = rated.groupBy("rated_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("rated_id"), "rated_id").limit(most_rows)
    # The broadcast is bounded by most_rows.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("rated_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["grade", "features"])

    got = sample.select("grade", "text").mapInArrow(run, "grade int, features binary").collect()
    got = sorted(((bytes(r["features"]), r["grade"]) for r in got))  # the fit doesn't depend on partitions
    return fit_ordinal([np.frombuffer(x, np.int32) for x, _ in got], np.array([g for _, g in got], np.int64), **options)


def grade_documents(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5, keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, expected_grade, p_good, kept; with ``keep`` the rows of ``docs`` that pass.

    A null or empty text has no features, and so the score 0. Rows are independent: repeated rows are graded
    alike, an empty table gives an empty result, further columns are ignored (or, with ``keep``, passed on).
    """
    weights, cuts = model.weights.astype(np.float32), model.thresholds
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB at any size
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = sent.value
        graded, cache = OrdinalModel(shared, cuts), {}
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(text_at if keep else 1)):
                words, rest = tokens(t.as_py())
                try:
                    own = sum(map(cache.__getitem__, words))
                except KeyError:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache.update((w, float(shared[_bucket(w)])) for w in words if w not in cache)
                    own = sum(map(cache.__getitem__, words))
                starts = {"\npre " + w[:4] for w in words}
                new = [s for s in starts if s not in cache]
                cache.update((s, float(shared[_bucket(s)])) for s in new)
                score[i] = own + sum(map(cache.__getitem__, starts)) + sum(float(shared[_bucket(r)]) for r in rest)
            tails = graded.tails(score)
            good = tails[:, -1]
            if keep:
                yield batch.filter(pa.array(good >= least_tail))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(good), pa.array(good >= least_tail)], names=["doc_id", "expected_grade", "p_good", "kept"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, p_good double, kept boolean")
