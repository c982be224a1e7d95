"""Token ids in shard files that are wavelet matrices.

A shard holds the ids of consecutive documents as one bit-plane a bit, most significant first; each plane is
sorted stably by the bit before the next is taken. With ranks at every 512th bit a file answers access,
count and occurrence lookup without being unpacked, and gives all ids back in order. Files are Parquet rows
(shard key, payload), so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, byte_letters, read_vocabulary

_MAGIC = b"TWWM"
_BLOCK = 512  # bits between stored ranks
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of unsigned ids below 2**bits."""

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.zeros, self.planes, self.ranks = size, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << bits:
            raise ValueError(f"ids from {ids.min()} to {ids.max()} don't fit in {bits} bits")
        kind = np.uint16 if bits <= 16 else np.uint32
        level, zeros, planes, ranks = ids.astype(kind), [], [], []
        for k in range(bits - 1, -1, -1):
            ones = (level & kind(1 << k)).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            low = level.compress(~ones)
            zeros.append(len(low))
            planes.append(plane)
            ranks.append(cls._ranks(plane))
            level = np.concatenate([low, level.compress(ones)])
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _ranks(plane: np.ndarray) -> np.ndarray:
        """Ones before every 512th bit."""
        step = _BLOCK // 8
        if not len(plane):
            return np.zeros(1, np.uint32)
        blocks = np.add.reduceat(_POPCOUNT[plane], np.arange(0, len(plane), step), dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = _MAGIC + struct.pack("<QB", self.size, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return b"".join([head, *(x.tobytes() for x in self.planes), *(x.astype("<u4").tobytes() for x in self.ranks)])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, int]:
        """The matrix and the number of bytes it took."""
        if data[:4] != _MAGIC:
            raise ValueError("this is no wavelet matrix")
        size, bits = struct.unpack_from("<QB", data, 4)
        zeros, at = list(struct.unpack_from(f"<{bits}Q", data, 13)), 13 + 8 * bits
        width, marks = -(-size // 8), max(1, -(-size // _BLOCK))
        planes = [np.frombuffer(data, np.uint8, width, at + i * width) for i in range(bits)]
        at += bits * width
        ranks = [np.frombuffer(data, "<u4", marks, at + 4 * i * marks) for i in range(bits)]
        return cls(size, zeros, planes, ranks), at + 4 * bits * marks

    def _rank1(self, k: int, at: int) -> int:
        """Ones of plane k before position ``at``."""
        mark = min(at // _BLOCK, len(self.ranks[k]) - 1)
        byte = at // 8
        ones = int(self.ranks[k][mark]) + int(_POPCOUNT[self.planes[k][mark * _BLOCK // 8 : byte]].sum())
        rest = at % 8
        return ones + (bin(int(self.planes[k][byte]) & ((1 << rest) - 1)).count("1") if rest else 0)

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for k, plane in enumerate(self.planes):
            bit = int(plane[at // 8]) >> (at % 8) & 1
            ones = self._rank1(k, at)
            at = self.zeros[k] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        for k in range(bits):
            a, b = self._rank1(k, start), self._rank1(k, stop)
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if token >> (bits - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of the token in [start, stop)."""
        a, b = self._range(token, start, self.size if stop is None else stop)
        return b - a

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) such bit of plane k, by bisection over ranks."""
        low, high = 0, self.size
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) <= nth:
                low = mid + 1
            else:
                high = mid
        return low

    def find(self, token: int, nth: int = 0) -> int:
        """Position of the nth (from 0) occurrence, or -1."""
        start, stop = self._range(token, 0, self.size)
        if not 0 <= nth < stop - start:
            return -1
        at, bits = start + nth, len(self.planes)
        for k in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the sorts from the last plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        level = np.zeros(self.size, kind)
        for k in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
            above = np.empty(self.size, kind)
            above[np.flatnonzero(~ones)] = level[: self.zeros[k]]
            above[np.flatnonzero(ones)] = level[self.zeros[k] :] | kind(1 << (bits - 1 - k))
            level = above
        return level


@lru_cache(maxsize=4)
def library_encoder(path: str) -> TextEncoder:
    """Ids by the ``tokenizers`` library's model, word by word behind the cache."""
    from tokenizers import Tokenizer

    read_vocabulary(path)  # refuses what the pre-split does not follow
    tokenizer = Tokenizer.from_file(path)
    tokenize, letter = tokenizer.model.tokenize, [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return TextEncoder(lambda word: [t.id for t in tokenize("".join([letter[b] for b in word.encode()]))], special)


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 20, bits: int | None = None) -> None:
    """Encode every text, append the end id and write shard files in ascending doc_id order.

    Documents are range-partitioned by doc_id; each task writes shards of about ``shard_tokens`` ids. A null
    text counts as empty and gives the end id alone; a null doc_id comes first; rows with one doc_id are
    ordered by their text. An empty table writes no shard. Memory holds one shard and one Arrow batch. Planes are
    as many as the vocabulary's largest id needs, or ``bits``; ids that don't fit are an error.
    """
    spec = read_vocabulary(vocabulary)
    largest = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    bits = bits or largest.bit_length()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        docs, ends, ids, size = [], [], [], 0
        end = np.array([end_id], "<u4")

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids), bits).to_bytes()
            known = np.array([d is not None for d in docs], np.uint8)
            index = struct.pack("<Q", len(docs)) + known.tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(ends, "<u8").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([index + matrix], pa.binary())],
                names=["part", "seq", "n_tokens", "payload"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(encode(text.as_py()), "<u4")
                ids += [got, end]
                size += len(got) + 1
                docs.append(doc)
                ends.append(size)
                if size >= shard_tokens:
                    yield shard()
                    docs, ends, ids, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    ordered.mapInArrow(run, "part int, seq int, n_tokens long, payload binary").write.parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema("part int, seq int, n_tokens long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                data = payload.as_buffer()
                (n,) = struct.unpack_from("<Q", data, 0)
                known = np.frombuffer(data, np.uint8, n, 8).astype(bool)
                docs = np.frombuffer(data, "<i8", n, 8 + n)
                ends = np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64)
                matrix, _ = WaveletMatrix.from_bytes(data[8 + 17 * n :].to_pybytes())
                ids = matrix.ids().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(docs, mask=~known), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Ids before a shard: those of earlier parts (one row a part), and of earlier shards of its part.
    sizes = files.select("part", "seq", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", earlier(Window.orderBy("part")).alias("before_part"))
    shards = sizes.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("before_shard")).join(parts, "part")
    return docs.join(shards, ["part", "seq"]).select("doc_id", (F.col("before_part") + F.col("before_shard") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _opened(payload: pa.Buffer) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents of a shard, where each of them ends, and the matrix, whose planes stay packed."""
    (n,) = struct.unpack_from("<Q", payload, 0)
    known, docs = np.frombuffer(payload, np.uint8, n, 8), np.frombuffer(payload, "<i8", n, 8 + n)
    ends = np.frombuffer(payload, "<u8", n, 8 + 9 * n).astype(np.int64)
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], ends, WaveletMatrix.from_bytes(payload[8 + 17 * n :].to_pybytes())[0]


def _asked(spark: SparkSession, path: str, answer: Callable[[list[int | None], np.ndarray, WaveletMatrix], list[tuple]], schema: str) -> DataFrame:
    """The answers of all shard files, each file's by itself."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                rows = answer(*_opened(payload.as_buffer()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return spark.read.schema("payload binary").parquet(path).mapInArrow(run, schema)


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at: every occurrence of a token in the shard files, by select; its place in its document."""

    def answer(docs: list[int | None], ends: np.ndarray, matrix: WaveletMatrix) -> list[tuple]:
        places = np.array([matrix.find(token, i) for i in range(matrix.count(token))], np.int64)
        of = np.searchsorted(ends, places, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        return [(docs[d], p - int(starts[d])) for d, p in zip(of.tolist(), places.tolist(), strict=True)]

    return _asked(spark, path, answer, "doc_id long, at long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, n: how often each document that has a token has it, by ranks at the document's ends. Shards without it cost one rank."""

    def answer(docs: list[int | None], ends: np.ndarray, matrix: WaveletMatrix) -> list[tuple]:
        if not matrix.count(token):
            return []
        bounds = [0, *ends.tolist()]
        counts = [matrix.count(token, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [(d, n) for d, n in zip(docs, counts, strict=True) if n]

    return _asked(spark, path, answer, "doc_id long, n long")


def token_at(spark: SparkSession, path: str, at: int) -> DataFrame:
    """doc_id, token: the token at a place (from 0) of every document that reaches it, by access."""

    def answer(docs: list[int | None], ends: np.ndarray, matrix: WaveletMatrix) -> list[tuple]:
        bounds = [0, *ends.tolist()]
        return [(d, matrix.access(a + at)) for d, a, b in zip(docs, bounds[:-1], bounds[1:], strict=True) if a + at < b]

    return _asked(spark, path, answer, "doc_id long, token int")
