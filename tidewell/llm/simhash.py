"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is looked up by its two 32-bit segments: of two fingerprints at 3 or fewer differing
bits, one segment differs in at most one. The table holds every distinct fingerprint under its segments'
values; queries enumerate the Hamming ball of radius 1 around theirs, fetch the matches and verify the whole
distance. A differing bit flips a segment's parity, so only even segments need to enumerate and only odd
values are asked for. Matches of one table entry are resolved where the entry's block of fingerprints
lies: a query gives one link to each component of the block that it touches, never all pairs. An entry with
more than ``block`` fingerprints is cut into blocks, each of which meets all the entry's queries.

Near duplicates by similarity (``similar_groups``) are as far as 10 of 64 bits apart, beyond two such balls. They take
the same lookup over fingerprints of 1,024 bits: more and shorter segments, balls of radius 1 around each, the whole
distance of what meets; the shingles themselves follow as the exact check.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import decided, materialize, only, scratch, tagged

_WORD = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MOST_BITS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 (seed 42) of all word shingles; 0 without words."""
    words = _WORD((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in zip(start[:n].tolist(), stop[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None, shingle: int = 3) -> DataFrame:
    """doc_id, fp (a signed long) and the tag, if named; a null text counts as empty."""
    extra = [F.col(tag).alias("tag")] if tag else []
    source = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, " + "tag long, " * bool(tag) + "fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, schema)


def _differing(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(some ^ one)
    return bits if bits.ndim == 1 else bits.sum(1, dtype=np.int64)


def _grown(n: int, near_of: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``n`` rows the index of its component's first one; ``near_of`` gives the rows of some that link to one."""
    root, todo = np.arange(n), np.ones(n, bool)
    for first in range(n):
        if not todo[first]:
            continue
        todo[first], queue = False, [first]
        while queue:  # breadth first, one row of distances a fingerprint
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            near = near_of(queue.pop(), rest)
            todo[near], root[near] = False, first
            queue += near.tolist()
    return root


def _roots(own: np.ndarray, most_bits: int) -> np.ndarray:
    """For each fingerprint of a block the index of its component's first one."""
    return _grown(len(own), lambda at, rest: rest[_differing(own[rest], own[at]) <= most_bits])


def _resolve(own: np.ndarray, asked: np.ndarray, most_bits: int) -> list[np.ndarray]:
    """Links (2, n) of a block: its members to their component's root, and each query to every root touched."""
    root = _roots(own, most_bits)
    links = [np.stack([own, own[root]])]
    for at in range(0, len(asked), step := max(1, (1 << 22) // len(own))):
        part = asked[at : at + step]
        q, m = np.nonzero(np.bitwise_count(part[:, None] ^ own[None, :]) <= most_bits)
        q, r = np.unique(np.stack([q, root[m]]), axis=1) if len(q) else (q, m)
        links.append(np.stack([part[q], own[r]]))
    return links


def near_links(marks: DataFrame, most_bits: int = MOST_BITS, block: int = 4096) -> DataFrame:
    """Links a, b between the distinct fingerprints ``fp``: they span every component, in linear number."""
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments with balls of radius 1 find 3 differing bits at most")
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    entry = lambda i: F.struct(F.lit(i).alias("seg"), half[i].alias("value"))
    table = marks.select("fp", F.explode(F.array(entry(0), entry(1))).alias("e")).select("fp", "e.seg", "e.value")
    # Entries of more than a block; there are at most 2 x fingerprints / block of them.
    large = materialize(table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "large")
    flips = F.array(*(F.lit(1 << i) for i in range(32)))
    ball = F.when(F.bit_count("value") % 2 == 0, F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).otherwise(F.array().cast("array<bigint>"))
    queries = table.select("fp", "seg", F.explode(ball).alias("value"), F.lit(True).alias("asks"))
    rows = table.select("fp", "seg", "value", F.lit(False).alias("asks")).unionByName(queries)
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(large, ["seg", "value"], "left")
        home = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        parts = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        rows = rows.withColumn("home", home).withColumn("part", F.explode(parts))
        rows = rows.withColumn("asks", F.col("asks") | (F.col("part") != F.col("home"))).drop("home", "blocks")
    rows = rows.repartition("seg", "value", "part").sortWithinPartitions("seg", "value", "part", "asks")
    rows = rows.select(((F.col("value") * 2 + F.col("seg"))).alias("key"), "part", "asks", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The block of the key at hand is kept; its queries pass by in pieces.
        last, own = None, np.zeros(0, np.uint64)
        carried = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)]
        for batch in batches:
            key, part, fp = (batch.column(i).to_numpy() for i in (0, 1, 3))
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            now = [np.concatenate(x) for x in zip(carried, [key, part.astype(np.int64), asks, fp.view(np.uint64)], strict=True)]
            key, part, asks, fp = now
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])) if len(key) else np.zeros(0, np.int64)
            # A block is resolved when it is whole: its members come before its queries.
            stop = int(edge[-1]) if len(edge) else 0
            if len(key) - stop > 4 * block and asks[stop:].any():
                stop = len(key)
            carried = [x[stop:] for x in now]
            found, last, own = _runs(key[:stop], part[:stop], asks[:stop], fp[:stop], last, own)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64))], names=["a", "b"])
        found, _, _ = _runs(*carried, last, own)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64))], names=["a", "b"])

    def _runs(key, part, asks, fp, last, own):
        links = [np.zeros((2, 0), np.uint64)]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            ends = np.concatenate([first[1:], [len(key)]])
            queries = np.concatenate([[0], np.cumsum(asks)])
            members = (ends - first) - (queries[ends] - queries[first])
            busy = (ends - first >= 2) & (members > 0)
            if len(own) and last == (key[0], part[0]) and members[0] == 0:
                links += _resolve(own, fp[: ends[0]], most_bits)[1:]
                busy[0] = False
            for a, m, b in zip(first[busy].tolist(), members[busy].tolist(), ends[busy].tolist(), strict=True):
                links += _resolve(fp[a : a + m], fp[a + m : b], most_bits)
            if last != (key[-1], part[-1]) or members[-1]:
                own = fp[first[-1] : first[-1] + members[-1]]
            last = (key[-1], part[-1])
        found = np.concatenate(links, axis=1)
        return found[:, found[0] != found[1]], last, own

    return rows.mapInArrow(run, "a long, b long")


def near_components(marks: DataFrame, most_bits: int = MOST_BITS, block: int = 4096) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a link."""
    return components(near_links(marks.select("fp").distinct(), most_bits, block)).withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, most_bits: int = MOST_BITS, block: int = 4096, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id (and the tag, if named).

    Rows with equal fingerprints are linked too, those without words by fingerprint zero. component_id is the
    smallest doc_id reachable over links, null only if no row of the component has one. A null text counts
    as empty; repeated rows share a component; an empty table gives an empty result; further columns are
    ignored.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, tag), "fingerprints")
    least = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialize(near_components(least, most_bits, block), "roots")
    placed = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    out = marks.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *([F.col("tag").alias(tag)] if tag else []))


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 x ``words`` majority bits over hashes, each spread over that many words by splitmix64."""
    ones = np.zeros(64 * words, np.int64)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] + steps[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _words(text: str | None) -> list[bytes]:
    return _WORD((text or "").encode().translate(_LOWER))


def _spans(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the distinct shingles; fewer words than ``width`` are one, no words none."""
    spans = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in spans), np.uint64, len(spans))


def similarity_mark(spans: np.ndarray) -> np.ndarray:
    """The fingerprint for similarities: 1,024 bits of the distinct shingles."""
    return _majority(spans, 16)


#: Texts whose shingles a task holds at once.
_AT_ONCE = 256


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(low, _AT_ONCE)


def similarity_marks(docs: DataFrame, id_col: str, text_col: str, tag: str, width: int) -> DataFrame:
    """doc_id, tag, mark (128 bytes), size (distinct shingles)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(tag).alias("tag"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            spans = [_spans(_words(t.as_py()), width) for t in batch.column(2)]
            marks = pa.array([similarity_mark(x).tobytes() for x in spans], pa.binary())
            columns = [batch.column(0), batch.column(1), marks, pa.array([len(x) for x in spans], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "mark", "size"])

    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, tag long, mark binary, size int")


def similarity_bits(similarity: float, sizes: np.ndarray, bits: int = 1024, errors: float = 6) -> np.ndarray:
    """Differing bits of sets of this Jaccard similarity: their mean, by the angle, and ``errors`` standard errors.

    Ties make sets of few shingles differ more often than the angle says, by less than half a bit in ``sizes``, the smaller set's.
    """
    share = np.minimum(np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.5 / np.maximum(sizes, 1), 0.5)
    return bits * share + errors * np.sqrt(bits * share * (1 - share))


def segments(similarity: float, rows: int, bits: int = 1024, missed: float = 1e-6) -> tuple[int, int]:
    """Width and number of the segments by which ``rows`` fingerprints are looked up.

    They are as wide as keeps the entries of a segment's table at some hundred rows, whatever the number of rows is, and so many
    that a pair of just the ``similarity`` meets in none with a probability of ``missed``: bits differ independently, and a
    segment is found if no bit differs, one does, or, every second time, two do (both texts then ask for one value).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for width in range(min(max(math.ceil(math.log2(max(rows, 1))) - 5, 8), 24), 0, -1):
        at = [math.comb(width, d) * share**d * (1 - share) ** (width - d) for d in range(min(width, 2) + 1)]
        found = sum(at[:2]) + sum(at[2:]) / 2
        tables = 1 if found >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-found)))
        if tables * width <= bits:
            return width, tables
    return 1, bits


def segment_values(marks: DataFrame, width: int, tables: int) -> DataFrame:
    """id, size, a, b (a further 128 bits of the fingerprint) and keys: each segment's number and value in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, number = 1 << np.arange(width, dtype=np.int64), np.arange(tables, dtype=np.int64) << 32
        for batch in _slices(batches):
            if not batch.num_rows:
                continue
            mark = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(mark, axis=1, count=tables * width, bitorder="little").reshape(-1, tables, width)
            keys = pa.FixedSizeListArray.from_arrays(pa.array((bits @ weight + number).ravel()), tables).cast(pa.list_(pa.int64()))
            last = np.ascontiguousarray(mark[:, -16:]).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(last[:, 0]), pa.array(last[:, 1]), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "a", "b", "keys"])

    return marks.select("id", "size", "mark").mapInArrow(run, "id long, size int, a long, b long, keys array<long>")


def _cut(rows: DataFrame, block: int, name: str) -> DataFrame:
    """``rows`` (key, id, ...) with i and j: keys of more than ``block`` ids are cut into blocks, each two of which meet."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = materialize(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), name)
    if large.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    cut = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select(*rows.columns, F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))


def _edges(held: pa.Table) -> np.ndarray:
    """Where the groups of (key, i, j) begin."""
    new = np.ones(held.num_rows, bool)
    new[1:] = np.any([np.diff(held.column(c).to_numpy()) != 0 for c in ("key", "i", "j")], axis=0)
    return np.flatnonzero(new)


def _by_group(rows: DataFrame, of: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``of`` makes of whole groups (key, i, j) and where they begin; no more than two blocks are held."""
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*rest, batch]).combine_chunks()
            edges = _edges(held)
            rest = held.slice(int(edges[-1])).to_batches()  # whole when the next group begins
            if len(edges) > 1:
                yield of(held.slice(0, int(edges[-1])), edges[:-1])
        if rest:
            held = pa.Table.from_batches(rest).combine_chunks()
            yield of(held, _edges(held))

    return rows.mapInArrow(run, schema)


def _spanning(rows: DataFrame, roots: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Links a, b from the ids of each group (key, i, j) to the ids of their roots."""

    def links(held: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        ids, found = held.column("id").to_numpy(), [np.zeros((2, 0), np.int64)]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), held.num_rows], strict=True):
            if b - a > 1:
                own, root = ids[a:b], roots(held.slice(a, b - a))
                found.append(np.stack([own, own[root]])[:, root != np.arange(b - a)])
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return _by_group(rows, links, "a long, b long")


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """key, i, j, id of those ``rows`` whose size and 128 bits allow the ``similarity`` to another one of their group."""

    def near(held: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        size, met = held.column("size").to_numpy(), np.zeros(held.num_rows, bool)
        bits = [held.column(c).to_numpy().view(np.uint64) for c in ("a", "b")]
        # A pair has the allowance of its smaller set, which is the larger one.
        most = np.floor(similarity_bits(similarity, size, 128)).astype(np.uint8)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), held.num_rows], strict=True):
            for low in range(a, b if b - a > 1 else a, step := max(1, (1 << 20) // (b - a))):
                high = min(low + step, b)
                far = np.bitwise_count(bits[0][low:high, None] ^ bits[0][None, a:b]) + np.bitwise_count(bits[1][low:high, None] ^ bits[1][None, a:b])
                one, other = np.nonzero(far <= most[low:high, None])
                one, other = one + low, other + a
                fits = (one != other) & (np.minimum(size[one], size[other]) >= similarity * np.maximum(size[one], size[other]))
                met[one[fits]] = met[other[fits]] = True
        kept = held.select(["key", "i", "j", "id"]).filter(pa.array(met)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], names=["key", "i", "j", "id"])

    return _by_group(rows, near, "key long, i int, j int, id long")


def _bits(held: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(held.column("bits").to_pylist()), np.uint64).reshape(held.num_rows, -1)


def _close(held: pa.Table, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """The rows of some whose size and bits allow the ``similarity`` to one."""
    own, size = _bits(held), held.column("size").to_numpy()

    def near_of(at: int, rest: np.ndarray) -> np.ndarray:
        least, most = np.minimum(size[rest], size[at]), np.maximum(size[rest], size[at])
        fits = least >= similarity * most
        rest, least = rest[fits], least[fits]
        return rest[_differing(own[rest], own[at]) <= similarity_bits(similarity, least)]

    return near_of


def similar_links(marks: DataFrame, similarity: float, block: int = 4096, missed: float = 1e-6) -> DataFrame:
    """Links a, b between ids of distinct marks whose size and bits allow the ``similarity``, by multi-index hashing.

    ``marks`` has id, mark and size. Each segment has a table of its odd values; a text with an odd value is an entry of it, one
    with an even value asks for the whole ball of radius 1 around it, all odd. Texts that meet in an entry are compared by
    size and 128 bits; marks follow only to those with a partner there, for the whole distance. Links span the components of an
    entry's blocks, never all pairs.
    """
    # Of two different sets one has as many shingles as the similarity needs for one more or less.
    asked = marks.where(F.col("size") + 1 >= 1 / (1 - similarity) - 1e-6) if similarity < 1 else marks.limit(0)
    width, tables = segments(similarity, asked.count(), missed=missed)
    values = materialize(segment_values(asked, width, tables), "segments")
    even = F.bit_count(F.col("key").bitwiseAND(F.lit((1 << width) - 1))) % 2 == 0
    flips = F.array(*(F.lit(1 << i).cast("long") for i in range(width)))
    ball = F.when(even, F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).otherwise(F.array("key"))
    rows = values.select("id", "size", "a", "b", F.explode("keys").alias("key")).withColumn("key", F.explode(ball))
    met = materialize(_met(_cut(rows, block, "large_entries"), similarity), "met")
    return _spanning(met.join(marks.select("id", "size", F.col("mark").alias("bits")), "id"), lambda held: _grown(held.num_rows, _close(held, similarity)))


def _verified_roots(held: pa.Table, similarity: float) -> np.ndarray:
    """For each row the first of its component by links of the true ``similarity``."""
    sets = [np.frombuffer(x, np.uint64) for x in held.column("shingles").to_pylist()]
    stop = np.cumsum([len(x) for x in sets])
    of = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], stop[:-1])
    size, flag = np.array([len(x) for x in sets]), np.zeros(int(stop[-1]) + 1, bool)
    close = _close(held, similarity)

    def near_of(at: int, rest: np.ndarray) -> np.ndarray:
        rest = close(at, rest)
        flag[of[at]] = True
        shared = np.array([np.count_nonzero(flag[of[i]]) for i in rest], np.int64)
        flag[of[at]] = False
        return rest[shared >= similarity * (size[rest] + size[at] - shared)]

    return _grown(held.num_rows, near_of)


def verified_links(families: DataFrame, texts: DataFrame, similarity: float, width: int, block: int = 256) -> DataFrame:
    """Links a, b between ids of a family whose shingle sets have the ``similarity``, counted in full.

    ``families`` has key, id, size and bits; ``texts`` has id and text of those ids at least. A text's shingles are sent
    once for every block of its family, so once for families of up to ``block`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_spans(_words(t.as_py()), width)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    sets = only(texts, "id", decided(families.select("id"), "id", outlast=False)).select("id", "text").mapInArrow(run, "id long, shingles binary")
    rows = _cut(families.select("key", "id"), block, "large_families").join(families.select("id", "size", "bits"), "id").join(materialize(sets, "shingles"), "id")
    return _spanning(rows.select("key", "i", "j", "id", "size", "bits", "shingles"), lambda held: _verified_roots(held, similarity))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, block: int = 4096, family_block: int = 256, id_col: str = "doc_id", text_col: str = "text", tag: str | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id, component (and the tag, if named), by similarity of the shingle sets.

    Rows link if the Jaccard similarity of their shingles is ``similarity`` or more. Candidates are found by multi-index
    hashing of 1,024-bit fingerprints (``similar_links``, which misses a millionth of the pairs of just that similarity, fewer above);
    their whole distance is verified with an allowance of six standard errors, and the families that it leaves are
    checked by the shingles themselves. Lower-cased texts with the same words and shingles are linked,
    also those without words; a null text counts as empty. component_id is the smallest doc_id reachable, null
    only if no row of the component has one; component tells such components apart. An empty table gives an
    empty result; further columns are ignored.
    """
    copy, row = (docs.select(id_col, text_col, tag), tag) if tag else tagged(docs.select(id_col, text_col))
    marks = materialize(similarity_marks(copy, id_col, text_col, row, width), "marks")
    one = F.min(F.struct("tag", "size")).alias("one")
    distinct = marks.groupBy("mark").agg(one, F.min("doc_id").alias("least")).select("mark", "least", F.col("one.tag").alias("id"), "one.size")
    distinct = materialize(distinct, "distinct")
    families = components(similar_links(distinct, similarity, block)).select(F.col("node").alias("id"), F.col("root").alias("key"))
    families = materialize(families.join(distinct.select("id", "size", F.col("mark").alias("bits")), "id"), "families")
    texts = copy.select(F.col(row).alias("id"), F.col(text_col).cast("string").alias("text"))
    roots = components(verified_links(families, texts, similarity, width, family_block)).withColumnRenamed("node", "id")
    placed = distinct.select("mark", "id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialize(placed.select("mark", "least", "root"), "placed")
    # Written, so that the join has exchanges of its own, whose large partitions Spark can split.
    lowest = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    named = placed.join(lowest, "root").select("mark", "component_id", "root")
    return marks.join(named, "mark").select("doc_id", "component_id", F.col("root").alias("component"), *([F.col("tag").alias(tag)] if tag else []))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of ``similar_groups``, the one with the smallest doc_id, with all its columns."""
    copy, tag = tagged(docs)
    with scratch(docs.sparkSession):
        groups = similar_groups(copy, tag=tag, **options)
        # Ties between rows with one doc_id, or with none, go to the smallest tag.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(tag).alias("tag")))
        stay = decided(groups.groupBy("component").agg(first.alias("first")).select("first.tag"), "tag")
    return only(copy, tag, stay).select(*docs.columns)
