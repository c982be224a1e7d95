"""Suffix-array dedup: removal of every byte covered by a long string that starts anywhere else too.

Not every suffix needs sorting. Each window of ``LENGTH`` bytes names an anchor: the position of the smallest
hash of 8 bytes among its first 256, leftmost of ties. The choice depends on the window's bytes only, so
equal windows name anchors at equal offsets, and the suffix at an anchor, with the bytes before it that its windows
have, stands for all windows that name it: their context.

1. Anchors whose first ``AHEAD`` bytes, which every window that names them has, occur once by their hash go: no suffix
   that differs from all others so early can take part in a repeat.
2. The contexts of the others are sorted by a merge sort. Each task makes sorted runs for every bucket of
   first bytes, in which equal contexts are one entry; runs are front-coded (each suffix as the length it shares with
   the one before, and the rest) and exchanged; the bucket's task combines them in a loser tree whose nodes remember
   common prefix lengths, so bytes known to be equal are never compared again.
3. Equal contexts, now neighbours, repeat in all their windows. For the others the common prefixes of neighbours tell
   which share enough bytes from the anchor on, and classes of equal bytes before it, refined byte by byte, which
   share enough before; windows for which another context shares both repeat.

All equality is that of bytes. Contexts whose first bytes more than ``MOST_CONTEXTS`` anchors share go through the same merge in
parts: each part has the windows that begin ``WIDTH`` neighbouring distances before the anchor, and lies in a bucket of the bytes that
all of these have, which are all but ``WIDTH`` - 1 of the ``LENGTH``.

Texts that repeat themselves at short distances would name an anchor at every byte. So an 8-byte word that comes again
within ``NEAR`` bytes names none if another word can, and in a stretch of a period of up to ``PERIOD`` bytes, whose windows all
equal one a period away, only the first period's windows keep their anchors, for other texts to meet.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import decided, kept, materialize, only, scratch, tagged

LENGTH, SPAN, KMER = 400, 256, 8
AHEAD = LENGTH - SPAN + 1
MOST_CONTEXTS = 200_000
WIDTH, NEAR, PERIOD = 16, 16, 64
_LOW = (1 << 24) - 1
_CHUNK = 1 << 20


def _words(piece: bytes, windows: int) -> np.ndarray:
    """The smaller comes first: hashes of the 8 bytes at each place, with the place; those that come again nearby after all others."""
    count = windows + SPAN - 1
    words = np.ndarray((count,), "<u8", piece, strides=(1,))
    mixed = words * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    # All of these bytes lie in every window that the place can be the anchor of: SPAN + NEAR + KMER <= LENGTH.
    later = np.ndarray((count + NEAR,), "<u8", piece, strides=(1,))
    again = np.zeros(count, bool)
    for step in range(1, NEAR + 1):
        again |= words == later[step : step + count]
    mixed >>= np.uint64(1)
    mixed |= again.astype(np.uint64) << np.uint64(63)
    return (mixed & np.uint64(~_LOW & (2**64 - 1))) | np.arange(count, dtype=np.uint64)


def _period_end(data: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose byte is not the one ``p`` before it."""
    while at < len(data):
        end = min(len(data), at + (1 << 16))
        off = np.flatnonzero(data[at:end] != data[at - p : end - p])
        if len(off):
            return at + int(off[0])
        at = end
    return at


def periodic(piece: bytes, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(first window, last window, period) of stretches of the piece in which windows equal those a period away.

    ``at``: the anchors' places in order. They lie densely in such a stretch, which is itself found by its bytes.
    """
    data, out, done, k = np.frombuffer(piece, np.uint8), [], 0, 0
    near = np.concatenate([np.diff(at) <= PERIOD, [False]])
    # Of anchors that the next one follows closely, those that are so over some hundred bytes.
    begins = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))
    for i, j in zip(begins.tolist(), np.flatnonzero(~near)[np.searchsorted(np.flatnonzero(~near), begins)].tolist(), strict=True):
        k = max(i, k)
        while k < j and at[j] - at[k] > PERIOD:
            low = int(at[k])
            second = piece.find(piece[low : low + 128], low + 1, low + PERIOD + 128)
            if second < 0:
                k += 1
                continue
            p = second - low
            high = _period_end(data, second + 128, p)
            while low > done and data[low - 1] == data[low - 1 + p]:
                low -= 1
            if high - LENGTH - low >= p:  # so that there are windows with another one a period away
                out.append((low, high - LENGTH, p))
                done = high - LENGTH + 1
            k = max(k + 1, int(np.searchsorted(at, high - LENGTH + 1)))
    return out


def anchors(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(position, first window, last window) of every anchor; windows are named by their first byte. Windows that
    ``settled_windows`` tells of have one in the first period of their stretch only."""
    for base in range(0, len(data) - LENGTH + 1, _CHUNK):
        piece = data[base : base + _CHUNK + LENGTH - 1]
        windows = len(piece) - LENGTH + 1
        least = _words(piece, windows)
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        at = (least & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        places = at[first]
        stretches = periodic(piece, places)
        for low, high, p in stretches:
            yield -1, base + low, base + high - p
            yield -1, base + low + p, base + high
        if stretches:
            keep = np.ones(windows, bool)
            for low, high, p in stretches:
                keep[low + p : high + 1] = False
            # Windows that are left are numbered in rows of the same anchor without a gap.
            left = np.flatnonzero(keep)
            cut = np.concatenate([[True], (at[left[1:]] != at[left[:-1]]) | (left[1:] != left[:-1] + 1)]) if len(left) else np.zeros(0, bool)
            first = left[cut]
            last = np.concatenate([left[np.flatnonzero(cut)[1:] - 1], left[-1:]])
            places = at[first]
        for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
            yield base + p, base + a, base + b


def _scan(docs: DataFrame) -> DataFrame:
    """uid, pos, back, most, ahead_hash; windows start at pos - most ... pos - back. Without a hash: windows that repeat where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                uid, out = [], []
                part = batch.slice(low, 256)
                for tag, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = (text.as_py() or "").encode()
                    view = memoryview(data)
                    for p, a, b in anchors(data):
                        if p < 0:
                            out.append((b, 0, b - a, 0, True))
                        else:
                            out.append((p, p - b, p - a, digest(view[p : p + AHEAD]), False))
                        uid.append(tag)
                rows = np.array([r[:4] for r in out], np.uint64).reshape(-1, 4)
                ints = [rows[:, i].astype(np.int32) for i in range(3)]
                ahead = pa.array(rows[:, 3].copy().view(np.int64), mask=np.array([r[4] for r in out], bool))
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), *map(pa.array, ints), ahead], names=["uid", "pos", "back", "most", "ahead_hash"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, pos int, back int, most int, ahead_hash long")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # a[known:low] is equal, a[known:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


_ENTRY = np.dtype([("shared", "<u2"), ("more", "<u2"), ("uid", "<i8"), ("pos", "<i4"), ("back", "<u2"), ("times", "<u1")])
_Entry = tuple[bytes, tuple[int, int, int, int]]  # context; uid, pos, back, times


def shared_lengths(items: list[bytes]) -> np.ndarray:
    """The length of the common prefix of each item and the one before; 0 for the first."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    out = np.zeros(len(items), np.int64)
    width = int(size.max(initial=0)) + 1
    for low in range(0, len(items) - 1, step := max(1, (1 << 23) // width)):
        part = items[low : low + step + 1]
        flat = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in part]), np.uint8).reshape(len(part), width)
        differs = flat[1:] != flat[:-1]
        first = np.where(differs.any(1), differs.argmax(1), width)
        out[low + 1 : low + len(part)] = np.minimum(first, np.minimum(size[low + 1 : low + len(part)], size[low : low + len(part) - 1]))
    return out


def front_code(items: list[_Entry]) -> bytes:
    """A sorted run: each context as the length it shares with the one before, and the rest; compressed."""
    table = np.zeros(len(items), _ENTRY)
    contexts = [x for x, _ in items]
    table["shared"] = shared = shared_lengths(contexts)
    table["more"] = [len(x) for x in contexts] - shared
    if items:
        for name, column in zip(("uid", "pos", "back", "times"), zip(*(x for _, x in items), strict=True), strict=True):
            table[name] = column
    data = table.tobytes() + b"".join([x[n:] for x, n in zip(contexts, shared.tolist(), strict=True)])
    return struct.pack("<IQ", len(items), len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def front_decode(run: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int, int]]]:
    """(shared length, context, payload) in order."""
    n, size = struct.unpack_from("<IQ", run)
    data = pa.decompress(run[12:], decompressed_size=size, codec="zstd", asbytes=True)
    table = np.frombuffer(data, _ENTRY, n)
    at, before = n * _ENTRY.itemsize, b""
    for shared, more, *payload in table.tolist():
        before = before[:shared] + data[at : at + more]
        at += more
        yield shared, before, tuple(payload)


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Loser tree over front-coded runs: (length shared with the output before, context, payload).

    Every candidate carries the length it shares with the last output. Of two candidates the one that shares
    more comes first; only if they share as much are bytes compared, from there on, and the loser then
    remembers what it shares with its winner, which is the next output on its path.
    """
    k = len(runs)
    heads: list[tuple[int, bytes, tuple] | None] = [next(r, None) for r in runs]
    shares = [0] * k
    losers = [-1] * max(1, k)

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser's share is brought up to date."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if shares[a] != shares[b]:
            return shares[a] > shares[b]
        shared = common_prefix(x[1], y[1], shares[a])
        first = (x[1][shared : shared + 1], a) <= (y[1][shared : shared + 1], b)
        shares[b if first else a] = shared
        return first

    def play(run: int) -> int:
        node = (run + k) // 2
        while node >= 1:
            other = losers[node]
            if other < 0:
                losers[node] = run
                return -1
            if beats(other, run):
                losers[node], run = run, other
            node //= 2
        return run

    if not k:
        return
    winner = 0 if k == 1 else -1
    if k > 1:
        for i in range(k):
            got = play(i)
            winner = got if got >= 0 else winner
    while heads[winner] is not None:
        _, suffix, payload = heads[winner]
        yield shares[winner], suffix, payload
        heads[winner] = next(runs[winner], None)
        if heads[winner] is not None:
            shares[winner] = heads[winner][0]  # with the suffix just given out
        if k > 1:
            winner = play(winner)


def settle(contexts: list[bytes], shared: np.ndarray, back: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, low, high): the offsets before its anchor at which windows of the i-th of sorted contexts repeat.

    A context is the ``LENGTH - back`` bytes from the anchor on, and those before it in reverse; ``shared[i]`` is
    its common prefix with the one before. ``times`` over 1 marks contexts that are settled: they are only compared with.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    most = size - (LENGTH - back)
    same = np.zeros(len(contexts), bool)
    same[1:] = (shared[1:] == size[1:]) & (size[1:] == size[:-1]) & (back[1:] == back[:-1])
    kind = np.cumsum(~same) - 1  # equal contexts are neighbours
    total = np.bincount(kind, times)
    whole = (times == 1) & (total[kind] > 1)
    found = list(zip(np.flatnonzero(whole).tolist(), back[whole].tolist(), most[whole].tolist(), strict=True))
    # One context of each kind is left, of those groups with equal first bytes that have an unsettled one and another.
    group = np.cumsum(shared < AHEAD)
    own = ~same
    kinds, free = np.bincount(group[own]), np.bincount(group[own], total[kind[own]] == 1)
    own &= (kinds[group] > 1) & (free[group] > 0)
    left = np.flatnonzero(own)
    if not len(left):
        return found
    back, most, open_ = back[left], most[left], total[kind[left]] == 1
    # What two of them share is the least that neighbours share in between.
    gap = np.minimum.reduceat(shared[: left[-1] + 1], np.concatenate([[0], left[:-1] + 1]))
    gap = np.where(np.concatenate([[True], np.diff(group[left]) != 0]), 0, gap)
    width = int(most.max())
    before = np.zeros((len(left), width + 1), np.uint8)
    for row, i in enumerate(left.tolist()):
        x = contexts[i][LENGTH - int(back[row]) :]
        before[row, : len(x)] = np.frombuffer(x, np.uint8)
    repeats = np.zeros((len(left), width + 2), bool)
    active, alike = np.arange(len(left)), np.cumsum(gap < AHEAD)
    for d in range(width + 1):
        if d:  # the classes of equal d bytes before the anchor
            stay = most[active] >= d
            active, alike = active[stay], alike[stay]
            _, alike, counts = np.unique(alike * 256 + before[active, d - 1], return_inverse=True, return_counts=True)
            stay = counts[alike] > 1  # a class of one stays so
            active, alike = active[stay], alike[stay]
        if not len(active):
            break
        now = back[active] <= d
        rows = active[now]
        far = np.cumsum(gap < LENGTH - d)[rows]  # equal numbers share LENGTH - d bytes from the anchor on
        _, inverse, counts = np.unique(alike[now] * (len(left) + 1) + far, return_inverse=True, return_counts=True)
        repeats[rows, d] = counts[inverse] > 1
    repeats[~open_] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeats.ravel().view(np.int8)])))  # the last column is never set
    lows, highs = edges[::2], edges[1::2] - 1
    return found + list(zip(left[lows // (width + 2)].tolist(), (lows % (width + 2)).tolist(), (highs % (width + 2)).tolist(), strict=True))


_FOUND = "bucket int, run binary, uid long, since int, until int"
_FOUND_ARROW = pa.schema([("bucket", pa.int32()), ("run", pa.binary()), ("uid", pa.int64()), ("since", pa.int32()), ("until", pa.int32())])


def _found(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _spans_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Spans of first bytes of windows that repeat, spread over the buckets."""
    uid, since, until = zip(*rows, strict=True) if rows else ((), (), ())
    return _found(uid=uid, since=since, until=until, bucket=[(u * 31 + s) & 0x7FFFFFFF for u, s in zip(uid, since, strict=True)])


def _merge_buckets(found: DataFrame, buckets: int, at_once: int = 20_000) -> DataFrame:
    """Merge the runs of each bucket and settle its contexts; other rows pass."""

    def merged(pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        contexts, shared, payload = [], [], []

        def flush() -> pa.RecordBatch:
            uid, pos, back, times = (np.array(x, np.int64) for x in zip(*payload, strict=True))
            at = settle(contexts, np.array(shared), back, times)
            spans = [(int(uid[i]), int(pos[i]) - high, int(pos[i]) - low) for i, low, high in at]
            for x in (contexts, shared, payload):
                x.clear()
            return _spans_of(spans)

        for share, context, entry in merge_runs([front_decode(p) for p in pieces]):
            if share < AHEAD and len(contexts) >= at_once:
                yield flush()
            contexts.append(context)
            shared.append(share if contexts[1:] else 0)
            payload.append(entry)
        if contexts:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, pieces = None, []
        for batch in batches:
            yield batch.filter(batch.column(1).is_null())
            for b, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not piece.is_valid:
                    continue
                if b != bucket:
                    if pieces:
                        yield from merged(pieces)
                    bucket, pieces = b, []
                pieces.append(piece.as_py())
        if pieces:
            yield from merged(pieces)

    return found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def _parts(data: bytes, p: int, back: int, most: int, bucket: int, many: bool, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, back, most) under which the context of an anchor is merged: itself, or its parts if its first bytes are those of many."""
    if not many:
        yield bucket, back, most
        return
    for near in range(back - back % WIDTH, most + 1, WIDTH):
        far = near + WIDTH - 1
        # What the windows of this part have in common, whichever text they are in.
        same = data[p - near : p + LENGTH - far]
        yield xxhash.xxh64_intdigest(same, near) % buckets, max(back, near), min(most, far)


def _extract(placed: DataFrame, buckets: int, most_held: int = 1 << 26) -> DataFrame:
    """Sorted runs of the contexts of many texts by bucket, and what equal contexts among them settle at once.

    Contexts marked ``many`` come in parts, each in the bucket of the bytes that its windows share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, tuple[int, int, int]]] = {}
        twice: set[tuple[int, int, int]] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            names, runs = [], []
            for bucket, own in sorted(held.items()):
                names.append(bucket)
                runs.append(front_code(sorted((c[2:], (*entry, 2 if entry in twice else 1)) for c, entry in own.items())))
            held.clear()
            twice.clear()
            return _found(bucket=names, run=runs)

        for batch in batches:
            settled: list[tuple[int, int, int]] = []
            ends, fields = batch.column(2).offsets.to_pylist(), batch.column(2).values
            columns = [fields.field(c) for c in ("pos", "back", "most", "bucket", "many")]
            for i, uid in enumerate(batch.column(0).to_pylist()):
                data = (batch.column(1)[i].as_py() or "").encode()
                for low in range(ends[i], ends[i + 1], 4096):  # a long text's contexts in slices
                    high = min(low + 4096, ends[i + 1])
                    for p, *context in zip(*(c.slice(low, high - low).to_pylist() for c in columns), strict=True):
                        for bucket, back, most in _parts(data, p, *context, buckets):
                            # The length from the anchor on leads, so that equal keys are equal contexts.
                            key = struct.pack(">H", LENGTH - back) + data[p : p + LENGTH - back] + data[p - most : p][::-1]
                            first = held.setdefault(bucket, {}).setdefault(key, (uid, p, back))
                            if first == (uid, p, back):
                                size += len(key) + 150
                                continue
                            settled.append((uid, p - most, p - back))
                            if first not in twice:
                                twice.add(first)
                                settled.append((first[0], first[1] - most, first[1] - back))
                    if len(settled) > 100_000:
                        yield _spans_of(settled)
                        settled = []
                    if size > most_held:
                        yield flush()
                        size = 0
            if settled:
                yield _spans_of(settled)
        yield flush()

    return placed.mapInArrow(run, _FOUND)


def repeated_windows(texts: DataFrame, most_contexts: int = MOST_CONTEXTS, a_bucket: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(uid, since, until of first bytes of windows that repeat in ``texts`` (uid, text); uid, n_shared of texts with candidates)."""
    found = materialize(_scan(texts), "anchors")
    # Written, so that the join below has exchanges of its own, whose large partitions Spark can split.
    often = materialize(found.where("ahead_hash is not null").groupBy("ahead_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    parts = F.when(F.col("n") > most_contexts, SPAN // WIDTH).otherwise(1)
    total = often.agg(F.coalesce(F.sum(F.col("n") * parts), F.lit(0))).first()[0]
    # A bucket of first bytes has about a_bucket contexts, so their number grows with the corpus.
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // a_bucket)
    bucket = F.pmod("ahead_hash", F.lit(buckets)).cast("int")
    likely = found.join(often, "ahead_hash").select("uid", F.struct("pos", "back", "most", bucket.alias("bucket"), (F.col("n") > most_contexts).alias("many")).alias("context"))
    by_text = materialize(likely.groupBy("uid").agg(F.collect_list("context").alias("contexts")), "candidates")
    some = only(texts, "uid", decided(by_text, "uid", outlast=False))
    done = materialize(_merge_buckets(_extract(some.join(by_text, "uid").select("uid", "text", "contexts"), buckets), buckets), "repeats")
    alone = found.where("ahead_hash is null").select("uid", (F.col("pos") - F.col("most")).alias("since"), F.col("pos").alias("until"))
    shared = by_text.select("uid", F.size("contexts").cast("long").alias("n_shared")).unionByName(alone.select("uid", F.lit(1).cast("long").alias("n_shared")))
    return done.select("uid", "since", "until").unionByName(alone), shared.groupBy("uid").agg(F.sum("n_shared").alias("n_shared"))


def _cut(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes kept, the number removed and the number of runs removed."""
    kept, removed, runs, at = [], 0, 0, 0  # everything before ``at`` is done
    for s in sorted((x["since"], x["until"] + LENGTH) for x in spans):
        if s[1] <= at:
            continue
        if s[0] > at or not runs:
            kept.append(data[at : s[0]])
            runs += 1
            at = s[0]
        removed += s[1] - max(at, s[0])
        at = s[1]
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, keep_text: bool = False, most_contexts: int = MOST_CONTEXTS, a_bucket: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (and kept, the bytes left, if asked).

    ``n_shared`` counts the anchors, one in about 128 bytes, whose next ``AHEAD`` bytes follow another anchor too: over 0 for
    nearly every text with a passage of some 350 bytes that occurs elsewhere, though repeats under LENGTH bytes stay. A
    stretch that repeats itself counts as one.

    A null text counts as empty; texts under LENGTH bytes have no windows and stay whole. Matches never cross
    rows; repeated rows are copies of each other and lose all they share. Rows are known by tags that are the same
    whenever they are read. An empty table gives an empty result; further columns are ignored.
    """
    copy, tag = tagged(docs.select("doc_id", F.col("text")))
    rows = copy.select(F.col(tag).alias("uid"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        spans, shared = repeated_windows(rows.select("uid", "text"), most_contexts, a_bucket)
        spans = spans.groupBy("uid").agg(F.collect_list(F.struct("since", "until")).alias("spans"))
        by_text = kept(shared.join(spans, "uid", "left"), "spans")
        hit = decided(by_text, "uid")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, texts = [], [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                left, n, k = _cut(data, own or [])
                sizes.append(len(data))
                removed.append(n)
                runs.append(k)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), batch.column(3)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * keep_text
    # Only texts that may lose something are exchanged, to meet their spans.
    some = only(rows, "uid", hit).join(by_text, "uid").select("doc_id", "text", "spans", "n_shared")
    rest = only(rows, "uid", hit, others=True).select("doc_id", "text", F.lit(None).cast(some.schema["spans"].dataType).alias("spans"), F.lit(0).cast("long").alias("n_shared"))
    return some.unionByName(rest).mapInArrow(run, schema)
