"""Each operator against a brute-force version on small tables with the awkward rows: nulls, empty and long
texts, ties, repeated rows, clashing column names, and tables without rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, exact, kdshard, mixing, ordinal, outliers, queries, simhash, suffix, wavelet
from tidewell.llm.graph import components
from tidewell.llm.queries import vocabulary
from tidewell.llm.store import decided, kept, new_path, only, scratch, tagged

SCHEMA = "doc_id long, text string, lang string, source string, digest string, run long, tag string, block string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(140))
    texts = [" ".join(word() for _ in range(rng.randint(1, 260))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[3] + " more", passage, "x " + passage + " y", word() + passage + word(), passage[:500]]
    texts += ["", "", None, " \n\t", "a", "ab ab ab ab ab ab", "z" * 3000, "line one\nline one\n\nline one x\n" * 9, "a<|endoftext|> b 日本 ²", " ".join(word() for _ in range(9000))]
    out = [(i, t, None if i % 11 == 0 else "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [out[5], (None, "no id", "en", "s1"), (None, None, None, None)]
    return [(*r, "d", 1, "t", "b") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_exact(docs, none, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: -1 if x is None else x, reverse=True):
            want.append((i, keep, len(ids), first, sha))
            first = False
    for fan_in in (2, 16):
        same([tuple(r) for r in exact.exact_groups(docs, "largest", fan_in).collect()], want)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_groups(none).count() == 0 == exact.drop_exact_duplicates(none).count()


def _fingerprint(text):
    words = WORDS("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(marks):
    marks = sorted(set(marks))
    root = {m: m for m in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if bin(a ^ b).count("1") <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_simhash(docs, none, rows):
    marks = [_fingerprint(r[1]) for r in rows]
    root = _brute_components(marks)
    least = {}
    for r, m in zip(rows, marks, strict=True):
        if r[0] is not None:
            least[root[m]] = min(least.get(root[m], r[0]), r[0])
    want = [(r[0], f"{m:016x}", least.get(root[m])) for r, m in zip(rows, marks, strict=True)]
    same([tuple(r) for r in simhash.simhash_groups(docs).collect()], want)
    assert simhash.simhash_groups(none).count() == 0


def _shingles(text):
    words = WORDS("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("blocks", [(3, 2), (4096, 256)])
def test_near_duplicates(spark, docs, none, rows, blocks):
    """Groups by a Jaccard similarity of 0.8 over five-word shingles, against all pairs."""
    rng = random.Random(9)
    texts = [r[1] for r in rows]
    for n in (90, 120, 260):  # edits of one text that leave similarities on both sides of 0.8
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for edits in [0, 1, 1, 2, 2, 3, 4, 6, 9]:
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = f"e{rng.randrange(4000)}"
            texts.append(" ".join(copy))
    sets = [_shingles(t) for t in texts]
    ids = [r[0] for r in rows] + list(range(1000, 1000 + len(texts) - len(rows)))
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if root[b] < root[a] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    root[a], changed = root[b], True
    least = {}
    for i, g in zip(ids, root, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", "d", 1, "t", "b") for i, t in zip(ids[len(rows) :], texts[len(rows) :], strict=True)], SCHEMA))
    got = simhash.similar_groups(more, block=blocks[0], family_block=blocks[1])
    same([(r.doc_id, r.component_id) for r in got.collect()], [(i, least.get(g)) for i, g in zip(ids, root, strict=True)])
    kept = simhash.drop_near_duplicates(more)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert kept.count() == len(set(root))
    assert simhash.similar_groups(none).count() == 0 == simhash.drop_near_duplicates(none).count()


def test_near_duplicates_by_kind_of_edit(spark):
    """Every pair of edited copies just above the similarity is found, and none just below, wherever the edit lies."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, kinds = [], []
    for kind, least, most in (("appended", 0.17, 0.27), ("truncated", 0.15, 0.22), ("replaced", 0.08, 0.12), ("short", 0.1, 0.3)):
        for _ in range(100):
            n = rng.randrange(8, 30) if kind == "short" else rng.randrange(60, 600)
            base, k = words(n), max(1, round(n * rng.uniform(least, most)))
            at = rng.randrange(n - k)
            copy = base[: n - k] if kind == "truncated" else base[:at] + words(k) + base[at + k :] if kind == "replaced" else base + words(k)
            texts += [" ".join(base), " ".join(copy)]
            kinds.append(kind)
    sets = [_shingles(t) for t in texts]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert {(k, x) for k, x in zip(kinds, near, strict=True)} == {(k, x) for k in kinds for x in (True, False)}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [got[2 * i] == got[2 * i + 1] for i in range(len(near))]
    assert Counter(k for k, x, y in zip(kinds, near, found, strict=True) if x != y) == Counter()


def test_near_duplicates_meet_by_segments(spark):
    """Pairs of just the similarity are found by the segments of their fingerprints, without any word of the texts, and no others are."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):  # 80 of 100 shingles in common
        hashes = rng.integers(0, 1 << 64, 100, np.uint64)
        sets += [hashes[:90], hashes[10:]]
    marks = spark.createDataFrame([(i, bytearray(simhash.similarity_mark(s).tobytes()), len(s)) for i, s in enumerate(sets)], "id long, mark binary, size int")
    for block in (7, 4096):
        assert {tuple(sorted(r)) for r in simhash.similar_links(marks, 0.8, block).collect()} == {(2 * i, 2 * i + 1) for i in range(150)}
    width, tables = simhash.segments(0.8, 10_000_000)
    assert width * tables <= 1024 and (width + 1) / 2 * tables < 400  # rows a text


def test_near_copies_of_the_corpus(spark):
    """The rule's 0.8 finds all pairs that reach it; a lower similarity finds the corpus's edited copies and leaves all others alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["text"])
    texts = {r.doc_id: _shingles(r.text) for r in docs.collect()}
    ids = sorted(texts)
    alike = {(a, b): len(texts[a] & texts[b]) / max(1, len(texts[a] | texts[b])) for i, a in enumerate(ids) for b in ids[:i]}
    for least in (0.8, 0.35):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, similarity=least).collect()}
        pairs = [p for p, s in alike.items() if s >= least]
        assert all(got[a] == got[b] for a, b in pairs)
        assert {i for i in ids if sum(got[j] == got[i] for j in ids) > 1} == {i for p in pairs for i in p}
    assert len([s for s in alike.values() if s >= 0.35]) >= len([s for s in alike.values() if s >= 0.1]) > 5  # nothing lies in between


@pytest.mark.parametrize("block", [3, 4096])
def test_simhash_links_in_blocks(spark, block):
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(6)]
    marks = set(base)
    while len(marks) < 160:  # clusters that share halves, so that small blocks are cut
        marks.add(rng.choice(sorted(marks)) ^ 1 << rng.randrange(64) ^ (rng.random() < 0.5) << rng.randrange(64))
    table = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    got = {r.fp % (1 << 64): r.root % (1 << 64) for r in simhash.near_components(table, block=block).collect()}
    root = _brute_components(marks)
    groups = lambda f: {frozenset(m for m in marks if f(m) == v) for v in {f(m) for m in marks}}
    assert groups(lambda m: got.get(m, m)) == groups(root.get)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_chat(spark):
    talks = [(1, t, r, x) for t, (r, x) in enumerate([("system", "s"), ("user", "hi"), ("assistant", "a < b \\ c"), ("user", None)])]
    talks += [(2, *t[1:]) for t in talks[:3]] + [(2, 3, "user", "other")] + [(3, *t[1:]) for t in talks] + [(4, 0, None, "x"), (4, 0, None, "x"), (None, 1, "assistant", "lost")]
    talks += [(5, 0, "user", "long " * 30_000), (5, 1, "assistant", "x" * 200_000)]
    extra = [(*t, "c", ["u"], b"n") for t in talks]
    plain = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, conv string, turns array<string>, node binary")
    table = chat.with_probe(spark, plain)
    same([(r.node, r.text) for r in chat.format_conversations(plain)[0].collect()], [(r.node, r.text) for r in chat.format_conversations(plain.select("conv_id", "turn", "role", "text"))[0].collect()])
    stream, index = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.read_conversations(stream, index)).collect()}
    by = {}
    for c, t, r, x in talks + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    nodes = stream.orderBy("start").collect()
    assert nodes[0].start == 0 and all(a.stop == b.start for a, b in zip(nodes, nodes[1:], strict=False))
    assert sum(len(n.text) for n in nodes) < sum(r.formatted_chars for r in got.values())  # shared turns once
    assert all(n.position == sum(s.stop - s.start for s in n.attend) for n in nodes)
    assert chat.read_conversations(*chat.format_conversations(table.limit(0))).count() == 0


def test_kd_shards(docs, none, rows):
    got = kdshard.kd_shards(docs, shards=5, rows_a_block=10).collect()
    want = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows]
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], want)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert kdshard.kd_shards(none, shards=5).count() == 0
    same(got, kdshard.kd_shards(docs.coalesce(1), shards=5, rows_a_block=10).collect())
    big = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sizes = [r.n for r in kdshard.kd_shards(big, target_bytes=17 * 500).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * min(sizes)  # one group over all leaves, in pieces of an eighth of one


def test_kd_shards_follow_the_law(spark):
    """Sizes near equal, groups of equal texts whole, and every cut at the weighted point of the widest dimension."""
    rng = random.Random(3)
    table = [(i, f"{rng.randrange(10**6)} " * rng.randrange(1, 60), rng.choice(["en", "de"]), f"s{rng.randrange(9)}") for i in range(3000)]
    table += [(3000 + i, table[i % 40][1], "fr", "s1") for i in range(400)]
    got = kdshard.kd_shards(spark.createDataFrame(table, "doc_id long, text string, lang string, source string"), shards=24).collect()
    sizes, groups = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        groups.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(len(s) == 1 for s in groups.values())
    # The root: 12 of 24 leaves on either side of one value of one coordinate, but for the boundary bin.
    text = {r[0]: r for r in table}
    coordinate = {"size": lambda r: len(r[1]), "id": lambda r: r[0], "lang": lambda r: r[2], "source": lambda r: r[3]}
    for name in ("lang", "source"):  # names are lanes by hash: a cut keeps all but one of them whole
        sides = {}
        for r in got:
            sides.setdefault(coordinate[name](text[r.doc_id]), Counter())[r.shard < 12] += r["size"]
        if sum(min(c[True], c[False]) > 0.2 * sum(c.values()) for c in sides.values()) <= 1:
            break
    else:
        low = [coordinate["size"](text[r.doc_id]) for r in got if r.shard < 12]
        high = [coordinate["size"](text[r.doc_id]) for r in got if r.shard >= 12]
        ids = [sorted(r.doc_id for r in got if (r.shard < 12) == side) for side in (True, False)]
        assert np.median(low) < np.median(high) or np.median(ids[0]) < np.median(ids[1])


def test_bpe(docs, none, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same([tuple(r) for r in bpe.encode_documents(docs, vocabulary()).collect()], want)
    assert bpe.encode_documents(none, vocabulary()).count() == 0
    auto, rng = bpe.load_automaton(vocabulary()), random.Random(1)
    for letters in ("a", "ab", "theinrs", "0123", "-=_"):  # long words without a space, where ways end blindly
        for n in (1, 7, 400, 20_000):
            word = "".join(rng.choice(letters) for _ in range(n))
            ids = auto.encode_word(word.encode())
            assert ids == [t.id for t in library.model.tokenize(word)]
            assert auto.decode(ids) == word.encode()
    with pytest.raises(ValueError):
        bpe.TokenAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")]).encode_word(b"abc")


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 5000)
    matrix, size = wavelet.WaveletMatrix.from_bytes(data := wavelet.WaveletMatrix.build(ids).to_bytes())
    assert size == len(data) and (matrix.ids() == ids).all()
    for i in (0, 17, 511, 512, 4999):
        assert matrix.access(i) == ids[i]
    for t in (0, 5, 299, 301, 1 << 20):
        places = np.flatnonzero(ids == t)
        assert matrix.count(t) == len(places) and matrix.count(t, 100, 2000) == ((places >= 100) & (places < 2000)).sum()
        assert [matrix.find(t, k) for k in range(min(5, len(places) + 1))] == [*places[:5], -1][: min(5, len(places) + 1)]
    assert not len(wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.zeros(0, int)).to_bytes())[0].ids())


def test_vocabularies_that_are_refused(tmp_path):
    import json

    spec = json.load(open(vocabulary()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.read_vocabulary(str(path))
    assert bpe.read_vocabulary(vocabulary()) == spec


def test_ids_that_dont_fit_are_an_error():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1, 70_000]), 16)
    assert (wavelet.WaveletMatrix.build(np.array([1, 70_000]), 17).ids() == [1, 70_000]).all()


def test_token_shards(spark, docs, none, rows):
    path = new_path(spark, "shards")
    wavelet.write_token_shards(docs, path, vocabulary(), shard_tokens=2000)
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(vocabulary()), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((r[0], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    same([tuple(r) for r in wavelet.read_token_shards(spark, path).collect()], want)
    wavelet.write_token_shards(none, path := new_path(spark, "shards"), vocabulary())
    assert wavelet.read_token_shards(spark, path).count() == 0


@pytest.mark.parametrize("most_contexts, a_bucket", [(50_000, 20_000), (50_000, 10), (1, 10)])
def test_suffix(docs, none, rows, most_contexts, a_bucket):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[s : s + 400] for _, t in data for s in range(len(t) - 399))
    want = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        mask = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want.append((i, len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 5000
    got = suffix.remove_repeats(docs, most_contexts=most_contexts, a_bucket=a_bucket).collect()
    same([tuple(r)[:5] for r in got], want)
    assert all(r.n_shared > 0 for r in got if r.n_removed) and any(r.n_shared == 0 for r in got)
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_query_when_scans_split_files_anew(spark, docs, tmp_path, monkeypatch):
    """The final cut hits the right documents even if Spark splits the table otherwise by then."""
    docs.repartition(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    found = suffix.repeated_windows

    def then_split_anew(*args):
        spans, shared = (kept(x, "spans") for x in found(*args))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        return spans, shared

    want = list(map(tuple, suffix.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix, "repeated_windows", then_split_anew)
    try:
        got = list(map(tuple, queries.op6_suffix_dedup(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same(got, want)


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), (i, i, i % 9, 1)) for i in range(200))
    runs = [sorted(items[k::7]) for k in range(7)]
    merged = list(suffix.merge_runs([suffix.front_decode(suffix.front_code(r)) for r in runs]))
    assert [m[1] for m in merged] == [i[0] for i in items] and {m[2] for m in merged} == {i[1] for i in items}
    for (_, a, _), (shared, b, _) in zip(merged, merged[1:], strict=False):
        assert shared == suffix.common_prefix(a, b)
    assert list(suffix.merge_runs([])) == [] == list(suffix.front_decode(suffix.front_code([])))


@pytest.mark.parametrize("seed", range(40))
def test_settled_contexts_against_all_windows(seed):
    """The windows that a merge of three runs settles, against the windows' own bytes."""
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(800))
    items = []
    for i in range(rng.randint(1, 14)):
        data = bytearray(base)
        for _ in range(rng.randint(0, 3)):
            data[rng.randrange(800)] ^= 3
        most = rng.randint(0, 255)
        back = rng.randint(0, most)
        items.append((bytes(data[400 : 800 - back]) + bytes(data[400 - most : 400])[::-1], (i, 400, back, rng.choice([1, 1, 1, 2]))))
    items.append((items[0][0], (99, 400, items[0][1][2], 1)))
    items.sort()
    merged = list(suffix.merge_runs([suffix.front_decode(suffix.front_code(items[k::3])) for k in range(3)]))
    payload = np.array([m[2] for m in merged])
    contexts, shared = [m[1] for m in merged], np.array([0, *(m[0] for m in merged[1:])])
    windows = {}
    for i, c in enumerate(contexts):
        back = int(payload[i, 2])
        ahead, before = c[: 400 - back], c[400 - back :]
        for d in range(back, len(before) + 1):
            windows.setdefault((d, ahead[: 400 - d], before[:d]), []).append(i)
    want = Counter((i, d) for (d, _, _), own in windows.items() for i in own if payload[i, 3] == 1 and (len(own) > 1 or payload[own[0], 3] > 1))
    assert Counter((i, d) for i, low, high in suffix.settle(contexts, shared, payload[:, 2], payload[:, 3]) for d in range(low, high + 1)) == want


def test_row_tags_and_decisions(spark, tmp_path):
    spark.range(70_000).selectExpr("id as doc_id", "cast(id % 5 as string) as text").repartition(3).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for docs in (table, table.where("doc_id % 2 = 0"), table.unionByName(table), spark.range(10).selectExpr("id as doc_id", "'x' as __row")):
        copy, tag = tagged(docs)
        assert copy.columns == [*docs.columns, tag] and copy.select(tag).distinct().count() == docs.count()
        with scratch(spark):
            pages = decided(copy.where("doc_id % 7 = 3").select(tag), tag)
        assert sorted(r.doc_id for r in only(copy, tag, pages).collect()) == sorted(r.doc_id for r in docs.where("doc_id % 7 = 3").collect())
        assert only(copy, tag, pages, others=True).where("doc_id % 7 = 3").count() == 0 and only(copy, tag, pages, others=True).count() == docs.where("doc_id % 7 <> 3").count()
    one, two = tagged(table)[0], tagged(spark.read.option("x", 1).parquet(f"{tmp_path}/t"))[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert one.exceptAll(two).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mixing(docs, none, rows):
    got = mixing.mix_sources(docs, block_words=64, rows_a_block=10).collect()
    sizes = [len(WORDS(r[1] or "")) for r in rows]
    same([(r.doc_id, r.source, r["size"]) for r in got], [(r[0], r[3], s) for r, s in zip(rows, sizes, strict=True)])
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    total = {n: sum(s for r, s in zip(rows, sizes, strict=True) if r[3] == n) for n in names}
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if level * weight[n] > 3 * total[n]}
        target |= {n: 3.0 * total[n] if n in full else level * weight[n] for n in full or free}
        left -= sum(target[n] for n in full)
        free = free - full if full else set()
    for n in names:
        own = [r for r in got if r.source == n]
        assert own[0].target == pytest.approx(target[n]) and abs(sum(r.taken for r in own) - target[n]) <= 1
    assert all(r.taken <= 3 * r["size"] for r in got)
    same(got, mixing.mix_sources(docs.coalesce(2), block_words=64, rows_a_block=7).collect())
    assert mixing.mix_sources(none).count() == 0 == mixing.mixed_documents(none).count()
    mixed = mixing.mixed_documents(docs, block_words=64, rows_a_block=10)
    assert mixed.columns == docs.columns
    found = Counter()
    for r in mixed.collect():
        found[r.source] += len(WORDS(r.text))
        assert any(t[0] == r.doc_id and (t[1] or "").startswith(r.text) for t in rows)
    assert all(abs(found[n] - target[n]) <= 1 for n in names)
    by_doc = Counter()
    for r in mixed.collect():
        by_doc[r.doc_id] += len(WORDS(r.text))
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert +by_doc == +taken


def test_mix_is_interleaved(spark):
    """Every stretch of the mix has the sources in their shares."""
    table = spark.range(3000).selectExpr("id as doc_id", "concat('a ', repeat('w ', cast(id % 40 as int))) as text", "concat('s', id % 3) as source")
    mixed = mixing.mixed_documents(table, block_words=100).coalesce(1).collect()
    words = [(r.source, len(WORDS(r.text))) for r in mixed]
    share = lambda rows, s: sum(n for x, n in rows if x == s) / sum(n for _, n in rows)
    for at in range(0, len(words) - 600, 300):
        for s in ("s0", "s1", "s2"):
            assert abs(share(words[at : at + 600], s) - share(words, s)) < 0.08


def test_outliers(docs, none, rows):
    def stats(text):
        words = WORDS(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS(x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)

    out = outliers.quality_rules(docs).collect()
    want = []
    for r in rows:
        s = stats(r[1])
        want.append((r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    same([tuple(r)[:7] for r in out], want)
    assert not any(r.kept for r in out if r.base_failed) and all(r.kept for r in out if not r.base_failed)
    assert outliers.quality_rules(none).count() == 0


def test_outliers_reject(spark):
    rng = random.Random(9)
    text = lambda end: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + end for _ in range(120))
    table = spark.createDataFrame([(i, text("###" if i % 50 == 0 else ""), "en", f"s{i % 2}") for i in range(600)], "doc_id long, text string, lang string, source string")
    for r in outliers.quality_rules(table).collect():
        assert r.kept == (r.doc_id % 50 != 0)
    # Cells that are too small are judged by their language's rows, or by all.
    for r in outliers.quality_rules(table.withColumn("source", F.when(F.col("doc_id") % 29 < 2, F.concat(F.lit("t"), F.col("doc_id") % 2)).otherwise(F.col("source")))).collect():
        assert r.kept == (r.doc_id % 50 != 0)
    for r in outliers.quality_rules(table.withColumn("lang", F.when(F.col("doc_id") % 37 == 0, "xx").otherwise("en"))).collect():
        assert r.kept == (r.doc_id % 50 != 0)


def _numpy_mcd(x, starts=300):
    """The half with the smallest determinant, by concentration steps from many random starts."""
    rng, n, p = np.random.default_rng(0), *x.shape
    ridge, half = np.diag(np.square(outliers._RIDGE)), math.ceil(n / 2)
    best = None
    for _ in range(starts):
        own, last = x[rng.choice(n, p + 1, replace=False)], np.inf
        while True:
            m, scatter = own.mean(0), np.cov(own.T, bias=True) + ridge
            now = np.linalg.slogdet(scatter)[1]
            if now > last - 1e-10 and len(own) >= half:
                break
            last = now if len(own) >= half else np.inf
            d2 = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(scatter), x - m)
            own = x[d2 <= np.sort(d2)[half - 1]]
        if best is None or now < best[0]:
            best = now, m, scatter
    return best


def test_mcd_against_many_random_starts(spark):
    """Determinants and verdicts of each cell: clean ones, one with 40 percent junk, one with a constant statistic, a small one."""
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(5, 5)) * 0.1
    cells = {"clean": 120, "junk": 90, "constant": 60, "small": 40}
    data = {c: rng.standard_t(12, size=(n, 5)) @ mix for c, n in cells.items()}
    data["junk"][:36] += 4
    data["constant"][:, 2] = 0.25
    data["clean"][:3] -= 5
    rows = [(c, i, *map(float, x)) for c, own in data.items() for i, x in enumerate(own)]
    table = spark.createDataFrame(rows, "cell string, i int, " + ", ".join(f"{n} double" for n in outliers.STATS))
    fits = {r.cell: r for r in outliers.mcd_estimates(table.drop("i")).collect()}
    far = {(r.cell, r.i): r.d2 for r in outliers.mcd_distances(table.drop("i"), table).collect()}
    for c, x in data.items():
        logdet, m, scatter = _numpy_mcd(x)
        assert fits[c].logdet <= logdet + 0.25
        d2 = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(scatter), x - m)
        d2 *= outliers._MEDIAN / np.sort(d2)[math.ceil(len(x) / 2) - 1]
        got = np.array([far[c, i] for i in range(len(x))])
        assert ((got > outliers._TAIL) == (d2 > outliers._TAIL)).all()
    assert all(far["junk", i] > outliers._TAIL for i in range(36)) and all(far["junk", i] <= outliers._TAIL for i in range(36, 90))
    assert all(far["clean", i] > outliers._TAIL for i in range(3))


@pytest.mark.parametrize("share", [30, 45])
def test_outliers_reject_copies_of_one_page(spark, share):
    """Copies of one junk page that fill ``share`` percent of a cell stay outside its estimate."""
    rng = random.Random(9)
    text = lambda end: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + end for _ in range(120))
    junk = text("###")
    table = spark.createDataFrame([(i, junk if i % 100 < share else text(""), "en", "s") for i in range(600)], "doc_id long, text string, lang string, source string")
    for r in outliers.quality_rules(table).collect():
        assert r.kept == (r.doc_id % 100 >= share)


def test_ordinal(spark, docs, none):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    word = lambda: rng.choice(known)
    text = lambda g: " ".join([word() for _ in range(60)] + ["vile"] * (g == 0) + ["!!!" + word() for _ in range(30)] * (g == 1))
    grades = [rng.choice([0, 1, 2, 2, 2]) for _ in range(2600)]
    table = spark.createDataFrame([(i, text(g)) for i, g in enumerate(grades)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, g in enumerate(grades[:2000])] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.train(table, labels, most_rows=1800)
    assert model.thresholds[0] < model.thresholds[1]
    held = [r for r in ordinal.grade_documents(table, model).collect() if r.doc_id >= 2000]
    right = lambda gs, kept: np.mean([r.kept == kept for r in held if grades[r.doc_id] in gs])
    assert right({2}, True) > 0.95 and right({0, 1}, False) > 0.95
    kept = ordinal.grade_documents(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() == ordinal.grade_documents(docs, model).where("kept").count()
    assert ordinal.grade_documents(none, model).count() == 0
    assert ordinal.train(table.limit(0), labels).weights.sum() == 0


def test_ordinal_likelihood_and_scores(spark):
    """The fit against a numeric gradient of the penalised likelihood, scores against sums over features."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(300)]
    truth = rng.normal(size=40)
    grades = np.digitize([truth[r].sum() + rng.logistic() for r in rows], [-1, 1]).astype(np.int64)
    penalty = 1e-2
    model = ordinal.fit_ordinal(rows, grades, rounds=3000, rate=0.02, penalty=penalty)

    def loss(weights, cuts):
        edges = np.array([-np.inf, *cuts, np.inf])
        p = [1 / (1 + np.exp(-(edges[g + 1] - weights[r].sum()))) - 1 / (1 + np.exp(-(edges[g] - weights[r].sum()))) for r, g in zip(rows, grades, strict=True)]
        return -np.mean(np.log(p)) + penalty / 2 * np.sum(weights**2)

    best = loss(model.weights, model.thresholds)
    for i in range(40):
        for step in (1e-3, -1e-3):
            other = model.weights.copy()
            other[i] += step
            assert loss(other, model.thresholds) > best - 1e-6
    for step in (1e-3, -1e-3):
        assert loss(model.weights, model.thresholds + step) > best - 1e-6
        assert loss(model.weights, model.thresholds + [step, 0]) > best - 1e-6
    texts = [f"{w} word{w} UPPER{w % 7} 12{w}!" for w in range(60)] + ["", None]
    wide = ordinal.OrdinalModel(np.random.default_rng(6).normal(size=1 << ordinal.BITS), np.array([-0.5, 0.7]))
    got = {r.doc_id: r for r in ordinal.grade_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), wide).collect()}
    for i, t in enumerate(texts):
        words, rest = ordinal.tokens(t)
        names = [*words, *{"\npre " + w[:4] for w in words}, *rest]
        score = sum(wide.weights[zlib.crc32(n.encode()) % (1 << ordinal.BITS)] for n in names)
        tails = [1 / (1 + np.exp(c - score)) for c in wide.thresholds]
        assert got[i].p_good == pytest.approx(tails[1], abs=1e-4) and got[i].expected_grade == pytest.approx(sum(tails), abs=2e-4) and got[i].kept == (got[i].p_good >= 0.5)


def test_stages_with_awkward_rows(spark, docs, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, names that the stages use inside, and no rows at all."""
    import corpus_pipeline

    clash = ["fp", "root", "uid", "lane", "cell", "node", "mark", "size", "keys", "key", "id", "slot", "start", "words", "page", "bits", "__row", "__page", "grade", "rated_id", "best"]
    rows = docs.withColumns({c: F.lit(c) for c in clash})
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, none, folder)
        assert empty.columns == none.columns and empty.isEmpty()
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == rows.columns and 0 < out.count()
        assert name == "mixing" or out.exceptAll(rows).isEmpty()
        assert out.where(" or ".join(f"{c} <> '{c}'" for c in clash)).isEmpty()
        rows = out
    encode = corpus_pipeline.STAGES[-1][1]
    assert encode(spark, rows, folder).count() == rows.count() and encode(spark, none, folder).isEmpty()
    assert rows.groupBy("text").count().where("count > 3").isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, folder)
        assert left.columns == docs.columns
    kept = {r.doc_id: r.text for r in left.collect()}
    sets = [_shingles(t) for t in kept.values()]
    assert len(set(kept.values())) == len(kept)
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= kept.keys() and max(Counter(r.doc_id for r in out).values()) <= 3
