"""Access, count and occurrence lookup over shard files against the ids themselves."""

from collections import Counter

from tidewell.llm import wavelet
from tidewell.llm.queries import vocabulary
from tidewell.llm.store import new_path


def test_lookups(spark):
    texts = [f"the cat {'sat ' * (i % 4)}on the mat {i}" for i in range(70)] + ["", None, "日本 the"]
    rows = [(i * 3 % 73, t) for i, t in enumerate(texts)] + [(None, "the end"), (6, "the the the")]
    path = new_path(spark, "shards")
    wavelet.write_token_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, vocabulary(), shard_tokens=120)
    encode = wavelet.library_encoder(vocabulary())
    ids = [(d, [*memoryview(encode(t or "")).cast("B").cast("I").tolist(), 2]) for d, t in rows]
    assert spark.read.parquet(path).count() > 4
    for token in (ids[0][1][0], ids[5][1][2], 2, 49_999, 10**6):
        got = Counter(tuple(r) for r in wavelet.find_token(spark, path, token).collect())
        assert got == Counter((d, i) for d, own in ids for i, t in enumerate(own) if t == token)
        counts = Counter(tuple(r) for r in wavelet.count_token(spark, path, token).collect())
        assert counts == Counter((d, own.count(token)) for d, own in ids if token in own)
    for at in (0, 4, 500):
        assert Counter(tuple(r) for r in wavelet.token_at(spark, path, at).collect()) == Counter((d, own[at]) for d, own in ids if len(own) > at)
