"""The registered queries of this subpackage, each over its whole table, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import crc32_sql
from . import bpe, chat, exact, kdshard, merkle, mixing, ordinal, outliers, rtree, secrets, simhash, suffix, wavelet
from .store import new_path


def vocabulary() -> str:
    """The vocabulary file of the production runs; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, _table(spark, sf_dir, "conversations"))
    return chat.conversation_digests(chat.read_conversations(*chat.format_conversations(rows)))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.kd_shards(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    wavelet.write_token_shards(_table(spark, sf_dir, "documents"), path, vocabulary())
    return wavelet.read_token_shards(spark, path)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal.grade_documents(docs, ordinal.train(docs, _table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    claim = merkle.tampered_digest({"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return merkle.check_proofs(merkle.write_manifest(_table(spark, sf_dir, "documents"), new_path(spark, "manifest"), claim=claim))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_chat_format, op3_kd_shards, op4_bpe, op5_wavelet_shards, op6_suffix_dedup, op7_mixing, op8_robust_outliers, op9_exact_dedup, op10_ordinal_quality, op11_hard_negatives, op12_secrets, op13_merkle)
}

_ESCAPES = "(length({0}) - length(replace({0}, '\\', '')) + length({0}) - length(replace({0}, '<', '')) + length({0}) - length(replace({0}, '>', '')))"

def _leaf_sql(n_chars: str) -> str:
    said = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(map(said, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_TREE_SQL = """{0} as (select tree, 0 as level, pos, node, n from {1}
        union all select tree, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (n + 1) // 2 from {0} where n > 1 group by tree, level, pos // 2, n)"""

ORACLES: dict[str, str] = {
    "op2_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
            union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(16 + length(role) + {_ESCAPES.format("role")} + length(text) + {_ESCAPES.format("text")}) as bigint) as formatted_chars
        from turns group by conv_id""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op11_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
        n as (select p.*, other as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank
            from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op13_merkle": f"""
        with recursive leaves as (select coalesce('=' || lang, '-') as tree, row_number() over (partition by lang order by doc_id) - 1 as pos, doc_id, {_leaf_sql("n_chars")} as node,
            count(*) over (partition by lang) as n, case when {crc32_sql("cast(doc_id as varchar)")} % 7 = 0 then {_leaf_sql("(n_chars + 1)")} else {_leaf_sql("n_chars")} end as claim from documents),
        {_TREE_SQL.format("own", "leaves")},
        roots as (select '' as tree, row_number() over (order by tree) - 1 as pos, node, count(*) over () as n, tree as name from own where n = 1),
        {_TREE_SQL.format("whole", "roots")},
        heights as (select tree, max(level) as height from own group by tree),
        ways as (select l.doc_id, l.tree, 0 as part, unnest(range(0, h.height)) as level, l.pos from leaves l join heights h using (tree)
            union all select l.doc_id, '', 1, unnest(range(0, (select max(level) from whole))), r.pos from leaves l join roots r on r.name = l.tree),
        steps as (select w.doc_id, w.part, w.level, s.node as sibling, case when s.node is null then 'N' when (w.pos >> w.level) % 2 = 1 then 'L' else 'R' end as side
            from ways w left join (select 0 as part, * from own union all select 1, * from whole) s on s.part = w.part and s.tree = w.tree and s.level = w.level and s.pos = xor(w.pos >> w.level, 1)),
        proofs as (select doc_id, list(side || coalesce(sibling, '') order by part, level) as steps, sha256(coalesce(string_agg(sibling, '' order by part, level), '')) as proof_sha256 from steps group by doc_id),
        folded as (select l.doc_id, l.node as leaf, r.node as subroot, (select node from whole where n = 1) as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
            list_reduce(list_prepend(l.claim, coalesce(p.steps, [])), lambda x, s: sha256(case s[1] when 'L' then s[2:] || x when 'R' then x || s[2:] else x end)) as folded_root
            from leaves l join roots r on r.name = l.tree left join proofs p using (doc_id))
        select *, folded_root = root as verified from folded""",
}
