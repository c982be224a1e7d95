"""Secret scans: strong findings by pattern, and weak parts of credentials that are reported only where complementary parts co-occur.

A credential has an identifier (access key, user name, mail address), a secret and an endpoint. Strong findings (``BASE``) stand
alone. A weak part (``WEAK``) is reported if, within ``reach`` code points of the same text, there is a strong part of a role
that complements its own, or parts of both other roles; an endpoint needs an identifier and a secret, one of them strong.

The interval join: every part lies in a bin of ``reach + 1`` code points of its text; a bin keeps only the least and the greatest
start of each kind of part. A weak part is joined with its own bin and the two beside it, which settles the distances exactly, so
no pair of parts is ever made, however many a text has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

# The patterns of the findings, in the order in which kinds are listed.
BASE: dict[str, str] = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: What a text must contain for the pattern to be tried; hex runs have no such word.
_HINTS = {"assign": ("password", "passwd", "secret", "token", "api"), "access": ("akia",)}
#: One pattern, so that weak parts don't overlap: endpoint, named identifier, mail address, opaque secret.
WEAK = (
    r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,11}://[^\x20\x09-\x0D"'<>]{1,512}"""
    r"""|(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])(?::[0-9]{1,5})?"""
    r"""|(?<![A-Za-z0-9_])(?i:user|username|login|client_?id|account|access_?key_?id)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9+/_.@=-]{2,128}"""
    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}"""
    r"""|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,512}+={0,2}+(?![A-Za-z0-9+/_=-])"""
)
#: The kinds in the order in which spans with one start are listed.
KINDS = [*BASE, "identifier", "opaque", "endpoint"]
ASSIGN, ACCESS, HEX, IDENTIFIER, OPAQUE, ENDPOINT = range(6)
REACH = 200


def _cut(text: Column, pattern: str, tried: Column) -> Column:
    """Of each match in order: (i, gap: code points since the match before, hit: the match)."""
    kind = "array<struct<i: int, gap: int, hit: string>>"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda h, g: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    found = F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["gap"].alias("gap"), p["hit"].alias("hit")))
    return F.when(tried, F.filter(found, lambda x: x["hit"].isNotNull()).cast(kind)).otherwise(F.array().cast(kind))


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id and, by group of patterns, the matches of every row of ``docs``; no text. Every pattern cuts the text by itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    hinted = {k: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)) for k, words in _HINTS.items()}
    hinted["access"] = F.contains(text, F.lit("AKIA"))
    tried = {k: hinted.get(k, F.rlike(text, F.lit(p))) for k, p in {**BASE, "weak": WEAK}.items()}
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        *(_cut(text, p, tried[k]).alias(k) for k, p in {**BASE, "weak": WEAK}.items()),
    )


def _spans(matches: DataFrame) -> DataFrame:
    """row, kind, start, end of the findings that hold, strong and weak."""
    of = lambda n, name: F.transform(name, lambda x: F.struct(F.lit(n).alias("pattern"), x["i"].alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit")))
    group = F.concat(*(of(n, name) for n, name in enumerate([*BASE, "weak"])))
    rows = matches.select("row", F.inline(group))
    # Places are sums of lengths along one text.
    upto = Window.partitionBy("row", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("hit")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length(hit)).over(upto)).withColumn("start", F.col("end") - F.length(hit))
    has = lambda p: F.rlike(hit, F.lit(p))
    opaque = has("[0-9]") & has("[a-z]") & has("[A-Z]")
    weak = F.when(has(r"^[a-z][a-z0-9+.-]*://") | has(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$"), ENDPOINT).when(has("@") | has(r"^[A-Za-z_]+[\"']?\x20*[:=]"), IDENTIFIER).when(opaque, OPAQUE)
    value = F.regexp_extract(hit, BASE["assign"], 2)
    kind = F.when(F.col("pattern") == len(BASE), weak).when((F.col("pattern") == ASSIGN) & (F.length(value) < 6), None).otherwise(F.col("pattern"))
    return placed.select("row", kind.alias("kind"), "start", "end").where("kind is not null")


def _apart(spans: DataFrame) -> DataFrame:
    """``spans`` without weak ones that overlap a strong one, which says the same already."""
    strong = F.col("kind") < IDENTIFIER
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(strong, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(strong, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumns({"_before": before, "_after": after})
    clash = (F.col("_before") > F.col("start")) | (F.col("_after") < F.col("end"))
    return marked.where(strong | ~F.coalesce(clash, F.lit(False))).drop("_before", "_after")


#: The parts that bins keep apart: strong identifiers and secrets, weak ones, endpoints.
_PARTS = {"strong_id": [ACCESS], "strong_secret": [ASSIGN, HEX], "weak_id": [IDENTIFIER], "weak_secret": [OPAQUE], "endpoint": [ENDPOINT]}


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """row, kind, start, end of the weak spans that complementary parts within ``reach`` make worth reporting."""
    at_bin = F.floor(F.col("start") / (reach + 1))
    ends = [f(F.when(F.col("kind").isin(kinds), F.col("start"))).alias(f"{n}_{p}") for p, kinds in _PARTS.items() for f, n in ((F.min, "least"), (F.max, "most"))]
    bins = spans.groupBy("row", at_bin.alias("bin")).agg(*ends)
    weak = spans.where(F.col("kind") >= IDENTIFIER).withColumn("home", at_bin)
    seen = weak.withColumn("bin", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))).join(bins, ["row", "bin"])
    near = lambda p: F.coalesce(F.when(F.col("bin") < F.col("home"), F.col(f"most_{p}") >= F.col("start") - reach).when(F.col("bin") > F.col("home"), F.col(f"least_{p}") <= F.col("start") + reach).otherwise(F.col(f"least_{p}").isNotNull()), F.lit(False))
    found = seen.groupBy("row", "kind", "start", "end").agg(*(F.bool_or(near(p)).alias(p) for p in _PARTS))
    strong_id, strong_secret, weak_id, weak_secret, endpoint = (F.col(p) for p in _PARTS)
    some_id, some_secret = strong_id | weak_id, strong_secret | weak_secret
    rules = {IDENTIFIER: strong_secret | (weak_secret & endpoint), OPAQUE: strong_id | (weak_id & endpoint), ENDPOINT: (strong_id & some_secret) | (some_id & strong_secret)}
    return found.where(reduce(lambda a, b: a | b, ((F.col("kind") == k) & rule for k, rule in rules.items()))).select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end) and base, those of the strong kinds alone.

    Places are in code points of the whole text, ends exclusive, in order of start and kind. A null or empty text has no
    spans; a row without identifier and repeated rows are rows of their own; no rows give none; other columns are ignored.
    """
    matches = materialize(_matches(docs, id_col, text_col), "matches")
    spans = materialize(_apart(_spans(matches)), "spans")
    every = spans.where(F.col("kind") < IDENTIFIER).unionByName(_linked(spans, reach))
    # The spans of one text, which was one row before.
    of_row = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    joined = matches.select("row", "doc_id").join(of_row, "row", "left")
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    named = lambda xs: F.coalesce(F.transform(xs, lambda s: F.struct(F.get(F.array(*map(F.lit, KINDS)), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), none)
    strong = F.filter("found", lambda s: s["kind"] < IDENTIFIER)
    return joined.select("doc_id", named(F.col("found")).alias("spans"), named(strong).alias("base"))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
