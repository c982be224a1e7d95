"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the tree's upper nodes; runs of turns between branches are one
node. Nodes are emitted once each, depth first, into one stream: a row has its text, its offset in the
stream, the position id of its first character within the conversation (the length of its ancestors), the
intervals of the stream it may attend to (its ancestors') and the spans under the loss mask. Lengths are in
code points; turns begin and end with control strings, so a tokenizer can be run per node.

A node's id is a digest of all turns up to its end, its path the ids from the root: sorting by path is depth
first order, at any size and without a task per tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, new_path, scratch

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>\n((?:[^\\<>]|\\.)*)</turn>\n", re.S)
TRAINED = "assistant"


def escape(text: str) -> str:
    """Backslash before each backslash and angle bracket: no text can hold a control string."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A turn in the template, and the span of its text if it is under the loss mask."""
    head, body = f"<turn {escape(role)}>\n", escape(text)
    return f"{head}{body}</turn>\n", (len(head), len(head) + len(body)) if role == TRAINED else None


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``format_turn`` made."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _grouped(conversations: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = F.col("conv_id").isNotNull()
    whole = conversations.where(named).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lone = conversations.where(~named).select("conv_id", F.array(turn).alias("turns"))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    return whole.unionByName(lone).withColumn("conv", conv)


def _prefixes(whole: DataFrame) -> DataFrame:
    """conv, depth, node: a digest of the turns up to each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, node = [], [], []
            for name, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                state = hashlib.sha256()
                for i, t in enumerate(turns.as_py()):
                    for x in (t["role"].encode(), t["text"].encode()):
                        state.update(len(x).to_bytes(8, "big") + x)
                    conv.append(name)
                    depth.append(i)
                    node.append(state.digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(depth, pa.int32()), pa.array(node, pa.binary())], names=["conv", "depth", "node"])

    return whole.select("conv", "turns").mapInArrow(run, "conv string, depth int, node binary")


_NODES = "path array<binary>, text string, position long, loss array<struct<start:int,stop:int>>"


def _own_nodes(marked: DataFrame) -> DataFrame:
    """Of each conversation the tree nodes that it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"path": [], "text": [], "position": [], "loss": []}
            for conv, turns, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                turns, marks = turns.as_py(), marks.as_py()
                path, text, loss, position = [], "", [], 0
                for i, (t, m) in enumerate(zip(turns, marks, strict=True)):
                    piece, span = format_turn(t["role"], t["text"])
                    if span:
                        loss.append({"start": len(text) + span[0], "stop": len(text) + span[1]})
                    text += piece
                    if i + 1 < len(marks) and marks[i + 1]["shared"] == m["shared"]:
                        continue  # every conversation that comes here goes on to the next turn
                    path = [*path, m["node"]]
                    if m["owner"] == conv:
                        for k, v in (("path", path), ("text", text), ("position", position), ("loss", loss)):
                            out[k].append(v)
                    position += len(text)
                    text, loss = "", []
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("path", pa.list_(pa.binary())), ("text", pa.string()), ("position", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
    return marked.select("conv", "turns", "marks").mapInArrow(run, _NODES)


def format_conversations(conversations: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(stream, index) of the conversations, both as written tables.

    stream: node, start, stop, position, text, attend (intervals of the ancestors, root first), loss (spans
    within the text); in stream order by start. index: conv_id, node (where the conversation ends).
    Turns are ordered by turn, then role and text, so ties and repeated rows have a defined order; a null
    turn comes first, a null role or text is empty, a row without conv_id is a conversation of its own. An empty
    table gives two empty tables. Further columns are ignored.
    """
    spark = conversations.sparkSession
    path = path or new_path(spark, "chat")
    with scratch(spark):
        _write(conversations, path)
    return spark.read.parquet(f"{path}/stream"), spark.read.parquet(f"{path}/index")


def _write(conversations: DataFrame, path: str) -> None:
    whole = materialize(_grouped(conversations), "turns", compression="zstd")
    steps = materialize(_prefixes(whole), "prefixes")
    nodes = steps.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.min("conv").alias("owner"))
    marks = steps.join(nodes, "node").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "shared", "owner"))).alias("marks"))
    marks = materialize(marks, "marks")
    order = _own_nodes(whole.join(marks, "conv")).repartitionByRange("path").sortWithinPartitions("path")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts = []
            for text in batch.column(1).to_pylist():
                starts.append(at)
                at += len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(starts, pa.int64())], names=[*batch.schema.names, "part", "local"])

    laid = materialize(order.mapInArrow(lay_out, _NODES + ", part int, local long"), "laid", compression="zstd")
    laid = laid.withColumn("node", F.element_at("path", -1)).withColumn("chars", F.char_length("text").cast("long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = laid.groupBy("part").agg(F.sum("chars").alias("chars")).select("part", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("offset"))
    placed = laid.join(parts, "part").withColumn("start", F.col("offset") + F.col("local")).withColumn("stop", F.col("start") + F.col("chars"))
    spans = placed.select(F.col("node").alias("ancestor"), "start", "stop")
    up = placed.select("node", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("level", "ancestor")).join(spans, "ancestor")
    up = up.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("level", "start", "stop"))).alias("up"))
    attend = F.transform(F.coalesce("up", F.array().cast("array<struct<level:int,start:bigint,stop:bigint>>")), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    stream = placed.join(up, "node", "left").select("node", "start", "stop", "position", "text", attend.alias("attend"), "loss")
    stream.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/stream")
    ends = marks.select("conv", F.element_at("marks", -1)["node"].alias("node"))
    whole.select("conv", "conv_id").join(ends, "conv").select("conv_id", "node").write.parquet(f"{path}/index")


def read_conversations(stream: DataFrame, index: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans within it), put together from the attention intervals."""
    index = index.withColumn("at_index", F.monotonically_increasing_id())
    index = materialize(index, "index")  # so that the numbers stay
    ends = index.join(stream.select("node", "attend", "start", "stop"), "node")
    seen = ends.select("at_index", "conv_id", F.posexplode(F.concat("attend", F.array(F.struct("start", "stop")))).alias("level", "at")).select("at_index", "conv_id", "level", "at.start")
    pieces = seen.join(stream.select("start", "position", "text", "loss"), "start")
    whole = pieces.groupBy("at_index", "conv_id").agg(F.sort_array(F.collect_list(F.struct("level", "position", "text", "loss"))).alias("pieces"))
    spans = F.flatten(F.transform("pieces", lambda p: F.transform(p["loss"], lambda s: F.struct((s["start"] + p["position"]).alias("start"), (s["stop"] + p["position"]).alias("stop")))))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss"))


def conversation_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of conversations read back."""
    kind = dict(read.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(formatted)
                trained = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return read.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts hold what a template must escape."""
    text = r"\### Assistant: </turn> ok"
    kind = {k: v for k, v in conversations.dtypes if k in ("conv_id", "turn")}
    rows = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = rows.select(*(F.col(k).cast(kind.get(k, "string")).alias(k) for k in ("conv_id", "turn", "role", "text")))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
