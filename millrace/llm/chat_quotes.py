"""Chat formatting by quotation linking: messages ordered by what they reply to, with the quotes taken out.

A line that begins with > marks is quoted at the level of their number; runs of lines of one level are passages.  Passages are
normalised (marks off, white space and case folded, attribution lines dropped) and hashed, whole and line by line; hashes
of quoted passages are joined to hashes of what other messages say themselves.  A message replies to the message that
most of its first-level quotes come from (of several with as many, the latest); reply chains give every message its thread's
root, its depth and its position in reply order: a message stands before its replies, replies stand in order of (conv_id,
turn), and all that replies to one stands before the next.

Plan.  Texts are parsed once for hashes, which are written, and once to take out the quotes.  Originals are reduced to the
first message of each (hash, conversation) and of each hash before the join, so the side that quotes look up has one row a
key: a passage that everybody quotes is a skewed join of many rows with one, which adaptive execution splits.  Roots, depths,
sizes of threads below a message and positions are sums along reply chains, found by pointer jumping over linked messages
only, in as many rounds as the logarithm of the depth and a few numbers a message; sums over the replies to one message run
along a range-partitioned order, so that a message with very many replies is not one task's.

Defined results.  A message can only quote an earlier turn of its own conversation, or else the first message elsewhere
that says the passage, if that one's (conv_id, turn) is smaller and the passage has LEAST_CHARS characters or more.  Null text is empty; null conv_id or turn: the message
is its own root and nobody's parent.  Rows with one (conv_id, turn) share links and each return a row.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.near_dedup import checkpointed

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^(?:on .{1,200} wrote|.{1,120} (?:schrieb|a écrit|escribió)[^:]{0,60}|[\w .@<>-]{1,80} (?:said|wrote)):$", re.I)
#: Quoted text shorter than this, once normalised, is no evidence of a message of another conversation.
LEAST_CHARS = 12


def quoted_passages(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of one quote level, as (level, lines without marks), in order."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        rest = line[found.end() :] if found else line
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return out


def normalised(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def evidence(lines: list[str], least: int = 1) -> list[int]:
    """Hashes of a passage: the whole, its paragraphs and its lines, those of `least` characters or more."""
    paragraphs, block = [], []
    for line in [*lines, ""]:
        if line.strip():
            block.append(line)
        elif block:
            paragraphs.append(normalised(block))
            block = []
    texts = {normalised(lines), *paragraphs, *(normalised([x]) for x in lines)}
    return sorted(hash_of(t) for t in texts if len(t) >= least and not ATTRIBUTION.match(t))


def without_quotes(passages: list[tuple[int, list[str]]]) -> str:
    """The message's own lines; an attribution line goes with the quote below it."""
    kept: list[str] = []
    for i, (level, lines) in enumerate(passages):
        if level:
            continue
        lines = list(lines)
        if i + 1 < len(passages):
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and ATTRIBUTION.match(normalised([lines[-1]])):
                lines.pop()
        kept += lines
    return "\n".join(kept).strip("\n")


def link_replies(messages: DataFrame) -> DataFrame:
    """messages with own_text, n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn, depth and path."""
    keyed = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def parse(batches):
        for b in batches:
            own, far, quotes = [], [], []
            for text in b.column(2).to_pylist():
                passages = quoted_passages(text)
                own.append(sorted({h for level, lines in passages if not level for h in evidence(lines)}))
                far.append(sorted({h for level, lines in passages if not level for h in evidence(lines, LEAST_CHARS)}))
                quotes.append([{"level": level, "passage": i, "hash": int(np.uint64(h).view(np.int64))} for i, (level, lines) in enumerate(passages) if level for h in evidence(lines)])
            own, far = ([np.array(x, dtype=np.uint64).view(np.int64) for x in said] for said in (own, far))
            kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.int64())), pa.array(quotes, kind)], names=["conv_id", "turn", "own", "far", "quotes"])

    placed = keyed.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    parsed = checkpointed(placed.mapInArrow(parse, "conv_id long, turn long, own array<long>, far array<long>, quotes array<struct<level:int,passage:int,hash:bigint>>"))
    quotes = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.passage", "q.hash").distinct()
    edges = None
    if not quotes.isEmpty():
        said = parsed.select("conv_id", "turn", F.explode("own").alias("hash"))
        here = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"))
        first = parsed.select("conv_id", "turn", F.explode("far").alias("hash")).groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
        found = quotes.join(here, ["hash", "conv_id"], "left").join(first, "hash", "left")
        elsewhere = (F.col("first.conv_id") != F.col("conv_id")) & (F.col("first") < F.struct("conv_id", "turn"))
        source = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(elsewhere, F.col("first"))
        linked = found.withColumn("source", source).where("source is not null")
        votes = linked.where("level = 1").groupBy("conv_id", "turn", "source").agg(F.count("*").alias("n"))
        best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source")).alias("best"))
        counts = linked.groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_linked"))
        edges = checkpointed(counts.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_linked", F.col("best.source").alias("parent")))
    threads = reply_threads(edges) if edges is not None else None

    def rewrite(batches):
        for b in batches:
            passages = [quoted_passages(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([without_quotes(p) for p in passages], pa.string()), pa.array([sum(level > 0 for level, _ in p) for p in passages], pa.int64())], names=["conv_id", "turn", "role", "own_text", "n_quotes"])

    out = keyed.mapInArrow(rewrite, "conv_id long, turn long, role string, own_text string, n_quotes long")
    if threads is not None:
        out = out.join(threads, ["conv_id", "turn"], "left")
    else:
        none = F.lit(None).cast("long")
        out = out.withColumns({c: none for c in ("n_linked", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "position")})
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "own_text", "n_quotes", F.coalesce("n_linked", zero).alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("root_conv", "conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"),
    )


def reply_threads(edges: DataFrame) -> DataFrame:
    """n_linked, parent, root, depth and position (from 0 at the root) of every message of edges."""
    point = lambda c: F.struct(F.col(f"{c}.conv_id").alias("conv_id"), F.col(f"{c}.turn").alias("turn"))
    linked = edges.where("parent is not null").select(F.struct("conv_id", "turn").alias("node"), point("parent").alias("up"))
    nodes = checkpointed(linked.unionByName(linked.select(F.col("up").alias("node")).distinct().join(linked.select("node"), "node", "left_anti").withColumn("up", F.lit(None).cast("struct<conv_id:bigint,turn:bigint>"))))
    sized = subtree_sizes(nodes)
    steps = reply_offsets(sized).unionByName(sized.where("up is null").select("node", "up", F.lit(0).cast("long").alias("step")))
    state = checkpointed(steps.select("node", F.coalesce("up", "node").alias("root"), "up", F.col("step").alias("position"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("root").alias("r"), F.col("up").alias("u"), F.col("position").alias("p"), F.col("depth").alias("d"))
        zero = F.lit(0).cast("long")
        jumped = state.join(above, "up", "left")
        state = checkpointed(jumped.select("node", F.coalesce("r", "root").alias("root"), F.col("u").alias("up"), (F.col("position") + F.coalesce("p", zero)).alias("position"), (F.col("depth") + F.coalesce("d", zero)).alias("depth")))
    found = state.select("node.conv_id", "node.turn", F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth", "position")
    return found.join(edges.select("conv_id", "turn", "n_linked", F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn")), ["conv_id", "turn"], "full")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """nodes (node, up) with size: messages at and below each, by doubling the distance that is counted."""
    state = nodes.select("node", "up", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size"))
    while True:
        below = state.where("jump is not null").groupBy("jump").agg(F.sum("size").alias("more"))
        far = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        grown = state.join(below.withColumnRenamed("jump", "node"), "node", "left").join(far, "jump", "left")
        state = checkpointed(grown.select("node", "up", F.col("next").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0).cast("long"))).alias("size")))
        if state.where("jump is not null").isEmpty():
            return state.select("node", "up", "size")


def reply_offsets(sized: DataFrame) -> DataFrame:
    """node, up and step of every reply: 1 and the sizes of the earlier replies to the same message.

    Running sums over the order of (up, node), with what is open at the end of each partition handed on by the driver.
    """
    flat = sized.where("up is not null").select(F.col("up.conv_id").alias("uc"), F.col("up.turn").alias("ut"), F.col("node.conv_id").alias("c"), F.col("node.turn").alias("t"), "size")
    dealt = flat.repartitionByRange("uc", "ut", "c", "t").sortWithinPartitions("uc", "ut", "c", "t")
    spread = checkpointed(dealt.withColumn("part", F.spark_partition_id().cast("long")))

    def ends(batches):
        last, total, whole, part = None, 0, True, None
        for b in batches:
            for uc, ut, size, at in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if (uc, ut) != last:
                    whole, last, total = last is None, (uc, ut), 0
                total, part = total + size, at
        if last:
            yield pa.RecordBatch.from_pylist([{"part": part, "uc": last[0], "ut": last[1], "total": total, "whole": whole}])

    # one row a partition: its last message that is replied to, the sizes there, and whether that is all the partition has
    carried, open_sum = {}, (None, 0)
    for r in sorted(spread.mapInArrow(ends, "part long, uc long, ut long, total long, whole boolean").collect(), key=lambda r: r.part):
        carried[r.part] = open_sum
        open_sum = ((r.uc, r.ut), r.total + (open_sum[1] if r.whole and open_sum[0] == (r.uc, r.ut) else 0))

    def steps(batches):
        last, total = None, None
        for b in batches:
            out = []
            for uc, ut, size, part in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if total is None:
                    last, total = carried[part]
                if (uc, ut) != last:
                    last, total = (uc, ut), 0
                out.append(total + 1)
                total += size
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out, pa.int64())], names=["uc", "ut", "c", "t", "step"])

    named = lambda c, t: F.struct(F.col(c).alias("conv_id"), F.col(t).alias("turn"))
    return spread.mapInArrow(steps, "uc long, ut long, c long, t long, step long").select(named("c", "t").alias("node"), named("uc", "ut").alias("up"), "step")
