"""Chat formatting by quotation linking.

A message is parsed into its own words and nested quotes (lines that start with one or more
``>``). Quoted passages are normalised and hashed whole, by paragraph and by line, and joined to the
messages whose own words hash alike: the latest earlier one of the same conversation, or
else the first anywhere that stands before it. What a message quotes least deeply is what it replies to;
without a quote it replies to the message before it. Conversations come out in reply order, without quotes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.jaccard_join import flattened
from inkwell.session import materialize

ELSEWHERE = 12  # characters of a whole quoted passage from which it is looked for in other conversations
QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"^[^\n]*\b(?:wrote|schrieb|écrit|escribió) ?:[ \t]*$", re.I)


def normalised(text: str) -> str:
    """Small letters, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split())


def units(text: str) -> dict[str, int]:
    """Digest and length of the whole passage, its paragraphs and its lines; nothing for blank ones."""
    parts = {normalised(p) for p in [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]} - {""}
    return {hashlib.sha256(p.encode()).hexdigest()[:32]: len(p) for p in parts}


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own words, and its quoted passages as (depth, text) in order.

    A passage is a run of lines of one depth. A line that announces a quote ("... wrote:") right
    before a deeper passage belongs to neither side."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        m = QUOTE.match(line)
        depth = m[1].count(">") if m else 0
        line = line[m.end() :] if m else line
        if not runs or runs[-1][0] != depth:
            runs.append((depth, []))
        runs[-1][1].append(line)
    for (depth, lines), (deeper, _) in zip(runs, runs[1:]):
        if deeper > depth and lines and ATTRIBUTION.match(lines[-1]):
            lines.pop()
    own = [line for depth, lines in runs if depth == 0 for line in lines]
    return "\n".join(own).strip(), [(depth, "\n".join(lines)) for depth, lines in runs if depth and normalised(" ".join(lines))]


PARSED = "conv_id long, turn long, role string, body string, n_quotes int, max_depth int, own array<struct<digest:string,size:int>>, quotes array<struct<passage:int,depth:int,digest:string,size:int,whole:boolean>>"


def parsed(messages: DataFrame) -> DataFrame:
    """Every message with its own words and the digests of what it says and quotes."""

    def parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_type = pa.list_(pa.struct([("digest", pa.string()), ("size", pa.int32())]))
        quote_type = pa.list_(pa.struct([("passage", pa.int32()), ("depth", pa.int32()), ("digest", pa.string()), ("size", pa.int32()), ("whole", pa.bool_())]))
        for batch in batches:
            bodies, counts, depths, own, quotes = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                body, passages = parse(text or "")
                bodies.append(body)
                counts.append(len(passages))
                depths.append(max((d for d, _ in passages), default=0))
                own.append([{"digest": d, "size": n} for d, n in units(body).items()])
                quotes.append([{"passage": i, "depth": depth, "digest": d, "size": n, "whole": n == len(normalised(p))} for i, (depth, p) in enumerate(passages) for d, n in units(p).items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(counts, pa.int32()), pa.array(depths, pa.int32()), pa.array(own, own_type), pa.array(quotes, quote_type)],
                ["conv_id", "turn", "role", "body", "n_quotes", "max_depth", "own", "quotes"],
            )

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(parse_all, PARSED)


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_conv, reply_turn) for messages that quote an earlier one."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = known.select("conv_id", "turn", F.explode("own").alias("_u")).select("conv_id", "turn", "_u.digest")
    quoted = known.where("n_quotes > 0").select("conv_id", "turn", F.explode("quotes").alias("_u")).select("conv_id", "turn", "_u.*")
    # As-of within the conversation: what was said and what is quoted lie in one order of turns. Only quoted digests
    # are laid out, and one row per conversation, digest and turn.
    asked = quoted.select("conv_id", "digest").distinct()
    events = said.join(asked, ["conv_id", "digest"], "left_semi").distinct().select("conv_id", "digest", "turn", F.col("turn").alias("said"))
    points = quoted.select("conv_id", "digest", "turn", F.lit(None).cast("long").alias("said")).distinct()
    before = Window.partitionBy("conv_id", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.unionByName(points).withColumn("_near", F.max("said").over(before)).where("said IS NULL").select("conv_id", "digest", "turn", "_near")
    # Elsewhere, and only for whole passages that are no commonplace: the first message of all that says it.
    first = said.join(quoted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("conv_id", "turn")).alias("_first"))
    here = F.struct(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"))
    found = (
        quoted.join(near, ["conv_id", "digest", "turn"], "left")
        .join(first, "digest", "left")
        .withColumn("_to", F.when(F.col("_near").isNotNull(), F.struct("conv_id", F.col("_near").alias("turn"))).when(F.col("whole") & (F.col("size") >= ELSEWHERE) & (F.col("_first") < here), F.col("_first")))
        .where("_to IS NOT NULL")
    )
    # Per passage the message with most matched characters; of passages the least deep, then the best matched.
    votes = found.groupBy("conv_id", "turn", "passage", "depth", "_to").agg(F.sum("size").alias("matched"), (F.col("_to.conv_id") == F.col("conv_id")).alias("inside"))
    rank = F.struct(-F.col("depth"), F.col("inside"), F.col("matched"), F.col("_to.turn"), -F.col("_to.conv_id"))
    best = votes.groupBy("conv_id", "turn").agg(F.max_by("_to", rank).alias("_to"))
    return best.select("conv_id", "turn", F.col("_to.conv_id").alias("reply_conv"), F.col("_to.turn").alias("reply_turn"))


def in_order(messages: DataFrame, parts: int) -> DataFrame:
    """Add position (from 1) and previous turn within a conversation, also one that holds much of the table.

    Rows are laid out by ranges of (conv_id, turn); places inside a range and the ranges before are added up."""
    laid = materialize(messages.repartitionByRange(parts, "conv_id", "turn").withColumn("_range", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_range", "conv_id").orderBy("turn", "body", "role")
    ranges = laid.groupBy("conv_id", "_range").agg(F.count("*").alias("_rows"), F.max("turn").alias("_last"))
    earlier = Window.partitionBy("conv_id").orderBy("_range")
    ranges = ranges.select(
        "conv_id", "_range", F.coalesce(F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(earlier).alias("_end")
    )
    placed = laid.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag("turn").over(inside)).join(ranges, ["conv_id", "_range"])
    return placed.withColumn("position", F.col("_before") + F.col("_n")).withColumn("_previous", F.coalesce("_lag", "_end"))


def with_heads(linked: DataFrame) -> DataFrame:
    """Add ``_head``, the turn of the last message up to each one that is not linked by order; in two levels, as above."""
    mark = F.when(F.coalesce(F.col("linked_by") != "order", F.lit(True)), F.col("turn"))
    inside = Window.partitionBy("_range", "conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = linked.groupBy("conv_id", "_range").agg(F.max_by("turn", F.when(mark.isNotNull(), F.col("position"))).alias("_last"))
    carried = ranges.select("conv_id", "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    placed = linked.withColumn("_own", F.last(mark, ignorenulls=True).over(inside)).join(carried, ["conv_id", "_range"])
    return placed.withColumn("_head", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_range")


def conversations(messages: DataFrame, rows_per_part: int = 500_000) -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quotes, max_depth, reply_conv, reply_turn, linked_by, root_conv,
    root_turn, position.

    ``messages`` has conv_id, turn, role, text. ``linked_by`` is 'quote', 'order' or NULL for roots. A NULL text is
    empty. A quoted line, paragraph or passage is looked for earlier in its conversation, the last message that says it; only a whole
    passage of at least ``ELSEWHERE`` characters is looked for elsewhere. Messages without conv_id or turn are roots of their own, with NULL links and position. Messages
    that repeat a turn reply to the turn before it. Threads follow replies, across conversations where a quote leads there;
    in a thread (root), ordering by conversation and position puts every reply behind what it answers."""
    rows = materialize(parsed(messages), "parsed")
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").drop("own", "quotes")
    parts = max(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_part))
    ordered = in_order(known, parts)
    # Of rows that repeat a turn, all take the turn before theirs.
    earlier = F.when(F.col("_previous") < F.col("turn"), F.col("_previous"))
    same = F.min(earlier).over(Window.partitionBy("conv_id", "turn"))
    linked = ordered.withColumn("_previous", same).join(quote_links(rows), ["conv_id", "turn"], "left")
    linked = linked.withColumn("linked_by", F.when(F.col("reply_turn").isNotNull(), "quote").when(F.col("_previous").isNotNull(), "order"))
    linked = materialize(
        linked.withColumn("reply_conv", F.when(F.col("linked_by") == "order", F.col("conv_id")).otherwise(F.col("reply_conv")))
        .withColumn("reply_turn", F.coalesce("reply_turn", "_previous"))
        .select("conv_id", "turn", "role", "body", "n_quotes", "max_depth", "reply_conv", "reply_turn", "linked_by", "position", "_range"),
        "linked",
    )
    # Messages that follow in order belong to the last message before them that does not: their head. Only heads form trees.
    linked = materialize(with_heads(linked), "headed")
    heads = linked.select("conv_id", "turn", "_head").distinct()
    to = heads.select(F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"), F.struct("conv_id", F.col("_head").alias("turn")).alias("parent"))
    answers = linked.where("linked_by = 'quote'").join(to, ["reply_conv", "reply_turn"]).select(F.struct("conv_id", "turn").alias("node"), "parent").distinct()
    roots = flattened(answers).select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("_head"), F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"))
    columns = ["conv_id", "turn", "role", "body", "n_quotes", "max_depth", "reply_conv", "reply_turn", "linked_by", "root_conv", "root_turn", "position"]
    threads = linked.join(roots, ["conv_id", "_head"], "left").withColumn("root_conv", F.coalesce("root_conv", "conv_id")).withColumn("root_turn", F.coalesce("root_turn", "_head"))
    nothing = F.lit(None).cast("long")
    alone = rows.where("conv_id IS NULL OR turn IS NULL").select(
        "conv_id", "turn", "role", "body", "n_quotes", "max_depth", nothing.alias("reply_conv"), nothing.alias("reply_turn"), F.lit(None).cast("string").alias("linked_by"),
        F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), nothing.alias("position"),
    )
    return threads.select(columns).unionByName(alone)
