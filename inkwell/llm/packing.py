"""Packing token pieces into sequences: linear grouping, few-size configurations, then best fit.

Large lengths are sorted, cut into groups of equal cardinality and rounded up to their
group's largest. Configurations of the few rounded sizes are optimised one after another,
each taken as often as its sizes last. The actual pieces then take the places of the
rounded ones, and pieces below the large ones go, longest first, where they leave least room.

The plan is made on counts per length: pieces of one length are alike, so its input has at
most ``capacity`` rows whatever the corpus holds, and sequences filled alike form one run.
Pieces find their places by their rank among those of their length, on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._text import small_batches, text_bytes, windows
from inkwell.llm._tokenizer import byte_bpe
from inkwell.session import materialize

CAPACITY = 2048
GROUPS = 192
SMALL_SHARE = 1 / 8  # lengths up to this share of the capacity are small
SHARD_ROWS = 200_000
END_ID = 0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length, ids_crc32 (and ids, if asked for).

    A text's ids end with id 0; NULL is empty. Texts over ``capacity`` ids are cut into pieces
    of that many; what is left over comes first. Other columns of ``docs`` are not read.
    Rows with equal ids are packed like any others.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = byte_bpe(tokenizer)
            data, bounds = text_bytes(batch.column(1))
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in windows(bounds):
                ids, counts = encoder.ids(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                with_end = np.full(len(ids) + j - i, END_ID, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(j - i), counts)] = ids
                yield rows(numbers[i:j], with_end, counts + 1)

    def rows(numbers, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n = -(-counts // capacity)
        doc = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = counts - (n - 1) * capacity
        start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[doc], capacity)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        at = (np.cumsum(counts) - counts)[doc] + start
        crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [pa.array(numbers[doc], pa.int64(), from_pandas=True), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:  # pieces of a document stand in order, so they lie end to end as the ids do
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


class Run:
    """Sequences filled alike: for each item its length and the rank its piece has in the run's first sequence."""

    __slots__ = ("bins", "items", "room")

    def __init__(self, bins: int, items: list[tuple[int, int]], room: int):
        self.bins, self.items, self.room = bins, items, room

    def split(self, bins: int) -> tuple[Run, Run]:
        rest = [(length, rank + bins) for length, rank in self.items]
        return Run(bins, self.items, self.room), Run(self.bins - bins, rest, self.room)


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[np.ndarray]:
    """Indices of descending ``lengths``, cut into at most ``groups`` groups of about equal cardinality.

    A length stays whole, so a frequent one is a group of its own and is not rounded."""
    if not len(lengths):
        return []
    share = counts.sum() / groups
    number = np.floor((np.cumsum(counts) - counts / 2) / share).astype(int)
    return [np.flatnonzero(number == g) for g in np.unique(number)]


def configuration(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[int]:
    """Indices (with repeats) of a configuration: the largest size left, and what fills its room best."""
    first = int(np.flatnonzero(left)[0])
    room = capacity - int(sizes[first])
    came = np.full(room + 1, -1, np.int64)  # the last size added on the way to a total
    came[0] = len(sizes)
    for i in np.flatnonzero(left):
        size = int(sizes[i])
        if size > room:
            continue
        for _ in range(min(int(left[i]) - (i == first), room // size)):
            reached = np.flatnonzero((came[size:] < 0) & (came[:-size] >= 0))
            if not len(reached):
                break
            came[reached + size] = i
    total, chosen = int(np.flatnonzero(came >= 0)[-1]), [first]
    while total:
        i = int(came[total])
        chosen.append(i)
        total -= int(sizes[i])
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold ``histogram[length]`` pieces of each length, each piece once.

    An empty histogram gives no runs. Lengths are from 1 to ``capacity``."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    large = lengths > capacity * SMALL_SHARE
    members = grouped(lengths[large], counts[large], groups)
    sizes = np.array([lengths[m[0]] for m in members], np.int64)
    left = np.array([counts[m].sum() for m in members], np.int64)
    # Each group's pieces, longest first: (length, rank of the first, how many).
    queues = [[[int(lengths[i]), 0, int(counts[i])] for i in m] for m in members]
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    while left.any():
        chosen, many = np.unique(configuration(sizes, left, capacity), return_counts=True)
        while (left[chosen] < many).any():  # a way through a total may reuse a size beyond its count
            short = left[chosen] < many
            many = np.where(short, left[chosen], many)
            chosen, many = chosen[many > 0], many[many > 0]
        times = int((left[chosen] // many).min())
        left[chosen] -= times * many
        slots = np.repeat(chosen, many)
        while times:
            # A sub-run ends where any of its places comes to another length.
            taken, step = [], times
            need: dict[int, int] = {}
            for g in slots:
                need[int(g)] = need.get(int(g), 0) + 1
            for g, k in need.items():
                step = min(step, max(1, queues[g][0][2] // k))
            for g, k in need.items():
                for _ in range(k):
                    taken += take(queues[g], step)
            if all(n == step for _, _, n in taken):
                runs = [Run(step, [(length, rank) for length, rank, _ in taken], 0)]
            else:  # the last pieces of one length and the first of the next: one sequence at a time
                runs = [Run(1, [(length, rank) for length, rank, _ in taken], 0)]
            for run in runs:
                run.room = capacity - sum(length for length, _ in run.items)
                by_room[run.room].append(run)
            times -= step
    for length, count in zip(lengths[~large].tolist(), counts[~large].tolist(), strict=True):
        best_fit(by_room, length, count, capacity)
    return [run for runs in by_room for run in runs]


def take(queue: list[list[int]], n: int) -> list[tuple[int, int, int]]:
    """``n`` pieces off the front of a queue, as (length, first rank, number) for each stretch of one length."""
    out = []
    while n:
        length, rank, count = queue[0]
        k = min(n, count)
        out.append((length, rank, k))
        if k == count:
            queue.pop(0)
        else:
            queue[0] = [length, rank + k, count - k]
        n -= k
    return out


def best_fit(by_room: list[list[Run]], length: int, count: int, capacity: int) -> None:
    """Put ``count`` pieces of one length where each leaves the least room; open sequences for the rest."""
    rank, room = 0, length
    while count and room <= capacity:
        if not by_room[room]:
            room += 1
            continue
        run = by_room[room].pop()
        if run.bins > count:
            run, rest = run.split(count)
            by_room[room].append(rest)
        run.items = [*run.items, (length, rank)]
        run.room -= length
        by_room[run.room].append(run)
        rank, count = rank + run.bins, count - run.bins
        if run.room >= length:
            room = run.room  # the same sequences now leave the least room
    each = capacity // length
    for bins, held in ((count // each, each), (1, count % each)):
        if bins and held:
            items = [(length, rank + i * bins) for i in range(held)]
            by_room[capacity - held * length].append(Run(bins, items, capacity - held * length))
            rank += bins * held


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, rank): each place's first sequence and offset."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, rank in run.items:
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += run.bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def assign(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to materialised pieces (columns doc_id, piece, length and more)."""
    histogram = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity, groups))
    shards = max(16, -(-sum(histogram.values()) // SHARD_ROWS))
    stride = 1 << 40
    keys = table["length"] * stride + table["rank"] if len(table["length"]) else np.zeros(0, np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        at = np.searchsorted(keys, length.to_numpy() * stride + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": table["sequence"][at] + rank.to_numpy() - table["rank"][at], "offset": table["offset"][at]})

    # Rank within a length in two levels: inside shards of bounded size, and the rows of the shards before.
    sharded = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    sizes = sharded.groupBy("length", "_shard").count()
    earlier = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("_rank", F.row_number().over(inside) - 1).join(before, ["length", "_shard"])
    return (
        ranked.withColumn("_place", place("length", F.col("_before") + F.col("_rank")))
        .select(*cut.columns, "_place.sequence_id", "_place.offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Pack all texts into few sequences of at most ``capacity`` tokens; one row per piece.

    See :func:`pieces` for NULL, empty and long texts; an empty table gives no rows, repeated
    documents are packed once per row."""
    cut = materialize(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces")
    return assign(cut, capacity, groups)
