"""Exact top-k by inner product, without random access.

Per dimension a block of candidates is a list sorted by value, as distances from the list's median. Every query reads each
list from both ends towards the middle, as far as what a component there can add to its score, |q| times the distance, exceeds
a threshold that all lists share; then the threshold is lowered. So the lists advance in proportion to what they can
still contribute. What has been read of a candidate is summed and counted; each of its unread components adds at most
the threshold, and takes away at most that, which bounds the score from below and above.

A query stops when the candidates outside its k best lower bounds that could still pass them are so few that resolving
their scores costs less than reading on; only survivors' scores are ever resolved. Blocks are bounded in candidates and
queries. Each (cell of candidates, chunk of queries) is one group; the k best per group are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 32_768
CHUNK_ROWS = 2_048
FIRST, LOWER = 8, 1.6  # the first threshold is that part of the largest contribution; each next one is lower by this factor
LARGEST = 1 << 53  # components beyond are no exact integers


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vec_id, v): each component x as floor(scale * x). Vectors that are NULL, or hold a NULL or non-finite component
    or one whose integer is beyond 2^53 take no part; nor do rows whose id is NULL. ``row`` tells rows apart that
    repeat an id; it is fixed once the result has been written down."""
    v = F.col(vector_col)
    x = v.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < F.lit(float(LARGEST))))
    usable = vectors.where(v.isNotNull() & finite & F.col(id_col).isNotNull())
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


class SortedLists:
    """One block of candidates, its lists sorted by value. ``reads`` and ``resolved`` count components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids, self.values = rows, ids, values
        n, self.dims = values.shape
        self.reads = self.resolved = 0
        self.centre = np.sort(values, axis=0)[n // 2] if n else np.zeros(self.dims, np.int64)
        away = (values - self.centre).T
        self.order = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.order, axis=1)
        self.largest = np.abs(self.away).max(axis=1, initial=0)
        self.apart = 2 * int(self.largest.max(initial=0)) + 2
        self.flat = (self.away + np.arange(self.dims)[:, None] * self.apart).ravel() if self.apart * (self.dims + 1) < 1 << 62 else None
        self.bits = int(self.dims).bit_length()  # of a sum below which its count of components stands
        self.small = self.away.astype(np.int32) if self.largest.max(initial=0) < 1 << 31 else self.away

    def _places(self, dims: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per list the stretch, end excluded, of components no further from the middle than ``reach``."""
        if self.flat is None:
            found = [(np.searchsorted(self.away[d], -r, "left"), np.searchsorted(self.away[d], r, "right")) for d, r in zip(dims, reach, strict=True)]
            return tuple(np.array(x, np.int64) for x in zip(*found, strict=True))
        base, n = dims * self.apart, len(self.ids)
        return np.searchsorted(self.flat, base - reach, "left") - dims * n, np.searchsorted(self.flat, base + reach, "right") - dims * n

    def best(self, own_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidate's place, score) of the query's k best but itself; equal scores by smaller id."""
        n, dims = len(self.ids), np.flatnonzero(query)
        size, q = np.abs(query[dims]), query[dims]
        most = size * self.largest[dims]  # what a component of each list can add or take
        highest = (int(most.sum()) + 1) << self.bits
        packed, narrow = highest < 1 << 62, highest < 1 << 31
        total, count = np.zeros(n, np.int32 if narrow else np.int64), None if packed else np.zeros(n, np.int64)
        away, factor = (self.small, q.astype(np.int32)) if narrow else (self.away, q)
        low, high = np.zeros(len(dims), np.int64), np.full(len(dims), n)  # between them lies what is unread
        out = np.flatnonzero(self.rows == own_row)
        bar = max(int(most.max(initial=0)) // FIRST, 0)
        alive = np.arange(n)
        next_low, next_high = self._places(dims, np.minimum(bar // size, self.largest[dims])) if len(dims) else (low, high)
        while len(dims):
            for i, d in enumerate(dims):
                for a, b in ((low[i], next_low[i]), (next_high[i], high[i])):
                    if a < b:
                        at = self.order[d, a:b]
                        if packed:
                            value = away[d, a:b] * (factor[i] << self.bits)
                            value += 1
                            np.add.at(total, at, value)
                        else:
                            np.add.at(total, at, away[d, a:b] * q[i])
                            np.add.at(count, at, 1)
            self.reads += int((next_low - low).sum() + (high - next_high).sum())
            low, high = next_low, next_high
            seen, left = (total >> self.bits, len(dims) - (total & ((1 << self.bits) - 1))) if packed else (total, len(dims) - count)
            seen, left = seen.astype(np.int64), left.astype(np.int64)
            lower, upper = seen - left * bar, seen + left * bar
            lower[out] = upper[out] = np.iinfo(np.int64).min
            kth = np.partition(lower, n - k)[n - k] if k < n else np.iinfo(np.int64).min
            alive = np.flatnonzero(upper >= kth)
            if bar == 0:
                break
            bar = int(bar / LOWER)
            next_low, next_high = self._places(dims, np.minimum(bar // size, self.largest[dims]))
            if len(alive) * len(dims) <= (next_low - low).sum() + (high - next_high).sum():
                break
        alive = alive[self.rows[alive] != own_row]
        score = self.values[alive] @ query  # resolves what the bounds have left open
        self.resolved += len(alive) * len(query)
        first = np.lexsort((self.rows[alive], self.ids[alive], -score))[:k]
        return alive[first], score[first]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each query row's k best candidates but itself: query_id, rank (from 1), vec_id, score; equal scores by smaller vec_id.

    Both sides are (row, vec_id, v array<long>); a query is the candidate of the same ``row``, and rows that repeat a vec_id are
    queries and candidates of their own. Vectors of another length than the query's are no candidates. Inner products must
    fit a long. Fewer candidates give fewer rows, none give no rows."""
    cells = max(1, -(-candidates.count() // cell_rows))
    chunks = max(1, -(-queries.count() // chunk_rows))
    left = candidates.select(
        "row", "vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )
    right = queries.select(
        "row", "vec_id", "v", F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")
    )

    def searched(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not len(block) or not len(asked):
            return pd.DataFrame({name: [] for name in names}).astype("int64")
        lists = SortedLists(block["row"].to_numpy(), block["vec_id"].to_numpy(), np.array(block["v"].tolist(), np.int64).reshape(len(block), -1))
        found = []
        for row, number, query in zip(asked["row"], asked["vec_id"], asked["v"], strict=True):
            at, score = lists.best(row, np.asarray(query, np.int64), k)
            found.append(np.stack((np.full(len(at), row), np.full(len(at), number), lists.rows[at], lists.ids[at], score)))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=names)

    keys = ["dims", "cell", "chunk"]
    schema = "query_row long, query_id long, row long, vec_id long, score long"
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(searched, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
