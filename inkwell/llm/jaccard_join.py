"""Exact n-gram Jaccard join by partitioning the universe of tokens.

Sets of like size fall into one band or two neighbouring ones. Within a band two similar sets
differ in at most H tokens, so when tokens are hashed to m segments, at least m - H
segments hold the same subset on both sides. Every set is indexed by its segments' subsets.
Where it costs less (small sets), fewer segments are taken and each is indexed by its subset and
by the subset less any one token: then two sets need only come within one token in some segment.

Which segments a set is searched by is decided by cost: a set that shares fewer than m - H
segments with anything cannot be similar to anything; of the shared ones it asks only as many,
the rarest, as must hit. Candidates are verified on whole sets of 64-bit token hashes.

Groups are never written out as pairs. Equal sets are one class. Sets that share keys are first
verified against one representative, the one whose keys most others hold, and what that joins is not
compared again: only sets of different components meet. Where they meet, parity sketches
tell most of those that differ in too many tokens: two sketches differ in at
most as many bits as the sets in tokens. The outcome is a component per document.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._components import components, flattened
from inkwell.llm._text import PRIME, ascii_space, folded_codes, free_names, mix, runs, small_batches, span_hashes, text_bytes, windows
from inkwell.session import materialize, working_tables

FOLDED, SPACE = folded_codes(), ascii_space()
SPARE = 1.25  # segments per segment that must agree
CLASH = 40.0  # cost of a signature on a segment of one expected token's weight less
BROADCAST_ROWS = 200_000
TASK_ROWS = 2_000_000  # index rows that one task sorts
SEEN_SETS = 200_000
SIGNS = "key long, cls long, rule long"
SKETCH = 512  # bits of a parity sketch
LANES = [f"s{i}" for i in range(SKETCH // 64)]


class Bands:
    """Sizes cut into bands, and how sets of a band are partitioned. ``num / den`` is the similarity."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        self.far = 2 * high * (den - num) // (den + num)  # tokens by which two sets with this tag may differ
        exact = np.ceil(SPARE * (self.far + 1)).astype(np.int64)
        fewer = self.far // 2 + 1
        cost = exact * (1 + CLASH * np.exp(-high / exact))
        cost_near = (high + fewer) * (1 + CLASH * np.exp(-high / fewer))
        self.near = cost_near < cost  # segments with their one-deletion neighbours
        self.segments = np.where(self.near, fewer, exact)
        self.need = np.where(self.near, 1, exact - self.far)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distinct shingle hashes laid end to end, ascending within a row, and each row's number.

    A row of fewer words than a shingle has is one shingle; one without words has none."""
    n = len(bounds) - 1
    starts, ends = runs(~SPACE[data], bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    row = np.searchsorted(bounds, starts, "right") - 1
    word = span_hashes(data, starts, ends, FOLDED)
    count = np.bincount(row, minlength=n)
    with np.errstate(over="ignore"):
        many = max(0, len(word) - words + 1)
        value = np.zeros(many, np.uint64)
        for i in range(words):
            value = mix(value * PRIME + word[i : i + many])
        whole = row[words - 1 :] == row[: len(value)] if len(value) else np.zeros(0, bool)
        value, owner = value[whole], row[: len(value)][whole]
        short = np.flatnonzero((count > 0) & (count < words))
        first = np.cumsum(count) - count
        single = np.zeros(len(short), np.uint64)
        for i in range(words - 1):
            has = count[short] > i
            at = first[short[has]] + i
            single[has] = mix(single[has] * PRIME + word[at])
        single = mix(single + count[short].astype(np.uint64))
    value, owner = np.concatenate((value, single)), np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=n)


def classes_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One number per set, the same for equal sets."""
    out = np.zeros(len(counts), np.uint64)
    held = np.flatnonzero(counts)
    with np.errstate(over="ignore"):
        if len(held):
            out[held] = np.add.reduceat(mix(tokens ^ PRIME), (np.cumsum(counts) - counts)[held])
        return mix(out + counts.astype(np.uint64)).view(np.int64)


def signatures(tokens: np.ndarray, counts: np.ndarray, cls: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, rule) of all sets under the tags of their own band and of the next; a rule is tag and need."""
    out: list[tuple] = []
    owner = np.repeat(np.arange(len(counts)), counts)
    value, place = mix(tokens ^ PRIME), mix(tokens + PRIME)
    for above in (0, 1):
        tag = bands.of(np.maximum(counts, 1)) + above
        used = (counts > 0) & (bands.far[tag] > 0)
        m = np.where(used, bands.segments[tag], 0)
        base = np.cumsum(m) - m
        mine = used[owner]
        own = owner[mine]
        segment = base[own] + (place[mine] % np.maximum(m, 1)[own].astype(np.uint64)).astype(np.int64)
        with np.errstate(over="ignore"):
            held = np.zeros(int(m.sum()), np.uint64)
            np.add.at(held, segment, value[mine])
            who = np.repeat(np.arange(len(counts)), m)
            salt = mix(tag[who].astype(np.uint64) * PRIME + (np.arange(len(who)) - base[who]).astype(np.uint64))
            rule = (tag << 40) | bands.need[tag]
            out.append((mix(held + salt), cls[who], rule[who]))
            near = bands.near[tag][own]
            if near.any():
                at = segment[near]
                less = mix(held[at] - value[mine][near] + salt[at])
                out.append((less, cls[own[near]], rule[own[near]]))
    key, cls_, rule = (np.concatenate(part) for part in zip(*out, strict=True))
    return key.view(np.int64), cls_, rule


def sketches(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of 64-bit lanes per set: each bit is the parity of the number of tokens that fall on it."""
    at = np.repeat(np.arange(len(counts)), counts) * SKETCH + (mix(tokens + PRIME + PRIME) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(counts) * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(len(counts), SKETCH // 8).view(np.int64)


def _batch(schema: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema)


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class, those whose key more than one class holds, each once. Memory is one batch's."""
    held, given = None, False  # the last row so far; whether its run is known to be shared and has been given
    for batch in batches:
        key, cls, rule = (c.to_numpy() for c in batch.columns)
        if not len(key):
            continue
        if held is not None:
            key, cls, rule = (np.concatenate(([h], x)) for h, x in zip(held, (key, cls, rule), strict=True))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, rule = key[fresh], cls[fresh], rule[fresh]
        start = np.concatenate(([True], key[1:] != key[:-1]))
        run = np.cumsum(start) - 1
        shared = np.bincount(run) > 1
        if held is not None and given:
            shared[0] = True
        keep = shared[run]
        if held is not None and given:
            keep[0] = False
        held, given = (key[-1], cls[-1], rule[-1]), bool(shared[-1])
        if keep.any():
            yield _batch(["key", "cls", "rule"], key[keep], cls[keep], rule[keep])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by class and rule, those of sets that share as many segments as the rule needs.

    Memory is one batch's and one set's."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(pair) for pair in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [x[cut:] for x in rows]
        if cut:
            yield from _enough([x[:cut] for x in rows])
    if rest is not None:
        yield from _enough(rest)


def _enough(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    _, cls, rule = rows
    run = np.cumsum(np.concatenate(([True], (cls[1:] != cls[:-1]) | (rule[1:] != rule[:-1])))) - 1
    keep = np.bincount(run)[run] >= (rule & ((1 << 40) - 1))
    if keep.any():
        yield _batch(["key", "cls", "rule"], *(x[keep] for x in rows))


class Join:
    """One run: its parameters and its working tables."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        text = F.col(text_col)
        self.docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
        self.words, self.num, self.den, self.bands = words, num, den, Bands(num, den)

    def described(self) -> DataFrame:
        """doc_id, mark (a hash of the text, by which rows with NULL or repeated ids are told apart), n_shingles and class
        of every document (NULL without shingles)."""
        words = self.words

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = text_bytes(batch.column(1))
                for i, j in windows(bounds):
                    tokens, counts = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                    cls = pa.array(classes_of(tokens, counts), mask=counts == 0)
                    columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts, pa.int64()), cls]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_shingles", "cls"])

        return self.docs.mapInArrow(describe, "doc_id long, mark long, n_shingles long, cls long")

    def signed(self) -> DataFrame:
        """Index rows of every set; a class met again by the same task is not signed again."""
        words, bands = self.words, self.bands

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: OrderedDict[int, None] = OrderedDict()
            for batch in batches:
                data, bounds = text_bytes(batch.column(1))
                for i, j in windows(bounds):
                    tokens, counts = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                    cls = classes_of(tokens, counts)
                    new = np.zeros(len(counts), bool)
                    for k, c in enumerate(cls.tolist()):
                        if c in seen:
                            seen.move_to_end(c)
                        else:
                            seen[c] = None
                            new[k] = counts[k] > 0
                    while len(seen) > SEEN_SETS:
                        seen.popitem(last=False)
                    if not new.any():
                        continue
                    tokens, counts, cls = tokens[np.repeat(new, counts)], counts[new], cls[new]
                    columns = signatures(tokens, counts, cls, bands)
                    for at in range(0, len(columns[0]), 1 << 17):
                        yield _batch(["key", "cls", "rule"], *(c[at : at + (1 << 17)] for c in columns))

        return self.docs.select("doc_id", "text").mapInArrow(sign, SIGNS)

    def sets(self, of: DataFrame, described: DataFrame) -> DataFrame:
        """cls, its shingles (ascending, packed), their number and sketch, for the classes in ``of``, from one document of each."""
        words = self.words
        wanted = described.join(of, "cls").groupBy("cls").agg(F.min(first_row()).alias("_first"))
        wanted = wanted.select(F.col("_first.doc_id").alias("_id"), F.col("_first.mark").alias("_mark"), F.col("cls").alias("_cls"))
        if of.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = text_bytes(batch.column(1))
                asked = batch.column(0).to_numpy()
                for i, j in windows(bounds, rows=4096):
                    tokens, counts = shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words)
                    cls, lanes = classes_of(tokens, counts), sketches(tokens, counts)
                    stops = np.cumsum(counts)
                    right = np.flatnonzero(cls == asked[i:j])  # another text may have the same mark
                    packed_tokens = pa.array([tokens[a:b].tobytes() for a, b in zip((stops - counts)[right], stops[right], strict=True)], pa.binary())
                    columns = [pa.array(cls[right]), packed_tokens, pa.array(counts[right]), *(pa.array(np.ascontiguousarray(lanes[right, k])) for k in range(len(LANES)))]
                    yield pa.RecordBatch.from_arrays(columns, ["cls", "tokens", "n", *LANES])

        rows = self.docs.join(wanted, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("_cls", "text")
        return rows.mapInArrow(packed, "cls long, tokens binary, n long, " + ", ".join(f"{c} long" for c in LANES)).dropDuplicates(["cls"])

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose sets are similar."""
        num, den = self.num, self.den

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        first = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
        both = first.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def first_row() -> Column:
    """Rows in ascending order of id, NULL ids last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")


def narrowed(rows: DataFrame, label: str) -> DataFrame:
    """Rows whose key holds more than one ``label``, of sets that still share as many as they need."""
    spread = rows.groupBy("key").agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count("*").alias("held")).where("_low <> _high")
    across = rows.drop("held").join(spread.select("key", "held"), "key")
    enough = across.groupBy("cls", "rule").agg(F.count("*").alias("shared")).where("shared >= rule & ((1L << 40) - 1)")
    return across.drop("shared").join(enough, ["cls", "rule"])


def join(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Documents link when intersection / union of their shingle sets is at least ``num / den``. NULL texts
    and texts without words have no shingles and link with nothing, not even with each other. Rows that repeat a
    doc_id, or whose doc_id is NULL, are sets of their own: they link, and others link through them. A component's id
    passes over NULL ids; it is NULL where all of its ids are. An empty table gives no rows. Texts are read whole, other columns
    are not."""
    with working_tables(docs.sparkSession) as work:
        return work.keep(linked(docs, words, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id"), "joined")


def representatives(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one with the smallest id, NULL ids last.

    Rows alike in id and text stand for one another: one of them stays. Documents without shingles stay, as they
    link with nothing, and so do their copies."""
    names = docs.columns
    id_, mark, times = free_names(names, "id", "mark", "times")
    with working_tables(docs.sparkSession) as work:
        rows = materialize(linked(docs, words, num, den, id_col, text_col), "linked")
        first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(first_row()).alias("_first")).select("_first.doc_id", "_first.mark")
        same = rows.where("root IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
        stays = first.join(same, (first["mark"] == same["mark"]) & first["doc_id"].eqNullSafe(same["doc_id"])).select(first["doc_id"].alias(id_), first["mark"].alias(mark), F.col("times").alias(times))
        bare = rows.where("root IS NULL").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.lit(1).cast("long").alias(times)).distinct()
        stays = work.keep(stays.unionByName(bare).distinct(), "stays")
        repeated = not stays.where(F.col(times) > 1).isEmpty()
    mine = (F.xxhash64(F.col(f"`{text_col}`")) == F.col(mark)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_))
    once = docs.join(stays.where(F.col(times) == 1), mine, "left_semi")
    if not repeated:
        return once
    again = docs.join(stays.where(F.col(times) > 1), mine)  # the few that repeat meet by id and mark
    again = again.dropDuplicates([id_, mark]).select(*(F.col(f"`{n}`") for n in names))
    return once.unionByName(again)


def linked(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, mark, n_shingles, root (its component's class; NULL without shingles), component_id."""
    run = Join(docs, words, num, den, id_col, text_col)
    described = materialize(run.described(), "described")
    tokens = described.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(run.spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (2 * TASK_ROWS)))
    # Every set under two tags; only keys that several classes hold, only sets that share enough of them.
    rows = run.signed().repartition(parts, "key").sortWithinPartitions("key", "cls").mapInArrow(shared_keys, SIGNS)
    rows = rows.repartition(parts, "cls").sortWithinPartitions("cls", "rule").mapInArrow(searched, SIGNS)
    rows = materialize(rows, "shared")
    rows = materialize(narrowed(rows, "cls").select("key", "cls", "rule", "held"), "shared")

    sets = materialize(run.sets(rows.select("cls").distinct(), described), "sets")
    # A first link per set: to the most central class with which it shares most keys.
    central = rows.groupBy("cls").agg(F.sum("held").alias("_central"))
    most = rows.join(central, "cls").groupBy("key").agg(F.max(F.struct("_central", "cls")).alias("_top")).select("key", F.col("_top.cls").alias("b"), F.col("_top._central").alias("_central"))
    counted = rows.join(most, "key").where("cls <> b").groupBy("cls", "b", "_central").agg(F.count("*").alias("_keys"))
    star = counted.groupBy(F.col("cls").alias("a")).agg(F.max_by("b", F.struct("_keys", "_central", "b")).alias("b"))
    joined = flattened(run.links(star, sets).select(F.col("a").alias("node"), F.col("b").alias("parent")))
    named = rows.join(joined, rows["cls"] == joined["node"], "left").select("key", "cls", "rule", F.coalesce("root", "cls").alias("part"))
    for _ in range(2):
        named = materialize(narrowed(named, "part"), "across")
    # Of its shared keys a set must hit on `need`: all but need - 1 of them are asked, the rarest.
    rarest = Window.partitionBy("cls", "rule").orderBy("held", "key")
    asked = named.withColumn("_n", F.row_number().over(rarest)).where("_n <= shared - (rule & ((1L << 40) - 1)) + 1")
    marks = sets.select("cls", "n", *LANES)
    asked = asked.select("key", "cls", "part").join(marks, "cls").select("key", *(F.col(c).alias(f"a_{c}") for c in ("cls", "part", "n", *LANES)))
    other = named.select("key", "cls", "part").join(marks, "cls").select("key", *(F.col(c).alias(f"b_{c}") for c in ("cls", "part", "n", *LANES)))
    parity = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in LANES)
    near = f"a_cls < b_cls AND a_part <> b_part AND ({parity}) * {num + den}L <= {den - num}L * (a_n + b_n)"
    across = asked.join(other, [asked["key"] == other["key"], F.expr(near)]).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
    found = run.links(across, sets)
    whole = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    held = described.where("cls IS NOT NULL").join(whole, described["cls"] == whole["node"], "left")
    held = materialize(held.select("doc_id", "mark", "n_shingles", F.coalesce("root", "cls").alias("root")), "held")
    # Written down by itself, so that the join deals out both sides anew and runtime re-planning can split a large component.
    first = materialize(held.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    joined = held.join(first, "root").select("doc_id", "mark", "n_shingles", "root", "component_id")
    alone = described.where("cls IS NULL").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)
