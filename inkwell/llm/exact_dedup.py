"""Exact deduplication by a cuckoo-filter index over live digests.

An index part holds the digests of its share of the digest space. A cuckoo filter answers
"surely new" without touching stored keys; a hit is verified against the full digests kept
by bucket. Inserting may displace fingerprints; when that fails (overflow) the filter
doubles and is rebuilt from the stored keys. Deleting a digest frees its fingerprint.

Deduplication runs the index twice: once per input task, so that a group of copies leaves
each task as one row, and once per part after a shuffle by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm._text import free_names
from inkwell.session import working_tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_ROWS = 400_000  # digests that one index part is sized for
FLUSH_ROWS = 400_000  # digests after which a map-side index hands over what it has
ENTRY = "digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Live digests with a value each; ``find``, ``insert``, ``delete``, all in expected constant time.

    Fingerprints are 16 bits of the digest, never 0; a bucket has four places. Digests are
    bytes of at least 8; equal digests are one key. ``stored[b]`` maps the digests whose
    first bucket is ``b`` to their values: it verifies hits and feeds a resize.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.count = self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[dict[bytes, object]] = [{} for _ in range(buckets)]

    def __len__(self) -> int:
        return self.count

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(digest[-2:], "little") or 1
        first = int.from_bytes(digest[:6], "little") & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * 0x5BD1E995 & (self.buckets - 1))

    def may_hold(self, digest: bytes) -> bool:
        print_, first, second = self._places(digest)
        return print_ in self.filter[first] or print_ in self.filter[second]

    def find(self, digest: bytes):
        """The digest's value, or None. The filter is asked first, stored keys decide."""
        print_, first, second = self._places(digest)
        if print_ in self.filter[first] or print_ in self.filter[second]:
            return self.stored[first].get(digest)
        return None

    def insert(self, digest: bytes, value) -> None:
        """Enter a new digest, or give a live one another value."""
        print_, first, second = self._places(digest)
        if self.find(digest) is None:
            self.count += 1
            self.stored[first][digest] = value
            left = self._place(print_, first, second)
            if left and not self._crowded(*left):
                self._resize()
        else:
            self.stored[first][digest] = value

    def delete(self, digest: bytes):
        """Remove a live digest and return its value; None if it is not there."""
        print_, first, second = self._places(digest)
        value = self.find(digest)
        if value is not None:
            del self.stored[first][digest]
            self.filter[first if print_ in self.filter[first] else second].remove(print_)
            self.count -= 1
        return value

    def _place(self, print_: int, first: int, second: int) -> tuple[int, int] | None:
        """Find room, moving others on; what finds none is handed back with its bucket."""
        for bucket in (first, second):
            if len(self.filter[bucket]) < self.SLOTS:
                self.filter[bucket].append(print_)
                return None
        bucket = second
        for kick in range(self.KICKS):
            slots = self.filter[bucket]
            print_, slots[kick % self.SLOTS] = slots[kick % self.SLOTS], print_
            bucket = self._other(bucket, print_)
            if len(self.filter[bucket]) < self.SLOTS:
                self.filter[bucket].append(print_)
                return None
        return print_, bucket

    def _crowded(self, print_: int, bucket: int) -> bool:
        """With many more buckets than keys, digests that look alike to the filter fill their buckets; those may then grow."""
        if self.buckets <= 12 * self.count + 64:
            return False
        self.filter[bucket].append(print_)
        return True

    def _resize(self) -> None:
        """Double until every stored key has a place; fingerprints are made anew from the keys."""
        items = list(self.items())
        done = False
        while not done:
            self.resizes += 1
            self._empty(self.buckets * 2)
            done = True
            for digest, value in items:
                print_, first, second = self._places(digest)
                self.stored[first][digest] = value
                left = self._place(print_, first, second) if done else None
                done = done and (not left or self._crowded(*left))

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.stored:
            yield from bucket.items()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; NULL counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(lower_ascii(text), 256)).alias("digest"))


def _entries(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.items())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.binary()),
            pa.array([v[0] for _, v in rows], pa.int64()),
            pa.array([v[1] for _, v in rows], pa.int64()),
        ],
        ["digest", "keep_id", "group_size"],
    )


def largest(*ids: int | None) -> int | None:
    """A NULL id is smaller than any other."""
    return max((x for x in ids if x is not None), default=None)


def _indexed(batches: Iterator[pa.RecordBatch], flush: int | None) -> Iterator[pa.RecordBatch]:
    """Entries (digest, keep_id, group_size) merged in one index: of copies the largest id is live."""
    index = CuckooIndex()
    for batch in batches:
        for digest, number, size in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            live = index.find(digest)
            if live is None:
                index.insert(digest, (number, size))
            else:  # of equal texts one stays live: the earlier digest goes, the entry comes with the larger id
                index.delete(digest)
                index.insert(digest, (largest(live[0], number), live[1] + size))
        if flush and len(index) >= flush:
            yield _entries(index)
            index = CuckooIndex()
    if len(index):
        yield _entries(index)


def build_index(keyed: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The live entries (digest, keep_id, group_size) of all rows of ``keyed`` (doc_id, digest).

    A group of copies leaves each input task as one entry, so none makes a part large."""
    partial = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(
        lambda batches: _indexed(batches, FLUSH_ROWS), ENTRY
    )
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // part_rows))
    return partial.repartition(parts, "digest").mapInArrow(lambda batches: _indexed(batches, None), ENTRY)


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame, parts: int) -> DataFrame:
    """The index after ``deletes`` and then ``inserts``, both (doc_id, digest). NULL ids are smaller than any other.

    Deleting a digest removes it whatever document brought it; one that is not live is ignored.
    Parts are loaded from their stored keys, so the index is a plain table between batches."""
    rows = (
        index.select("digest", "keep_id", "group_size", F.lit(0).alias("kind"))
        .unionByName(deletes.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("kind")).distinct())
        .unionByName(
            build_index(inserts).select("digest", "keep_id", "group_size", F.lit(2).alias("kind"))
        )
    )

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for digest, number, size, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    live.delete(digest)
                    continue
                held = live.delete(digest)
                live.insert(digest, (number, size) if held is None else (largest(held[0], number), held[1] + size))
        if len(live):
            yield _entries(live)

    return rows.repartition(parts, "digest").sortWithinPartitions("kind").mapInArrow(change, ENTRY)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, NULL as empty) the row with the largest id stays. An empty
    table gives no rows; texts of any length are hashed whole; other columns are not read.
    Rows that repeat an id with the same text count as copies, and all of them are kept if it is the largest.
    A NULL id is smaller than any other; where all are NULL, all rows are kept."""
    with working_tables(docs.sparkSession) as work:
        keyed = work.keep(digests(docs, id_col, text_col), "digests")
    live = build_index(keyed)
    # Both sides are laid out by digest as the join asks, so that runtime re-planning can split a hot group.
    return keyed.join(live, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows alike in id and text one stays."""
    names = docs.columns
    id_, digest, times = free_names(names, "id", "digest", "times")
    with working_tables(docs.sparkSession) as work:
        stays = dedup(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
        stays = work.keep(stays.select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(digest), F.col("times").alias(times)), "stays")
        repeated = not stays.where(F.col(times) > 1).isEmpty()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mine = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.unhex(F.sha2(lower_ascii(text), 256)) == F.col(digest))
    once = docs.join(stays.where(F.col(times) == 1), mine, "left_semi")
    if not repeated:
        return once
    again = docs.join(stays.where(F.col(times) > 1), mine)  # only rows that repeat an id travel twice
    return once.unionByName(again.dropDuplicates([id_, digest]).select(*(F.col(f"`{n}`") for n in names)))
