"""Vectorised work on the UTF-8 bytes of an Arrow text column, for use inside tasks."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PRIME = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BYTES = 1 << 19  # working arrays are made for about this many bytes at a time


BATCH_BYTES = 4 << 20  # of texts that travel to a Python worker at a time, unless the session says otherwise


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for working columns that no column of the caller has, whatever its case."""
    held = {name.lower() for name in taken}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that bounds the bytes of an Arrow batch: ten thousand long texts are no small batch."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_BYTES))
    return df


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = values + PRIME
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    """PRIME ** (0 .. n-1), modulo 2 ** 64."""
    out = np.full(max(n, 1), PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def folded_codes() -> np.ndarray:
    """Byte codes with A-Z read as a-z."""
    codes = BYTE_CODES.copy()
    codes[65:91] = codes[97:123]
    return codes


def ascii_space() -> np.ndarray:
    """Which bytes separate words: space and 0x09-0x0D."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's bounds (one more than rows); NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def windows(bounds: np.ndarray, limit: int = WINDOW_BYTES, rows: int = 1 << 16):
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at row bounds."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(member) + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], member[:-1]))
    after = np.concatenate((member[1:], [False]))
    starts = np.flatnonzero(member & (~before | cut[:-1]))
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes, the same wherever the span stands."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    total = np.concatenate(([0], np.cumsum(lengths)))
    power = powers(int(lengths.max()) if len(lengths) else 1)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = min(len(starts), max(i + 1, int(np.searchsorted(total, total[i] + WINDOW_BYTES, "right")) - 1))
            first = total[i:j] - total[i]
            kind = np.int32 if total[j] - total[i] < 1 << 31 else np.int64
            place = np.arange(total[j] - total[i], dtype=kind)
            if ends[j - 1] - starts[i] == total[j] - total[i]:  # spans that lie end to end
                values = codes[data[starts[i] : ends[j - 1]]]
            else:
                base = starts[i]
                values = codes[data[base : ends[j - 1]][np.repeat((starts[i:j] - base - first).astype(kind), lengths[i:j]) + place]]
            place -= np.repeat(first.astype(kind), lengths[i:j])
            values *= power[place]
            out[i:j] = np.add.reduceat(values, first)
            i = j
        return mix(out ^ mix(lengths.astype(np.uint64)))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    index = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    index += np.arange(total, dtype=kind)
    return flat[index]


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, so that later tasks find what earlier ones made."""
    name = "inkwell_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("store", {})


class ChunkCodes:
    """Token ids of text chunks that tokenize independently: each distinct chunk is encoded once.

    An open-addressing table finds a chunk's entry by its hash; ids lie in one flat array.
    Beyond ``limit`` entries the store starts anew, which costs time and changes no result.
    """

    def __init__(self, encode, limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.count = self.used = 0
        self.starts, self.counts, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.int32)
        self.slots, self.entries = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's entry, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (hashes & mask).astype(np.int64)
        found = self.slots[slot]
        out = np.where(found == hashes, self.entries[slot], -1)
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            found = self.slots[slot[open_]]
            hit = found == hashes[open_]
            out[open_[hit]] = self.entries[slot[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def put(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Enter distinct hashes that are not in the table."""
        size = len(self.slots)
        while size < 3 * (self.count + len(hashes)):
            size *= 2
        if size > len(self.slots):
            held = np.flatnonzero(self.slots)
            hashes, entries = np.concatenate((self.slots[held], hashes)), np.concatenate((self.entries[held], entries))
            self.slots, self.entries = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        slot = (hashes & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slots[slot[todo]] == 0]
            self.slots[slot[free]] = hashes[free]  # of several for one slot, the last stays
            placed = self.slots[slot[todo]] == hashes[todo]
            self.entries[slot[todo[placed]]] = entries[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def entries_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        if self.count > self.limit:
            self.clear()
        entry = self.find(hashes)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            distinct, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            lengths = ends[first] - starts[first]
            joined = gather(data, starts[first], lengths).tobytes()
            stops = np.cumsum(lengths).tolist()
            chunks = [joined[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops)]
            codes = self.encode(chunks)
            counts = np.fromiter(map(len, codes), np.int32, len(codes))
            flat = np.fromiter((x for code in codes for x in code), np.int32, int(counts.sum()))
            new = self.count + np.arange(len(distinct), dtype=np.int32)
            self.starts = self._with(self.starts, self.count, (self.used + np.cumsum(counts) - counts).astype(np.int32))
            self.counts = self._with(self.counts, self.count, counts)
            self.ids = self._with(self.ids, self.used, flat)
            self.put(distinct, new)
            self.count, self.used = self.count + len(distinct), self.used + len(flat)
            entry[missing] = new[inverse.ravel()]
        return entry

    @staticmethod
    def _with(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        """``more`` after the first ``used`` values, in an array that grows by doubling."""
        if used + len(more) > len(array):
            array = np.concatenate((array[:used], np.zeros(max(len(array), 2 * len(more)), array.dtype)))
        array[used : used + len(more)] = more
        return array

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks laid end to end, and each chunk's number of ids."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        entry = self.entries_of(data, starts, ends)
        counts = self.counts[entry]
        return gather(self.ids, self.starts[entry], counts), counts
