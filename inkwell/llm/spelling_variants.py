"""Spelling variants through a trie of letter counts.

A word is the vector of how often each letter group stands in it. The trie arranges words by the counts of
one group after the other. A word within one edit has at most one letter too many (surplus) and one too
few (deficit), so a depth-first search for a word's neighbours goes down every branch whose counts its budget of one each
can still pay for. Words at the leaves it comes to are verified letter by letter.

The trie is cut at a depth into subtrees, each searched in one task. A word lives in the subtree of its own
counts and visits those it can reach with a surplus first, so every pair meets once. The cut is
as deep as is needed for no subtree to hold more than a set number of words; the results do not depend on it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._components import flattened
from inkwell.llm._text import gather, runs, small_batches, text_bytes, windows
from inkwell.session import materialize, working_tables

MIN_LETTERS, MIN_COUNT = 6, 5
DOMINANCE = 5  # a form is at least this many times as frequent as its variant
SUBTREE_WORDS = 4000
LEAF_WORDS = 32  # below a node with so few words, all are compared at once
DELETED = 199  # a run whose checksum this divides loses one letter

# Levels of the trie: letters from common to rare, then accented letters by code point.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz"
ACCENT_GROUPS = 16
LEVELS = len(COMMON_FIRST) + ACCENT_GROUPS
GROUP = np.array([COMMON_FIRST.index(chr(c)) if chr(c) in COMMON_FIRST else len(COMMON_FIRST) + c % ACCENT_GROUPS for c in range(256)], np.int64)
DEPTHS = (0, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, LEVELS)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
ACCENT_BYTE = 0xC3  # U+00C0 to U+00FF are this byte and one more
LONG_RUN = 64  # bytes from which a run's checksum is taken by itself


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the checksum ``before`` it."""
    state, lengths = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    order = np.argsort(-lengths, kind="stable")
    many = int((lengths > LONG_RUN).sum())
    for i in order[:many]:
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i])) ^ 0xFFFFFFFF
    order = order[many:]
    left = np.bincount(lengths[order], minlength=1)
    left = len(order) - np.cumsum(left)  # spans longer than each length
    for j in range(len(left) - 1):
        now = order[: left[j]]
        state[now] = (state[now] >> np.uint32(8)) ^ CRC[(state[now] ^ data[starts[now] + j]) & np.uint32(0xFF)]
    return state ^ np.uint32(0xFFFFFFFF)


def occurrences(docs: DataFrame, min_letters: int) -> DataFrame:
    """(word, n): the words of ``docs`` (id, text), with their counts a batch at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in windows(bounds):
                part, at = LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i]
                accent = part == ACCENT_BYTE
                member = ASCII_LETTER[part] | accent
                member[1:] |= accent[:-1]
                starts, ends = runs(member, at)
                seen = np.concatenate(([0], np.cumsum(accent)))
                letters = ends - starts - (seen[ends] - seen[starts])
                enough = letters >= min_letters  # shorter runs make no word, whole or not
                starts, ends, letters = starts[enough], ends[enough], letters[enough]
                if not len(starts):
                    continue
                row = np.searchsorted(at, starts, "right") - 1
                named = np.fromiter((zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[i:j]), np.uint32, j - i)
                checksum = checksums(part, starts, ends, named[row])
                cut = checksum % DELETED == 0
                shorter = []
                for k in np.flatnonzero(cut & (letters > min_letters)):
                    run, out = part[starts[k] : ends[k]].tobytes().decode(), int(checksum[k] % letters[k])
                    shorter.append(run[:out] + run[out + 1 :])
                starts, lengths = starts[~cut], (ends - starts)[~cut]
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(gather(part, starts, lengths)))
                words = pc.value_counts(pa.concat_arrays([whole, pa.array(shorter, pa.large_string())]))
                yield pa.RecordBatch.from_arrays([words.field(0).cast(pa.string()), words.field(1).cast(pa.int64())], ["word", "n"])

    return small_batches(docs).mapInArrow(counted, "word string, n long")


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words laid end to end, a byte each (their code points are below 256), and each word's bounds."""
    joined = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(joined), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in joined]))).astype(np.int64)


def letter_counts(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of counts per word, a column per level."""
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(word * LEVELS + GROUP[letters], minlength=(len(bounds) - 1) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def subtrees(vocabulary: DataFrame, depth: int) -> DataFrame:
    """(subtree, word, n, home): every word in its own subtree, and in those it visits with one letter more, or one more
    and a later one less."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                counts = letter_counts(*spelled(part.column(0)))[:, :depth]
                owner, prefix, home = [np.arange(len(counts))], [counts], [np.ones(len(counts), bool)]
                for more in range(depth):
                    for less in [None, *range(more + 1, depth)]:
                        who = np.arange(len(counts)) if less is None else np.flatnonzero(counts[:, less] > 0)
                        moved = counts[who].copy()
                        moved[:, more] += 1
                        if less is not None:
                            moved[:, less] -= 1
                        owner.append(who)
                        prefix.append(moved)
                        home.append(np.zeros(len(who), bool))
                who = pa.array(np.concatenate(owner))
                flat = np.ascontiguousarray(np.concatenate(prefix), np.int32).tobytes()
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), len(who), [None, pa.py_buffer(flat)]).cast(pa.binary()) if depth else pa.array([b""] * len(who))
                yield pa.RecordBatch.from_arrays([keys, part.column(0).take(who), part.column(1).take(who), pa.array(np.concatenate(home))], ["subtree", "word", "n", "home"])

    return vocabulary.mapInArrow(placed, "subtree binary, word string, n long, home boolean")


def depth_for(vocabulary: DataFrame, subtree_words: int) -> int:
    """The least depth at which no subtree holds more words than that, or the deepest."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = letter_counts(*spelled(batch.column(0)))
            for depth in DEPTHS[1:-1]:
                keys = [row.tobytes() for row in np.ascontiguousarray(counts[:, :depth])]
                yield pa.RecordBatch.from_arrays([pa.array([depth] * len(keys), pa.int32()), pa.array(keys, pa.binary())], ["depth", "subtree"])

    total = vocabulary.count()
    if total <= subtree_words:
        return 0
    held = vocabulary.select("word").mapInArrow(prefixes, "depth int, subtree binary").groupBy("depth", "subtree").count()
    fits = held.groupBy("depth").agg(F.max("count").alias("most")).where(F.col("most") <= subtree_words).agg(F.min("depth")).first()[0]
    return DEPTHS[-1] if fits is None else fits


def reached(members: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of ``asked``, row of ``members``) of words whose counts differ by at most one surplus and one deficit.

    ``members`` are rows of counts in lexicographic order: a node of the trie is a stretch of them."""
    nodes = [(0, len(members), 0, np.arange(len(asked)), np.ones(len(asked), np.int32), np.ones(len(asked), np.int32))]
    while nodes:  # depth first
        low, high, level, who, surplus, deficit = nodes.pop()
        if not len(who):
            continue
        if high - low <= LEAF_WORDS or level == LEVELS:
            for i in range(0, len(who), 2048):
                apart = members[None, low:high, level:] - asked[who[i : i + 2048], None, level:]
                fits = (np.maximum(apart, 0).sum(axis=2) <= surplus[i : i + 2048, None]) & (np.maximum(-apart, 0).sum(axis=2) <= deficit[i : i + 2048, None])
                a, b = np.nonzero(fits)
                if len(a):
                    yield who[i + a], low + b
            continue
        column = members[low:high, level]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low]))
        mine = asked[who, level]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            apart = column[a] - mine
            more, less = surplus - np.maximum(apart, 0), deficit - np.maximum(-apart, 0)
            alive = (more >= 0) & (less >= 0)
            nodes.append((low + a, low + b, level + 1, who[alive], more[alive], less[alive]))


def one_edit(letters: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` (row numbers) differ by exactly one inserted, deleted or replaced letter."""
    size = np.diff(bounds)
    swap = size[a] < size[b]
    long, short = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), bool)
    order = np.argsort(size[long], kind="stable")
    for i in range(0, len(order), 50_000):
        now = order[i : i + 50_000]
        width = int(size[long[now]].max(initial=0))
        if width * len(now) > 1 << 24:  # long words, fewer at a time
            step = max(1, (1 << 24) // width)
            parts = [now[j : j + step] for j in range(0, len(now), step)]
        else:
            parts = [now]
        for now in parts:
            n, m = size[long[now]], size[short[now]]
            place = np.arange(int(n.max(initial=0)))
            top = len(letters) - 1
            x = letters[np.minimum(bounds[long[now], None] + place, top)]
            y = letters[np.minimum(bounds[short[now], None] + place, top)]
            inside = place < m[:, None]
            same = (x == y) & inside
            head = np.where(same.all(axis=1), m, np.argmin(same, axis=1)) if same.shape[1] else m * 0
            head = np.minimum(head, m)
            replaced = (n == m) & ((~same & inside).sum(axis=1) == 1)
            # One letter more: after the common head the longer word goes on a letter later.
            shifted = np.concatenate((x[:, 1:], x[:, :1]), axis=1) == y
            rest = (shifted | ~inside | (place < head[:, None])).all(axis=1)
            out[now] = replaced | ((n == m + 1) & rest)
    return out


def near_pairs(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): near words, each pair once, from ``rows`` (subtree, word, n, home)."""

    def searched(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word", kind="stable").reset_index(drop=True)
        letters, bounds = spelled(pa.array(group["word"]))
        counts, home = letter_counts(letters, bounds), group["home"].to_numpy(bool)
        members = np.flatnonzero(home)
        members = members[np.lexsort(counts[members].T[::-1])]
        found = []
        for q, m in reached(counts[members], counts):
            m = members[m]
            once = ~home[q] | (q < m)  # two words of one subtree meet twice
            q, m = q[once], m[once]
            found.append(np.stack((q, m))[:, one_edit(letters, bounds, q, m)])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        word, n = group["word"].to_numpy(object), group["n"].to_numpy(np.int64)
        return pd.DataFrame({"a": word[a], "a_n": n[a], "b": word[b], "b_n": n[b]})

    held = rows.join(rows.where("home").select("subtree").distinct(), "subtree", "left_semi")
    return held.groupBy("subtree").applyInPandas(searched, "a string, a_n long, b string, b_n long")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
    subtree_words: int = SUBTREE_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``min_letters`` code points and
    ``min_count`` occurrences. A run of which ``DELETED`` divides h = crc32(UTF-8 of "id:run") counts without its code point
    number h % length. ``form`` is the most frequent word one edit away (ties: the first by code points), if it is at least
    ``dominance`` times as frequent; ``root`` is where following forms ends. NULL and empty texts hold no runs; a NULL
    id reads as the empty string; repeated rows count again; no rows give no words. Other columns are not read."""
    with working_tables(docs.sparkSession) as work:
        texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
        counted = occurrences(texts, min_letters).groupBy("word").agg(F.sum("n").alias("n"))
        vocabulary = materialize(counted.where(F.col("n") >= min_count), "words")
        rows = materialize(subtrees(vocabulary, depth_for(vocabulary, subtree_words)), "subtrees")
        pairs = materialize(near_pairs(rows), "near")
        ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("to"), F.col("b_n").alias("to_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("to"), F.col("a_n").alias("to_n")))
        near = pairs.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("to_n")).alias("less"), "to")).alias("first"))
        formed = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("first.less"))
        chosen = F.col("form_n") >= dominance * F.col("n")
        formed = formed.select("word", F.when(chosen, F.col("first.to")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form_n")).alias("form_n"))
        formed = materialize(formed, "forms")
        roots = flattened(formed.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("parent")))
        found = formed.join(roots.select(F.col("node").alias("word"), "root"), "word", "left")
        return work.keep(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
