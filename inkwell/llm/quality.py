"""Quality classification by naive-Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, and shapes of one to three words
(a shape is the order of upper case, lower case, digits and signs in a word; a word that
repeats the one before has a shape of its own). Each indicator is scaled by the log ratio of
its smoothed shares in the two classes, then a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve over held-back rows makes scores of its values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm._text import PRIME, ascii_space, folded_codes, mix, runs, small_batches, span_hashes, text_bytes, windows

BINS = 1 << 18
ROWS_PER_CLASS = 4000  # labelled rows of each class that a model is fitted on
FOLDED, SPACE = folded_codes(), ascii_space()

SHAPE = np.arange(256, dtype=np.uint8)  # signs stand for themselves
SHAPE[48:58], SHAPE[65:91], SHAPE[97:123], SHAPE[128:] = 48, 65, 97, 97


@dataclass
class Model:
    weights: np.ndarray  # one per bin, ratio and support-vector weight multiplied
    intercept: float
    slope: float  # of the logistic curve
    shift: float


def ngrams(data: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of every n-gram a row holds, each once, in order."""
    starts, ends = runs(~SPACE[data], bounds)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(bounds, starts, "right") - 1
    word = span_hashes(data, starts, ends, FOLDED)
    shape = SHAPE[data]
    turn = np.ones(len(data) + 1, bool)
    turn[1:-1] = shape[1:] != shape[:-1]
    turn[starts] = True
    place = np.concatenate(([0], np.cumsum(turn[:-1])))
    form = span_hashes(shape[turn[:-1]], place[starts], np.maximum(place[ends], place[starts] + 1))
    same = np.concatenate(([False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])))
    form[same] = PRIME
    parts, of = [], []
    with np.errstate(over="ignore"):
        for kind, unit, longest in ((1, word, 2), (2, form, 3)):
            value = mix(unit + np.uint64(kind))
            parts.append(value)
            of.append(row)
            for n in range(1, longest):
                value = mix(value[:-1] * PRIME + unit[n:] + np.uint64(kind))
                whole = row[n:] == row[: len(row) - n]
                parts.append(value[whole])
                of.append(row[n:][whole])
    key = np.unique(np.concatenate(of) * bins + (np.concatenate(parts) & np.uint64(bins - 1)).astype(np.int64))
    return key // bins, key % bins


def learn(sets: list[np.ndarray], y: np.ndarray, prior: float, bins: int = BINS, cost: float = 1.0, rounds: int = 12, smoothing: float = 1.0) -> Model:
    """A model from the rows' n-gram sets and their classes (1 or 0); ``prior`` is the share of 1 to expect.

    With one class only (or no rows) every text gets the prior."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(bins, np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back = np.zeros(len(y), bool)
    held = np.flatnonzero(~back)
    counts = [np.bincount(np.concatenate([sets[i] for i in held[y[held] == c]]), minlength=bins) + smoothing for c in (0, 1)]
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    weights, offset = descend([sets[i] for i in held], ratio, np.where(y[held] == 1, 1.0, -1.0), cost, rounds)
    scaled = weights * ratio
    rows = np.flatnonzero(back) if back.any() else held
    value = np.array([scaled[sets[i]].sum() + offset for i in rows])
    slope, shift = logistic(value, y[rows])
    drawn = y.mean()
    shift += float(np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn)))
    return Model(scaled.astype(np.float32), float(offset), slope, shift)


def descend(sets: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; classes weigh the same in total."""
    weights, offset, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    upper = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    values = [ratio[s] for s in sets]
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (weights[sets[i]] @ values[i] + offset) - 1.0
            to = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (to - alpha[i]) * y[i]
            if step:
                weights[sets[i]] += step * values[i]
                offset += step
                alpha[i] = to
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return weights, offset


def logistic(value: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of P(1) over ``value``, by Newton's method on smoothed targets."""
    scale = max(float(np.std(value)), 1e-9)
    v = value / scale
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * v).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * v * v).sum() + 1e-3, (w * v).sum()], [(w * v).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(max(a, 1e-6) / scale), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, label_col: str = "quality") -> Model:
    """A model from at most ``rows_per_class`` labelled documents of each class, drawn by a hash of their ids.

    Labels that are NULL or neither 0 nor 1 are left out, as are documents that carry both. Of rows
    that repeat a doc_id one is read. The share of 1 among all labelled documents is the prior."""
    y = F.col(label_col).cast("int")
    marked = labels.where(y.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(y).alias("_y"), F.max(y).alias("_top")).where("_y = _top")
    # Labelled ids without text are left out before drawing: ids only, no texts, are shuffled.
    marked = marked.join(docs.select(F.col("doc_id").cast("long").alias("_id")).distinct(), "_id", "left_semi").select("_id", "_y")
    share = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    draws = [marked.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class) for c in (0, 1)]
    drawn = F.broadcast(draws[0].unionByName(draws[1]))  # at most 2 x rows_per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(drawn, "_id")
    # One row per id, whatever repeats: the text with the least hash, chosen on the executors.
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text")).select("_id", "_y", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            for i, j in windows(bounds):
                row, bin_ = ngrams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                sets = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bin_, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), sets], ["id", "y", "bins"])

    found = small_batches(rows).mapInArrow(featured, "id long, y int, bins array<int>").toArrow().combine_chunks()
    numbers, y_all = found.column("id").to_numpy(), found.column("y").to_numpy()
    order = np.argsort(mix(numbers.astype(np.uint64)), kind="stable")
    lists = found.column("bins").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int64)
    total = sum(share.values())
    return learn([flat[at[i] : at[i + 1]] for i in order], y_all[order], share.get(1, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier) of every document, from its whole text alone.

    NULL and empty texts hold no n-gram and get the score of the intercept."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in windows(bounds):
                row, bin_ = ngrams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                value = np.bincount(row, weights=model.weights[bin_], minlength=j - i) + model.intercept
                p = 1 / (1 + np.exp(-np.clip(model.slope * value + model.shift, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p)], ["doc_id", "score"])

    return small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scored, "doc_id long, score double")
