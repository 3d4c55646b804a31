"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit, linear over hashed
byte n-grams, predicts that bit of a text's language. Decoding adds up, for every
language, the losses of the classifiers' margins against its codeword, each weighted by how
well that classifier knows that language; the least loss wins. Two languages
with almost the same loss make a text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm._text import free_names, small_batches, text_bytes, windows

BINS = 2048
TRAINING_ROWS = 6000  # labelled texts that a model is fitted on, shared evenly by the languages
UNKNOWN = "und"
AMBIGUOUS_SHARE = 0.05  # how close, relative to the least loss, the next language must be
SHARPNESS = 6.0  # of scores: how fast they approach 1 as losses part

# Letters keep their byte with A-Z and the capitals of U+00C0-U+00DE made small; all else is one separator.
LETTER = np.zeros(256, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bins + 1 x bits; the last row is the intercept
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int) -> np.ndarray:
    """``n`` codewords that differ pairwise in as many bits as possible.

    Up to five languages take every way to part them in two; more take the best of a fixed
    number of random codes of 12 log2(n) bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.vstack([np.ones(len(splits)), *(np.where(splits >> i & 1, -1.0, 1.0) for i in range(n - 1))])
    rng, bits, best = np.random.default_rng(7), int(np.ceil(12 * np.log2(n))), (-1.0, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - (code @ code.T - np.eye(n) * 2 * bits)).min() / 2
        same = np.abs(code.sum(axis=0)).max()  # a bit that is the same for all says nothing
        if same < n and apart > best[0]:
            best = (apart, code)
    return best[1]


def grams(data: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Rows of hashed 1-, 2- and 3-gram frequencies, square-rooted and of length 1 (0 without letters)."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
    code = LETTER[data]
    code[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)] += 0x20
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])  # one separator for a run of them
    code, row = code[keep], row[keep]
    out = np.zeros((rows, bins), np.float32)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        whole = row[n - 1 :] == row[: len(row) - n + 1]
        value = np.full(len(code) - n + 1, n, np.uint32)
        for i in range(n):
            value = (value ^ code[i : len(code) - n + 1 + i]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
        whole &= (code[: len(whole)] != 0) | (n > 1)
        flat = row[: len(whole)][whole] * bins + (value[whole] % np.uint32(bins))
        out += np.bincount(flat, minlength=rows * bins).reshape(rows, bins)
    np.sqrt(out, out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def learn(x: np.ndarray, y: np.ndarray, languages: list[str], ridge: float = 0.1) -> Model:
    """Ridge-regressed bit classifiers on rows ``x`` whose language numbers are ``y``, every language weighing the same."""
    codes = codewords(len(languages))
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    size = x.shape[1] + 1
    gram, aim = np.zeros((size, size)), np.zeros((size, codes.shape[1]))
    np.fill_diagonal(gram, ridge * 1e-2)
    blocks = [slice(i, i + 500) for i in range(0, len(x), 500)]
    for block in blocks:  # rows stay small floats; only a block of them is widened at a time
        x1 = np.hstack([x[block], np.ones((len(x[block]), 1))]).astype(np.float64)
        weighted = x1 * share[y[block], None]
        for i in range(0, size, 256):  # in strips, so that there is one matrix of this size and never two
            gram[i : i + 256] += x1[:, i : i + 256].T @ weighted
        aim += weighted.T @ codes[y[block]]
    weights = np.linalg.solve(gram, aim)
    right = np.concatenate([np.sign(x[b].astype(np.float64) @ weights[:-1] + weights[-1]) == codes[y[b]] for b in blocks]).astype(float)
    trust = np.array([right[y == i].mean(axis=0) if (y == i).any() else np.zeros(codes.shape[1]) for i in range(len(languages))]).reshape(codes.shape)
    trust = np.maximum(trust, 1e-3)
    return Model(languages, codes, weights.astype(np.float32), trust / trust.sum(axis=1, keepdims=True))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword's language, score from 0 to 1, and whether the next is nearly as near."""
    margin = x @ model.weights[:-1] + model.weights[-1]
    loss = np.stack([(np.log1p(np.exp(-2 * margin * code)) * trust).sum(axis=1) for code, trust in zip(model.codes, model.trust, strict=True)], axis=1)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    least = loss[np.arange(len(x)), best]
    near = np.exp(-SHARPNESS * (loss - least[:, None]))
    score = 1 / near.sum(axis=1)
    if loss.shape[1] > 1:
        second = loss[np.arange(len(x)), order[:, 1]]
        ambiguous = second - least < AMBIGUOUS_SHARE * least
    else:
        ambiguous = np.zeros(len(x), bool)
    return best, score, ambiguous


def _has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, training_rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``training_rows`` documents with a language and a letter, drawn by a hash of their ids.

    Every language gets an equal share of the rows. Ids are drawn first; only the texts drawn are
    then fetched, whole. Of rows that repeat an id one is used; rows without an id are not."""
    usable = docs.where(F.col(lang_col).isNotNull() & _has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("_id"))
    languages = sorted(r["lang"] for r in usable.select("lang").distinct().collect())  # as many rows as languages
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BINS + 1, 1), np.float32), np.ones((0, 1)))
    each = max(1, training_rows // len(languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    ids = usable.where("_id IS NOT NULL").select("lang", "_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    drawn = usable.join(F.broadcast(ids.select("lang", "_id")), ["lang", "_id"])  # at most training_rows ids

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in windows(bounds, rows=256):
                x = grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(i, j - i)], ["lang", "x", "id"]
                )

    rows = small_batches(drawn).select("lang", "text", "_id").mapInArrow(featured, "lang string, x binary, id long").dropDuplicates(["lang", "id"]).toArrow()
    y = np.array([languages.index(v) for v in rows.column("lang").to_pylist()])
    order = np.lexsort((rows.column("id").to_numpy(), y))
    x = feature_rows(rows.column("x"), order)
    del rows  # the driver holds the features once
    return learn(x, y[order], languages)


def feature_rows(column: pa.ChunkedArray, order: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The rows of a column of half floats as a matrix, in ``order``, without a copy of each row by itself."""
    place, at = np.empty(len(order), np.int64), 0
    place[order] = np.arange(len(order))
    out = np.empty((len(order), bins), np.float16)
    for chunk in column.chunks:
        if len(chunk):
            first = np.frombuffer(chunk.buffers()[1], np.int32, count=chunk.offset + 1)[chunk.offset]
            out[place[at : at + len(chunk)]] = np.frombuffer(chunk.buffers()[2], np.float16, len(chunk) * bins, int(first)).reshape(-1, bins)
        at += len(chunk)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every document.

    Only the text is looked at, the whole of it. NULL, empty and letterless texts, and all texts under a model
    that met no language, are ``und`` with score 0. Equal losses go to the language first in order."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in windows(bounds, rows=256):
                known = np.asarray(batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False), bool)
                names, score, ambiguous = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.zeros(j - i, bool)
                if known.any() and model.languages:
                    best, sure, near = decode(model, grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                    names[known] = np.array(model.languages, object)[best[known]]
                    score[known], ambiguous[known] = sure[known], near[known]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)], ["doc_id", "lang_pred", "score", "ambiguous"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", _has_letter())
    return small_batches(rows).mapInArrow(predicted, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is known and not ambiguous, with all their columns.

    A model that met no language knows none, so nothing is accepted by it."""
    at, names = docs.columns.index(text_col), docs.columns

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(at))
            keep = np.asarray(batch.column(len(names)).to_numpy(zero_copy_only=False), bool) & bool(model.languages)
            if model.languages:
                for i, j in windows(bounds, rows=256):
                    _, _, ambiguous = decode(model, grams(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                    keep[i:j] &= ~ambiguous
            yield batch.select(range(len(names))).filter(pa.array(keep))

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(free_names(names, "letters")[0])
    return small_batches(docs).select(*names, letters).mapInArrow(filtered, docs.schema)
