"""Both trainers against plain loops over single documents, in one block and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import variational
from inkwell.operators import sharded_topics, topics

TEXTS = ["cat dog cat mouse", "dog mouse dog", "sun moon star", "moon star star comet", "cat mouse", "", "sun comet sun moon", "dog cat"] * 6
K, SEED = 3, 4


@pytest.fixture(scope="module")
def tokenized(spark):
    rows = [(None if i % 9 == 4 else i // 2, t.split()) for i, t in enumerate(TEXTS)] + [(99, None)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3).cache()


def documents(spark, tokenized, weighting):
    """(hash, entries (term, weight)) of every document, and every term's hash."""
    rows = [(r.h, r.tokens or []) for r in tokenized.select(F.xxhash64("doc_id", "tokens").alias("h"), "tokens").collect()]
    words = sorted({w for _, t in rows for w in t})
    idf = {w: math.log((len(rows) + 1) / (sum(w in t for _, t in rows) + 1)) if weighting == "tfidf" else 1.0 for w in words}
    hashes = {r.term: r.h for r in spark.createDataFrame([(w,) for w in words], "term string").select("term", F.xxhash64("term").alias("h")).collect()}
    return [(h, [(w, t.count(w) * idf[w]) for w in sorted(set(t))]) for h, t in rows], hashes


def unsigned(x):
    return np.array([x], np.int64).view(np.uint64)


@pytest.mark.parametrize("block_entries, weighting", [(200_000, "count"), (7, "count"), (7, "tfidf")])
def test_em_equals_a_plain_version(spark, tokenized, block_entries, weighting, monkeypatch):
    monkeypatch.setattr(sharded_topics, "WAVE_BLOCKS", 2)
    docs, hashes = documents(spark, tokenized, weighting)
    held = [np.zeros(K) for _ in docs]
    words = {w: np.zeros(K) for w in hashes}
    for d, (h, items) in enumerate(docs):
        for w, n in items:
            x = variational.parted_at_random(np.array([n]), np.zeros(1, np.int64), np.zeros(1, np.int64), unsigned(hashes[w]), unsigned(h), K, SEED)[0][0]
            held[d], words[w] = held[d] + x, words[w] + x
    for _ in range(3):
        total, size = sum(words.values()), len(words)
        now, then = [np.zeros(K) for _ in docs], {w: np.zeros(K) for w in words}
        for d, (_, items) in enumerate(docs):
            for w, n in items:
                p = (words[w] + 0.1) * (held[d] + 50 / K) / (total + 0.1 * size)
                now[d], then[w] = now[d] + n * p / p.sum(), then[w] + n * p / p.sum()
        held, words = now, then
    model = topics.fit_topics(tokenized, K, weighting, max_iter=3, seed=SEED, block_entries=block_entries)
    got = {r.term: r.weights for r in model.stages[-1].topics.collect()}
    assert got.keys() == words.keys() and all(np.allclose(got[w], words[w], rtol=1e-6, atol=1e-9) for w in words)
    assert np.allclose(model.stages[-1].totals, sum(words.values()), rtol=1e-6) and model.stages[-1].alpha == 50 / K + 1
    counted = {w: sum(n for _, items in docs for v, n in items if v == w) for w in words}
    if weighting == "count":
        assert model.stages[0].vocabulary == sorted(words, key=lambda w: (-counted[w], w))


@pytest.mark.parametrize("block_entries", [None, 7])
def test_online_equals_a_plain_version(spark, tokenized, block_entries, monkeypatch):
    monkeypatch.setattr(topics, "BATCH_SHARE", 0.3)
    docs, hashes = documents(spark, tokenized, "count")
    start = spark.createDataFrame([(w,) for w in hashes], "term string").select("term", sharded_topics.initial_weights(K, SEED).alias("x")).collect()
    words, alpha, eta, done = {r.term: np.array(r.x) for r in start}, np.full(K, 1 / K), 1 / K, 0
    hashed = spark.createDataFrame([(h,) for h, _ in docs], "h long").select(topics._drawn(4, SEED).alias("t")).collect()
    for t in range(4):
        batch = [items for (_, items), r in zip(docs, hashed, strict=True) for _ in range(r.t.count(t)) if items]
        if not batch:
            continue
        done += 1
        rho, total, added, mean = (1024 + done) ** -0.51, sum(words.values()), {w: np.zeros(K) for w in words}, np.zeros(K)
        for items in batch:
            n = np.array([c for _, c in items])
            factors = variational.topic_factors(np.array([words[w] for w, _ in items]), total)
            gamma = variational.mixtures(n, np.zeros(1, np.int64), np.arange(len(n)), factors, alpha)
            mean += (variational.digamma(gamma[0]) - variational.digamma(gamma[0].sum())) / len(batch)
            for (w, _), x in zip(items, variational.statistics(gamma, n, np.zeros(1, np.int64), np.arange(len(n)), factors, len(n)), strict=True):
                added[w] += x
        scale = len(docs) / math.ceil(0.3 * len(docs))
        words = {w: (1 - rho) * x + rho * (eta + scale * added[w]) for w, x in words.items()}
        alpha = topics._alpha(alpha, mean, len(batch), rho)
    assert done >= 2
    model = topics.fit_topics(tokenized, K, optimizer="online", max_iter=4, seed=SEED, block_entries=block_entries)
    got = {r.term: r.weights for r in model.stages[-1].topics.collect()}
    assert got.keys() == words.keys() and all(np.allclose(got[w], words[w], rtol=1e-6) for w in words)
    assert np.allclose(model.stages[-1].alpha, alpha, rtol=1e-6)


def test_vocabularies_are_cut_only_when_asked(tokenized):
    model = topics.fit_topics(tokenized, 2, max_iter=1, vocab_size=2, min_df=2)
    assert model.stages[0].vocabulary == ["cat", "dog"] or len(model.stages[0].vocabulary) == 2
    rows = topics.assign_topics(model, tokenized).collect()
    assert len(rows) == len(TEXTS) + 1 and sum(r.topic_num is None for r in rows) > 7


def test_trigamma():
    assert np.allclose(variational.trigamma(np.array([1.0, 0.5, 3.0])), [np.pi**2 / 6, np.pi**2 / 2, np.pi**2 / 6 - 1.25], atol=1e-10)
