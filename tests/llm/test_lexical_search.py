import math
import re
from collections import Counter

import pytest

from inkwell.llm.lexical_search import search

WORDS = "the of and to in a is it rain snow wind hail storm sun moon star sea lake Été ÉTÉ x1 7".split()


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(items, docs, k):
    """(item_id, rank, doc_id, score) as the definition says it."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in sorted(set(terms(text))) if df[t]]
        scores = []
        for key, (doc, c) in enumerate(held):
            m = 100 - 90 + 90 * c.total() * n_docs // total
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, key, doc))
        out += [(item, r, s[4], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return out


def made(n, seed):
    import random

    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS, weights=[40, 30, 25, 20, 15, 12, 9, 7] + [1] * (len(WORDS) - 8), k=draw.randint(1, 30)))) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize(("k", "block", "shares", "prefilter"), [(10, 4096, (1 / 256, 1 / 32, 1 / 8), 1 << 20), (3, 7, (0.05, 0.2, 0.5, 0.8), 0), (1, 16, (), 0)])
def test_equals_brute_force(spark, frame, k, block, shares, prefilter):
    docs = made(120, 1) + [(200 + i, "the storm of hail") for i in range(40)] + [(5, "snow snow x1"), (None, "hail"), (None, None), (301, ""), (302, "?! --")]
    items = [(1, "Hail, storm & the sea!"), (2, "the of and"), (3, None), (4, ""), (5, "unknown words"), (1, "été snow"), (None, "moon ÉTÉ 7")]
    asked = frame(items).withColumnRenamed("doc_id", "item_id")
    found = search(asked, frame(docs), k, block_docs=block, shares=shares, prefilter=prefilter)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(brute(items, docs, k), key=order)


def test_copies_tie_by_id_and_long_texts_are_whole(spark, frame):
    docs = [(i, "rain on the sea") for i in range(50, 0, -1)] + [(99, "dust " * 30_000 + "rain")] + [(60 + i, "other words here") for i in range(9)]
    found = rows(search(frame([(1, "rain dust")]).withColumnRenamed("doc_id", "item_id"), frame(docs), 5, block_docs=8))
    assert found == sorted(brute([(1, "rain dust")], docs, 5)) and found[0][2] == 99 and [r[2] for r in found[1:]] == [1, 2, 3, 4]


def test_empty_tables(spark, frame):
    items, docs = frame([(1, "rain")]).withColumnRenamed("doc_id", "item_id"), frame([(1, "rain"), (2, "snow")])
    assert search(items.limit(0), docs).count() == 0 and search(items, docs.limit(0)).count() == 0
    assert search(items, docs).columns == ["item_id", "rank", "doc_id", "score"]
