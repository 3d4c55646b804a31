import random
import re
from collections import Counter

import numpy as np
import pytest

from inkwell.llm.jaccard_join import Bands, components, join, representatives
from inkwell.llm.queries import QUERIES


def brute(texts, words, num, den):
    """(number of shingles, smallest linked id) per id, by counting common shingles of all pairs that share one."""
    sets = {}
    for i, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset([tuple(w)]) if 0 < len(w) < words else frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1))
    holders, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def result(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2), (19, 20)])
def test_bands_hold_every_similar_pair(num, den):
    bands = Bands(num, den, 5000)
    for small in range(1, 400):
        for large in range(small, small * den // num + 1):
            a, b = bands.of(np.array([small, large]))
            differ = (small + large) - 2 * -(-num * (small + large) // (num + den))
            assert b - a in (0, 1) and differ <= bands.far[b]
    assert ((bands.segments - bands.need >= bands.far) | bands.near).all()
    assert (2 * bands.segments[bands.near] >= bands.far[bands.near] + 1).all()


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_edited_copies_against_brute_force(frame, words, num, den):
    rng, texts = random.Random(words), []
    for _ in range(14):  # families of edited copies, short and long, that share a passage
        base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([3, 5, 8, 12, 30, 90, 300]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = str(rng.randrange(9))
            texts.append((len(texts), " ".join((["all", "of", "us", "share", "this"] if rng.random() < 0.3 else []) + copy)))
    texts += [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a  B"), (1005, "a"), (1006, "é É"), (1007, "z" * 100_000)]
    assert result(join(frame(texts), words, num, den).collect()) == brute(texts, words, num, den)


def test_chains_and_a_large_group_of_copies(frame):
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(words[i : i + 40])) for i in range(20)]  # neighbours are similar, ends are not
    texts += [(100 + i, "one two three four five six seven") for i in range(60)]
    got = result(join(frame(texts), 4, 85, 100).collect())
    assert got == brute(texts, 4, 85, 100) and len({c for _, c in got.values()}) == 2


def test_repeated_ids_and_no_rows(frame):
    rows = join(frame([(5, "a b c d e"), (5, "a b c d e"), (5, "other words are in here"), (4, "a b c d e")]), 4, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(4, 4), (5, 4), (5, 4), (5, 5)]
    assert join(frame([]), 4, 85, 100).count() == 0


def test_rows_without_an_id_link_and_are_linked_through(frame):
    chain = [" ".join(f"w{j}" for j in range(i, i + 40)) for i in (0, 2, 4)]
    rows = join(frame([(None, chain[1]), (1, chain[0]), (2, chain[2]), (None, "all alone in this corner of it"), (None, "all alone in this corner of it"), (None, None)]), 4, 85, 100).collect()
    key = lambda r: (r is None, r)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=lambda p: (key(p[0]), key(p[1]))) == [(1, 1), (2, 1), (None, 1), (None, None), (None, None), (None, None)]
    assert [r.n_shingles for r in rows if r.component_id is None and r.n_shingles] == [4, 4]


def test_missing_and_repeated_ids_against_brute_force(frame):
    rng, texts = random.Random(8), []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(40)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(40)] = f"x{rng.randrange(5)}"
            texts.append((rng.choice([None, 1, 2, 3, *range(10, 60)]), " ".join(copy)))
    numbered = [(i, t) for i, (_, t) in enumerate(texts)]
    linked = brute(numbered, 4, 4, 5)
    least = {}
    for i, (doc, _) in enumerate(texts):
        root = linked[i][1]
        least[root] = min([x for x in (least.get(root), doc) if x is not None], default=None)
    expected = sorted((str(doc), linked[i][0], str(least[linked[i][1]])) for i, (doc, _) in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join(frame(texts), 4, 4, 5).collect()) == expected
    stays = representatives(frame(texts), 4, 4, 5)
    roots = {t: linked[i][1] for i, (_, t) in enumerate(texts)}
    got = [(roots[r.text], r.doc_id) for r in stays.collect()]
    assert stays.columns == frame(texts).columns and sorted(map(str, got)) == sorted(str((root, doc)) for root, doc in least.items())


def test_one_row_of_each_component_stays(frame):
    a, b = " ".join("abcdefghij"), " ".join("qrstuvwxyz")
    for rows, left in (([(1, a), (2, b), (2, a)], [(1, a), (2, b)]), ([(None, a), (None, a), (None, a), (7, a)], [(7, a)]), ([(None, a), (None, a), (3, None), (3, None), (4, "")], [(3, None), (3, None), (4, ""), (None, a)])):
        assert sorted(((r.doc_id, r.text) for r in representatives(frame(rows)).collect()), key=str) == sorted(left, key=str)
    assert representatives(frame([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}


def test_query_against_brute_force(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert result(QUERIES["op4_jaccard_join"](spark, small).collect()) == brute(texts, 4, 85, 100)
