import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm.spelling_variants import LEVELS, checksums, letter_counts, one_edit, reached, spelled, variants


def words_of(docs, shortest=6, least=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, shortest=6, least=5, dominance=5):
    n = words_of(docs, shortest, least)
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= dominance * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else -1) for w in n)


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def corpus(seed, size):
    draw = random.Random(seed)
    base = ["station", "Garden", "éclairé", "mountain", "straße", "ÿellow×", "harbour"]
    docs = []
    for i in range(size):
        out = []
        for _ in range(draw.randint(0, 40)):
            w = draw.choice(base)
            for _ in range(draw.choice([0, 0, 0, 0, 1, 1, 2, 3])):
                at, c = draw.randrange(len(w)), draw.choice("aeé")
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            out.append(w)
        docs.append((i, draw.choice([" ", "-", "\n", "č"]).join(out)))
    return docs


@pytest.mark.parametrize(("seed", "subtree_words", "least"), [(1, 4000, 5), (2, 12, 1), (3, 1, 2)])
def test_equals_brute_force(frame, seed, subtree_words, least):
    docs = corpus(seed, 150) + [(3, "station garden"), (None, "station station"), (500, None), (501, ""), (None, None)]
    found = variants(frame(docs), min_count=least, subtree_words=subtree_words)
    assert rows(found) == brute(docs, least=least)
    assert {r[1] for r in rows(found)} - {""}


def test_chains_long_runs_and_ties(frame):
    long = "abcdefghij" * 3000
    docs = [(1, "longest " * 200 + "longert " * 30 + "lonfert " * 6 + "bongest " * 5 + "longesx " * 40), (2, (long + " ") * 5 + (long[:-1] + " ") * 5)]
    assert rows(variants(frame(docs))) == brute(docs)


def test_no_rows(frame):
    assert variants(frame([(1, "x")]).limit(0)).count() == 0 and variants(frame([(1, None), (2, "1 2 3")])).count() == 0


def test_checksums_are_zlibs():
    spans = [b"", b"a", "é".encode() * 3, b"word", b"x" * 63, b"y" * 64, b"z" * 65, b"q" * 1000]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(spans))], np.uint32)
    assert checksums(data, starts, ends, before).tolist() == [zlib.crc32(f"{i}:".encode() + s) for i, s in enumerate(spans)]


def test_search_reaches_all_near_words_and_few_others():
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("aberst\u00e9\u00f1", k=draw.randint(5, 8))) for _ in range(700)})
    letters, bounds = spelled(pa.array(words))
    counts = letter_counts(letters, bounds)
    order = np.lexsort(counts.T[::-1])
    pairs = {(int(a), int(order[b])) for x, y in reached(counts[order], counts) for a, b in zip(x, y, strict=True)}
    true = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)}
    assert true <= pairs and len(pairs) < len(words) ** 2 / 8 and counts.shape[1] == LEVELS
    a, b = np.array(sorted(pairs)).T
    assert {(i, j) for i, j, ok in zip(a, b, one_edit(letters, bounds, a, b), strict=True) if ok} == true
