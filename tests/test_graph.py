import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import graph, tokens


def dense_pagerank(weights, alpha=0.85, max_iter=100, tol=1e-6):
    n = len(weights)
    out = weights.sum(axis=1)
    step = np.divide(weights, out[:, None], out=np.zeros_like(weights), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(max_iter):
        last = x
        x = alpha * (last @ step + last[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            break
    return x


def similarity(a, b):
    shared = len(set(a) & set(b))
    bottom = (np.log(len(a)) + np.log(len(b))) if shared else 0
    return shared / bottom if bottom > 1e-12 else 0.0


def sentence_weights(lists):
    return np.array([[similarity(a, b) for b in lists] for a in lists])


def word_weights(vertices, edges, window):
    order = list(dict.fromkeys(w for words in vertices for w in words))
    weights = np.zeros((len(order), len(order)))
    for words in edges:
        for i, a in enumerate(words):
            for b in words[i + 1 : i + max(window, 2)]:
                if a in order and b in order:
                    weights[order.index(a), order.index(b)] = weights[order.index(b), order.index(a)] = 1.0
    return order, weights


def random_lists(rng, sentences, words, vocabulary):
    return [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(words))] for _ in range(sentences)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs = {i: random_lists(rng, rng.randrange(1, 12), 9, rng.choice([3, 8, 40])) for i in range(40)}
    docs[40] = [["x"], ["x"], ["x", "y"]]
    docs[41] = [[], []]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, words array<array<string>>")
    return docs, df.repartition(4).cache()


GOLDEN = {
    "abc.bcd.x": [0.465116, 0.465116, 0.069767],
    "ab.bcd.defg.z": [0.307292, 0.349744, 0.295344, 0.047619],
}


@pytest.mark.parametrize("key", GOLDEN)
def test_golden_scores(spark, key):
    from inkwell.functions import kernels

    lists = [list(part) for part in key.split(".")]
    df = spark.createDataFrame([(1, lists)], "doc_id long, words array<array<string>>")
    rank = kernels.sentence_ranker(max_iter=500, tol=1e-12)
    assert df.select(rank("words").alias("s")).first()["s"] == pytest.approx(GOLDEN[key], abs=1e-6)
    assert dense_pagerank(sentence_weights(lists), tol=1e-12, max_iter=500) == pytest.approx(GOLDEN[key], abs=1e-6)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("abc", "bcd", 0.910239), ("aab", "abb", 0.910239), ("ab", "cd", 0), ("x", "x", 0), ("ab", "bcd", 0.558111), ("", "ab", 0)],
)
def test_golden_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(1, [list(a), list(b)])], "doc_id long, words array<array<string>>")
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.sentence_graph_edges(df).collect()}
    assert edges.get((0, 1), 0) == pytest.approx(expected, abs=1e-6)


def test_edges_match_brute_force(corpus):
    docs, df = corpus
    got = {(r["doc_id"], r["src"], r["dst"]): r["weight"] for r in graph.sentence_graph_edges(df).collect()}
    want = {}
    for doc, lists in docs.items():
        weights = sentence_weights(lists)
        for i, j in zip(*np.nonzero(np.triu(weights))):
            want[doc, i, j] = weights[i, j]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize(("max_iter", "tol"), [(30, 0), (100, 1e-6), (100, 1e-3)])
def test_kernel_matches_dense_pagerank(corpus, max_iter, tol):
    from inkwell.functions import kernels

    docs, df = corpus
    rank = kernels.sentence_ranker(max_iter=max_iter, tol=tol)
    for row in df.select("doc_id", rank("words").alias("s")).collect():
        want = dense_pagerank(sentence_weights(docs[row["doc_id"]]), max_iter=max_iter, tol=tol)
        assert row["s"] == pytest.approx(list(want), abs=1e-12)


def test_personal_vectors_match_dense_pagerank(corpus):
    from inkwell.functions import kernels

    docs, df = corpus
    rank = kernels.personal_sentence_ranker(max_iter=60, tol=0)
    given = df.withColumn("t", F.transform("words", lambda w, i: (i % 3).cast("double"))).withColumn("d", F.transform("words", lambda w: F.size(w).cast("double"))).withColumn("s", F.lit(None).cast("array<double>"))
    for row in given.select("doc_id", rank("words", "t", "d", "s").alias("mine"), rank("words", "s", "s", "t").alias("even")).collect():
        weights = sentence_weights(docs[row["doc_id"]])
        n = len(weights)
        scale = lambda v: np.array(v, float) / sum(v) if sum(v) else np.full(n, 1 / n)
        out = weights.sum(axis=1) if n else np.zeros(0)
        step = np.divide(weights, out[:, None], out=np.zeros_like(weights), where=out[:, None] > 0) if n else weights
        x, p, d = np.full(n, 1 / n) if n else out, scale([i % 3 for i in range(n)]) if n else out, scale([len(w) for w in docs[row["doc_id"]]]) if n else out
        y = p
        for _ in range(60 if n else 0):
            x = 0.85 * (x @ step + x[out == 0].sum() * d) + 0.15 * p
            y = 0.85 * (y @ step + y[out == 0].sum() / n) + 0.15 / n
        assert row["mine"] == pytest.approx(list(x), abs=1e-12) and row["even"] == pytest.approx(list(y), abs=1e-12)


def test_kernel_chunks_do_not_matter(corpus, monkeypatch):
    import pyarrow as pa

    from inkwell.functions import kernels

    docs, _ = corpus
    words = pa.array([docs[k] for k in sorted(docs)] + [None], pa.list_(pa.list_(pa.string())))
    whole = kernels.sentence_ranker(tol=0, max_iter=20).func(words)
    whole_words = kernels.word_ranker(tol=0, max_iter=20).func(words, words)
    monkeypatch.setattr(kernels, "CHUNK_TOKENS", 7)
    assert kernels._chunks(np.array([5, 5, 5, 0, 5])) == [(0, 2), (2, 3), (3, 5)]
    for part, all_at_once in [
        (kernels.sentence_ranker(tol=0, max_iter=20).func(words), whole),
        (kernels.word_ranker(tol=0, max_iter=20).func(words, words), whole_words),
    ]:
        assert [len(x) for x in part.to_pylist()] == [len(x) for x in all_at_once.to_pylist()]
        flat = [y for x in part.to_pylist() for y in x]
        assert flat == pytest.approx([y for x in all_at_once.to_pylist() for y in x])


@pytest.mark.parametrize(("max_iter", "tol", "shard_rows"), [(4, 0, 3), (8, 0.01, 4), (8, 0.01, 2_000_000)])
def test_distributed_pagerank_with_and_without_hubs(corpus, max_iter, tol, shard_rows):
    docs, df = corpus
    few = df.where("doc_id >= 30")
    nodes, links = graph.sentence_graph(few)
    got = {}
    for row in graph.pagerank(nodes, links, max_iter=max_iter, tol=tol, shard_rows=shard_rows).collect():
        got.setdefault(row["graph"], {})[row["node"]] = row["score"]
    for doc in range(30, 42):
        want = dense_pagerank(sentence_weights(docs[doc]), max_iter=max_iter, tol=tol)
        assert [got[doc][i] for i in range(len(want))] == pytest.approx(list(want), abs=1e-12)


@pytest.mark.parametrize("window", [1, 2, 4])
def test_word_ranking_matches_brute_force(corpus, window):
    docs, df = corpus
    both = df.withColumn("vertices", F.transform("words", lambda s: F.filter(s, lambda w: ~w.isin("w1", "w2"))))
    rows = graph.score_words(both, "vertices", "words", window).collect()
    got = {(r["doc_id"], r["word"]): (r["weight"], r["rank"]) for r in rows}
    edges = {}
    for r in tokens.word_graph_edges(both, "vertices", "words", window).collect():
        edges.setdefault(r["doc_id"], set()).add((r["w1"], r["w2"]))
    for doc, lists in docs.items():
        vertices = [[w for w in words if w not in ("w1", "w2")] for words in lists]
        order, weights = word_weights(vertices, lists, window)
        assert edges.get(doc, set()) == {(order[i], order[j]) for i, j in zip(*np.nonzero(weights))}
        want = dense_pagerank(weights) if order else []
        for word, score in zip(order, want):
            assert got[doc, word][0] == pytest.approx(score, abs=1e-12)
        by_rank = sorted(range(len(order)), key=lambda i: (-round(want[i], 9), i))
        assert [got[doc, order[i]][1] for i in by_rank] == list(range(1, len(order) + 1))
    assert len(rows) == sum(len({w for s in lists for w in s} - {"w1", "w2"}) for lists in docs.values())


def test_summary_skips_short_sentences_and_keeps_rank_order(spark):
    from inkwell.plans.summaries import key_sentences, summaries

    docs = spark.createDataFrame(
        [(1, "ab cd! alpha beta gamma; alpha beta delta? alpha epsilon zeta; lone words here"), (2, "")],
        "doc_id long, content string",
    )
    html = {r["doc_id"]: r["html"] for r in summaries(docs).collect()}
    # The sentence that shares nothing keeps its own weight through its self-loop.
    assert html[1] == ["alpha beta gamma", "alpha beta delta", "lone words here"]
    assert html[2] == []
    ranks = key_sentences(docs, num=9, min_length=1).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == [1, 2, 3, 4, 5]
    assert "Exchange" not in summaries(docs)._jdf.queryExecution().executedPlan().toString()


def test_segmented_summaries(spark):
    from inkwell.functions import han
    from inkwell.plans.summaries import summaries

    lexicon = spark.createDataFrame([("城市", "n"), ("轨道", "n"), ("交通", "v"), ("的", "uj")], "word string, tag string")
    docs = spark.createDataFrame([(1, "城市轨道交通建设。的的的的的的。城市的轨道交通规划！")], "doc_id long, content string")
    got = summaries(docs, num=2, segment=han.segmenter(lexicon)).first()["html"]
    assert got == ["城市轨道交通建设", "城市的轨道交通规划"]


@pytest.mark.parametrize(("max_iter", "tol"), [(4, 0), (20, 1e-2)])
def test_graphs_ranked_in_a_task_and_by_rounds_agree(spark, max_iter, tol):
    """Many small graphs, nodes without links, rows that repeat and links that lead nowhere; one, some or no graph in a task."""
    rng = np.random.default_rng(11)
    nodes, links = [], []
    for g in range(8):
        nodes += [(g, f"n{i}") for i in range(g + 2)] + ([(g, "n0")] if g % 3 == 0 else [])
        pairs = {tuple(sorted(rng.integers(0, g + 1, 2).tolist())) for _ in range(2 * g)}
        links += [(g, f"n{x}", f"n{y}", float(a + b + 1)) for a, b in pairs for x, y in {(a, b), (b, a)}]
    links += [(3, "n0", None, 1.0), (99, "n0", "n1", 1.0)]
    nodes = spark.createDataFrame([*nodes, (None, "n0"), (2, None)], "graph int, node string")
    links = spark.createDataFrame(links, "graph int, src string, dst string, weight double")
    found = []
    for whole in (500_000, 12, 0):
        rows = graph.pagerank(nodes, links, max_iter=max_iter, tol=tol, whole_links=whole).collect()
        found.append(sorted(((r["graph"], r["node"] or "", r["score"]) for r in rows)))
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]] == [r[:2] for r in found[2]]
    for other in found[1:]:
        assert [r[2] for r in found[0]] == pytest.approx([r[2] for r in other], abs=1e-12)
