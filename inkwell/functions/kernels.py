"""Arrow kernels: graph ranking of a document's sentences or words, and nearest vectors.

Each kernel is a column function or a group function that Spark feeds with Arrow
batches. A batch holds many documents; they are ranked together as one graph made of
separate parts, so the numpy calls are few and long rather than one set per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

CHUNK_TOKENS = 200_000


def shares(values, graph, n_graphs):
    """Non-negative values scaled to sum 1 within each part; even where a part has none. Missing ones count as 0."""
    values = np.nan_to_num(np.maximum(values, 0.0), nan=0.0, posinf=0.0)
    total = np.bincount(graph, weights=values, minlength=n_graphs)[graph]
    size = np.bincount(graph, minlength=n_graphs)[graph]
    return np.where(total > 0, np.divide(values, total, out=np.zeros_like(values), where=total > 0), 1.0 / size)


def power_iteration(step, out_weight, graph, n_graphs, alpha, max_iter, tol, teleport=None, dangling_to=None, start=None):
    """PageRank of many separate undirected graphs at once.

    ``step(v)`` multiplies by the symmetric weight matrix; ``graph`` numbers the part
    each node belongs to. ``teleport`` says where a jump lands, ``dangling_to`` where the mass of
    nodes without links goes (where jumps land, unless given), ``start`` the scores before the first round; all sum to 1 within
    a part, and are even unless given. A part stops when its L1 change is below ``tol`` times its node count.
    """
    nodes = np.bincount(graph, minlength=n_graphs)
    size = nodes[graph].astype(float)
    dangling = out_weight == 0
    share = np.divide(1.0, out_weight, out=np.zeros_like(out_weight), where=~dangling)
    teleport = 1.0 / size if teleport is None else teleport
    dangling_to = teleport if dangling_to is None else dangling_to
    score = 1.0 / size if start is None else start
    running = nodes > 0
    for _ in range(max_iter):
        loose = np.bincount(graph, weights=score * dangling, minlength=n_graphs)
        moved = alpha * (step(score * share) + loose[graph] * dangling_to) + (1 - alpha) * teleport
        change = np.bincount(graph, weights=np.abs(moved - score), minlength=n_graphs)
        score = np.where(running[graph], moved, score)
        running &= change >= nodes * tol
        if not running.any():
            break
    return score


def all_with_all(group_sizes):
    """Row pairs (i, j) within consecutive groups of the given sizes."""
    start = np.cumsum(group_sizes) - group_sizes
    left = np.repeat(np.arange(group_sizes.sum()), np.repeat(group_sizes, group_sizes))
    offset = np.arange(left.size) - np.repeat(np.cumsum(group_sizes**2) - group_sizes**2, group_sizes**2)
    right = np.repeat(start, group_sizes**2) + offset % np.repeat(group_sizes, group_sizes**2)
    return left, right


def shared_word_counts(batches, block_links=2_000_000):
    """Sentence pairs of each row's document that share words: (id, src, dst, n_a, n_b, shared), src <= dst.

    Takes batches of (id, words array<array<string>>). A repeated word counts once; n_a and n_b are
    the sentences' lengths with repeats. Links are counted for as many sources at a time as have
    about ``block_links`` shared words, or for one source.
    """
    names = ["doc_id", "src", "dst", "n_a", "n_b", "shared"]
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column(1).slice(row, 1).flatten()
            if not len(words):
                continue
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            sentence = np.repeat(np.arange(len(n)), n)
            code = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.unique(sentence * (code.max(initial=0) + 1) + code)
            sentence, code = held // (code.max(initial=0) + 1), held % (code.max(initial=0) + 1)
            order = np.argsort(code, kind="stable")  # per word, its sentences in order
            by_word, first = sentence[order], np.searchsorted(code[order], np.arange(code.max(initial=0) + 2))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            later = first[code + 1] - place  # this sentence and those after it that hold the word
            total = np.concatenate(([0], np.cumsum(later)))
            begin = 0
            while begin < len(sentence):
                end = int(np.searchsorted(total, total[begin] + block_links, "right")) - 1
                end = int(np.searchsorted(sentence, sentence[min(max(end, begin), len(sentence) - 1)], "left"))
                if end <= begin:
                    end = int(np.searchsorted(sentence, sentence[begin], "right"))
                links = later[begin:end]
                at = np.repeat(place[begin:end] - (np.cumsum(links) - links), links) + np.arange(links.sum())
                pair, shared = np.unique(np.repeat(sentence[begin:end], links) * len(n) + by_word[at], return_counts=True)
                src, dst = pair // len(n), pair % len(n)
                ids = batch.column(0).take(pa.array(np.full(len(pair), row)))
                columns = [pa.array(x.astype(np.int32)) for x in (src, dst, n[src], n[dst])]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(shared)], names)
                begin = end


def term_counts(batches, rows_out=100_000):
    """Each row's distinct terms and how often it holds them: (id, term, tf), for batches of (id, terms array<string>).

    NULL terms are left out. Rows of about ``CHUNK_TOKENS`` terms are counted together, or one row."""
    for batch in batches:
        column = batch.column(1)
        for start, stop in _chunks(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
            part = column.slice(start, stop - start)
            size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = part.flatten()
            row, named = np.repeat(np.arange(start, stop), size), terms.is_valid().to_numpy(zero_copy_only=False)
            coded = terms.drop_null().dictionary_encode()
            n_codes = max(len(coded.dictionary), 1)
            held, tf = np.unique(row[named] * n_codes + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            for i in range(0, len(held), rows_out):
                some = held[i : i + rows_out]
                columns = [batch.column(0).take(pa.array(some // n_codes)), coded.dictionary.take(pa.array(some % n_codes)), pa.array(tf[i : i + rows_out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "term", "tf"])


def term_lists(batches):
    """Batches of (..., tokens array<string>) with ``tokens`` replaced by each row's distinct terms and how often it holds them: (..., terms, n).

    NULL tokens are left out; a row without tokens has empty lists."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for start, stop in _chunks(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
            part = column.slice(start, stop - start)
            size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = part.flatten()
            row, named = np.repeat(np.arange(stop - start), size), terms.is_valid().to_numpy(zero_copy_only=False)
            coded = terms.drop_null().dictionary_encode()
            n_codes = max(len(coded.dictionary), 1)
            held, n = np.unique(row[named] * n_codes + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            first = pa.array(np.searchsorted(held, np.arange(stop - start + 1) * n_codes), pa.int32())
            lists = [pa.ListArray.from_arrays(first, coded.dictionary.take(pa.array(held % n_codes))), pa.ListArray.from_arrays(first, pa.array(n, pa.int32()))]
            names = [*batch.schema.names[:-1], "terms", "n"]
            yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[:-1]), *lists], names)


def sentence_scores(codes, lengths, sentence_doc, n_docs, alpha, max_iter, tol, vectors=()):
    """Scores of sentences linked by shared words / (ln length + ln length).

    The sentence graph is never laid out. A link's denominator depends only on the two
    lengths, so one product with the weight matrix is: per (word, length) add up the
    scores of its sentences, mix the lengths of each word, and add up per sentence.
    Work and memory follow the number of words, not the number of sentence pairs.
    """
    n = lengths.size
    sentence_of_word = np.repeat(np.arange(n), lengths)
    n_codes = int(codes.max()) + 1 if codes.size else 1
    distinct = np.unique(sentence_of_word * n_codes + codes)
    sentence, code = distinct // n_codes, distinct % n_codes
    longest = int(lengths.max()) + 1 if n else 1
    word = sentence_doc[sentence] * n_codes + code
    pairs, pair = np.unique(word * longest + lengths[sentence], return_inverse=True)
    pair_length = pairs % longest
    _, group_sizes = np.unique(pairs // longest, return_counts=True)
    row, col = all_with_all(group_sizes)
    log_length = np.log(np.maximum(pair_length, 1))
    bottom = log_length[row] + log_length[col]
    mix = np.divide(1.0, bottom, out=np.zeros_like(bottom), where=bottom >= 1e-12)

    def step(v):
        by_pair = np.bincount(pair, weights=v[sentence], minlength=pairs.size)
        mixed = np.bincount(row, weights=mix * by_pair[col], minlength=pairs.size)
        return np.bincount(sentence, weights=mixed[pair], minlength=n)

    return power_iteration(step, step(np.ones(n)), sentence_doc, n_docs, alpha, max_iter, tol, *vectors)


def first_seen(doc, codes, n_codes):
    """Number each document's distinct codes by first appearance: sorted keys, their ids, owners."""
    keys, first = np.unique(doc * n_codes + codes, return_index=True)
    ids = np.empty(keys.size, dtype=np.int64)
    ids[np.argsort(first, kind="stable")] = np.arange(keys.size)
    owner = np.empty(keys.size, dtype=np.int64)
    owner[ids] = keys // n_codes
    return keys, ids, owner


def word_scores(vertex, vertex_doc, edge, edge_sentence, edge_doc, window, n_docs, alpha, max_iter, tol):
    """Scores of the vertex words, linked 0/1 when within ``window`` of each other in an edge list."""
    n_codes = int(max(vertex.max(initial=0), edge.max(initial=0))) + 1
    keys, ids, owner = first_seen(vertex_doc, vertex, n_codes)
    n = keys.size
    edge_key = edge_doc * n_codes + edge
    at = np.minimum(np.searchsorted(keys, edge_key), max(n - 1, 0))
    known = keys[at] == edge_key if n else np.zeros(edge.size, dtype=bool)
    node = ids[at] if n else at
    links = []
    for distance in range(1, max(window, 2)):
        near = slice(None, -distance)
        far = slice(distance, None)
        both = (edge_sentence[near] == edge_sentence[far]) & known[near] & known[far]
        a, b = node[near][both], node[far][both]
        links += [a * n + b, b * n + a]
    link = np.unique(np.concatenate(links)) if n else np.zeros(0, dtype=np.int64)
    src, dst = (link // n, link % n) if n else (link, link)

    def step(v):
        return np.bincount(dst, weights=v[src], minlength=n)

    return owner, power_iteration(step, step(np.ones(n)), owner, n_docs, alpha, max_iter, tol)


def _nested(column):
    """``array<array<string>>`` as flat strings, words per sentence, sentences per document."""
    per_doc = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = column.flatten()
    per_sentence = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.flatten(), per_sentence, per_doc


def _codes(words):
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(values, per_doc):
    offsets = np.concatenate([[0], np.cumsum(per_doc)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))


def _chunks(tokens_per_doc):
    """Document ranges of about ``CHUNK_TOKENS`` tokens, which bounds the working memory."""
    part = (np.cumsum(tokens_per_doc) - tokens_per_doc) // CHUNK_TOKENS
    edges = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *edges], [*edges, len(tokens_per_doc)]))


def _tokens_per_doc(per_sentence, per_doc):
    ends = np.concatenate([[0], np.cumsum(per_sentence)])
    return np.diff(ends[np.concatenate([[0], np.cumsum(per_doc)])])


def column_kernel(returns):
    """An Arrow UDF the optimizer leaves where it is.

    Declared non-deterministic only so that filters and projections on its result are
    never rewritten into second calls of it; the kernels themselves are deterministic.
    """

    def declare(function):
        return arrow_udf(function, returnType=returns).asNondeterministic()

    return declare


def on_columns(kernel, *names):
    """``kernel`` on named columns, NULL for a NULL first column.

    Naming a column twice keeps the optimizer from folding the expression behind it into
    the kernel call, so the kernel's input is computed once, in the step below.
    """
    return F.when(F.size(names[0]) >= 0, kernel(*names))


def sentence_ranker(alpha=0.85, max_iter=100, tol=1e-6):
    """Column function: word lists of a document's sentences -> score of each sentence."""

    @column_kernel("array<double>")
    def rank(words: pa.Array) -> pa.Array:
        flat, _, all_per_doc = _nested(words)
        results = []
        for start, stop in _chunks(_tokens_per_doc(_nested(words)[1], all_per_doc)):
            flat, lengths, per_doc = _nested(words.slice(start, stop - start))
            sentence_doc = np.repeat(np.arange(per_doc.size), per_doc)
            if sentence_doc.size:
                results.append(
                    sentence_scores(
                        _codes(flat), lengths, sentence_doc, per_doc.size, alpha, max_iter, tol
                    )
                )
        return _as_lists(np.concatenate(results) if results else np.zeros(0), all_per_doc)

    return rank


def personal_sentence_ranker(alpha=0.85, max_iter=100, tol=1e-6):
    """As ``sentence_ranker``, with three more columns: each sentence's teleport, dangling and start weights, or NULL for none.

    Weights are scaled to sum 1 over a document; a sentence past the end of its list has weight 0."""

    @column_kernel("array<double>")
    def rank(words: pa.Array, teleport: pa.Array, dangling: pa.Array, start: pa.Array) -> pa.Array:
        _, lengths_, all_per_doc = _nested(words)
        results = []
        for begin, stop in _chunks(_tokens_per_doc(lengths_, all_per_doc)):
            flat, lengths, per_doc = _nested(words.slice(begin, stop - begin))
            doc = np.repeat(np.arange(per_doc.size), per_doc)
            if not doc.size:
                continue
            place = np.arange(doc.size) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            own = []
            for column in (teleport, dangling, start):
                column = column.slice(begin, stop - begin)
                given = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                at = np.repeat(np.cumsum(given) - given, per_doc) + place
                held = place < np.repeat(given, per_doc)
                weight = np.where(held, values[np.minimum(at, max(len(values) - 1, 0))] if len(values) else 0.0, 0.0)
                own.append((shares(weight, doc, per_doc.size), np.repeat(column.is_valid().to_numpy(zero_copy_only=False), per_doc)))
            even = 1.0 / per_doc[doc]
            landing = np.where(own[0][1], own[0][0], even)
            vectors = (landing, np.where(own[1][1], own[1][0], landing), np.where(own[2][1], own[2][0], even))
            results.append(sentence_scores(_codes(flat), lengths, doc, per_doc.size, alpha, max_iter, tol, vectors))
        return _as_lists(np.concatenate(results) if results else np.zeros(0), all_per_doc)

    return rank


def word_ranker(window=2, alpha=0.85, max_iter=100, tol=1e-6):
    """Column function: vertex word lists, edge word lists -> score per distinct vertex word.

    Scores follow the order in which the words first appear in the vertex lists.
    """

    @column_kernel("array<double>")
    def rank(vertices: pa.Array, edges: pa.Array) -> pa.Array:
        _, lengths, per_doc = _nested(edges)
        results, counts = [], []
        for start, stop in _chunks(_tokens_per_doc(lengths, per_doc)):
            v_flat, v_lengths, v_docs = _nested(vertices.slice(start, stop - start))
            e_flat, e_lengths, e_docs = _nested(edges.slice(start, stop - start))
            n = v_docs.size
            codes = _codes(pa.concat_arrays([v_flat, e_flat]))
            v_doc = np.repeat(np.repeat(np.arange(n), v_docs), v_lengths)
            e_doc = np.repeat(np.repeat(np.arange(n), e_docs), e_lengths)
            e_sentence = np.repeat(np.arange(e_lengths.size), e_lengths)
            owner, scores = word_scores(
                codes[: len(v_flat)], v_doc, codes[len(v_flat) :], e_sentence, e_doc,
                window, n, alpha, max_iter, tol,
            )
            results.append(scores)
            counts.append(np.bincount(owner, minlength=n))
        if not results:
            return _as_lists(np.zeros(0), np.zeros(0, dtype=np.int64))
        return _as_lists(np.concatenate(results), np.concatenate(counts))

    return rank


# Vectors. The key of a distance is the distance rounded to KEY_DIGITS places: it makes
# ties between equal vectors exact, whatever order the sums were taken in.
KEY_DIGITS = 9


def stack(vectors):
    return np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def kl_matrix(p, q):
    """Row-by-row divergences of normalised rows: sum p ln p - p . ln q, infinite off q's support."""
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(p > 0, p * np.log(p), 0.0).sum(axis=1)
        log_q = np.where(q > 0, np.log(q), 0.0)
    result = np.maximum(own[:, None] - p @ log_q.T, 0.0)
    holes = q == 0
    if holes.any():
        result[(p > 0).astype(float) @ holes.T.astype(float) > 0] = np.inf
    return result


def square_matrix(a, b):
    """Squared Euclidean distances, subject to cancellation between near copies."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T), 0.0)


def metric_space(vectors, metric):
    """Coordinates in which plain Euclidean distance bounds the metric from below."""
    return np.sqrt(np.maximum(vectors, 0.0)) if metric == "kl" else vectors


def metric_values(a, b, metric):
    return kl_matrix(a, b) if metric == "kl" else np.sqrt(square_matrix(a, b))


def nearest_rows(a, b, k, metric):
    """The ``k`` nearest rows of ``b`` for each row of ``a``, ties by position in ``b``.

    A matrix product picks out the rows that can be among the nearest; their distances
    are then taken exactly and ordered.
    """
    k = min(k, b.shape[0])
    rough = kl_matrix(a, b) if metric == "kl" else square_matrix(a, b)
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
    slack = 1e-8 + 1e-10 * (np.abs(a).max(initial=0.0) + np.abs(b).max(initial=0.0)) ** 2 * a.shape[1]
    row, col = np.nonzero(rough <= (kth + slack)[:, None])
    if metric == "kl":
        exact = rough[row, col]
    else:
        exact = np.concatenate(
            [
                np.sqrt(((a[row[i : i + 100_000]] - b[col[i : i + 100_000]]) ** 2).sum(axis=1))
                for i in range(0, row.size, 100_000)
            ]
        )
    key = np.round(exact, KEY_DIGITS)
    order = np.lexsort((col, key, row))
    row, col, exact, key = row[order], col[order], exact[order], key[order]
    place = np.arange(row.size) - np.searchsorted(row, row)
    best = place < k
    return row[best], col[best], exact[best], key[best]


def rows_of(column):
    """An Arrow ``array<double>`` column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cells_to_visit(rows, pivots, radius, k, metric):
    """Which cells can hold one of a row's ``k`` nearest candidates, as a boolean matrix.

    The pivots are candidates, so the k-th smallest distance to them bounds the k-th
    nearest from above. A cell's nearest point is at least (distance to its pivot minus
    its radius) away. Slack covers rounding; an empty cell has radius -1.
    """
    to_pivots = metric_values(rows, pivots, metric)
    bound = np.partition(to_pivots, k - 1, axis=1)[:, k - 1] if len(pivots) >= k else np.full(len(rows), np.inf)
    centres = np.sqrt(square_matrix(metric_space(rows, metric), metric_space(pivots, metric)))
    gap = np.maximum(centres - radius - 1e-6, 0.0)
    if metric == "kl":
        with np.errstate(divide="ignore"):
            least = -2 * np.log(np.maximum(1 - gap**2 / 2, 0.0))
    else:
        least = gap
    return (least <= (bound * (1 + 1e-9) + 1e-6)[:, None]) & (radius >= 0)


def graph_ranker(alpha, max_iter, tol):
    """PageRank of all graphs of a bundle at once: ``nodes (graph, node)`` and ``links (graph, src, dst, weight)`` -> ``(graph, node, score)``.

    The rounds are those of ``operators.graph.pagerank``: a graph that has met the tolerance keeps its scores; nodes without links
    share what they hold evenly. Rows of one node count as that many nodes with the same links."""

    def ranked(nodes, links):
        if nodes.empty:
            return nodes[["graph", "node"]].assign(score=np.zeros(0))
        graph = pd.factorize(pd.concat([nodes["graph"], links["graph"]], ignore_index=True))[0].astype(np.int64)
        name = pd.factorize(pd.concat([nodes["node"], links["src"], links["dst"]], ignore_index=True))[0].astype(np.int64)
        n, m = len(nodes), len(links)
        width = name.max(initial=0) + 2
        key = graph[:n] * width + name[:n] + 1  # NULL nodes are -1 and have no links
        own, place, times = np.unique(key, return_inverse=True, return_counts=True)
        ends = [graph[n:] * width + part + 1 for part in (name[n : n + m], name[n + m :])]
        at = [np.minimum(np.searchsorted(own, end), len(own) - 1) for end in ends]
        weight = links["weight"].to_numpy(float)
        src = at[0][own[at[0]] == ends[0]]
        linked = np.bincount(src, minlength=len(own)) > 0
        out = np.bincount(src, np.nan_to_num(weight[own[at[0]] == ends[0]]), len(own))
        known = (own[at[0]] == ends[0]) & (own[at[1]] == ends[1]) & (name[n + m :] >= 0) & ~np.isnan(weight)
        src, dst = at[0][known], at[1][known]
        share = np.divide(weight[known], out[src], out=np.zeros(len(src)), where=out[src] > 0) * times[src]
        home = own // width
        size = np.bincount(home, times)
        loose = np.bincount(home, times * ~linked, len(size))
        size = np.maximum(size, 1.0)
        even, score, finished = 1 / size, 1 / size[home], np.zeros(len(size), bool)
        for _ in range(max_iter):
            even = (alpha * loose * even + (1 - alpha)) / size
            moved = alpha * np.bincount(dst, score[src] * share, len(own)) + even[home]
            moved[finished[home]] = score[finished[home]]
            change = np.bincount(home, times * np.abs(moved - score), len(size))
            score = moved
            if tol > 0:
                finished = change < size * tol
                if finished.all():
                    break
        return pd.DataFrame({"graph": nodes["graph"], "node": nodes["node"], "score": score[place]})

    return ranked
