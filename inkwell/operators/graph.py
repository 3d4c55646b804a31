"""Graph ranking: sentences and words by PageRank.

Graphs inside one document are ranked inside its row (``functions.kernels``). A graph
that spans documents, or one with a caller's own similarity, is ranked by the
distributed iteration in ``pagerank``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import kernels, text
from inkwell.operators.joins import SHARD_ROWS, join_counted, shards_for
from inkwell.operators.rows import exploded, exploded_structs
from inkwell.operators.tokens import word_graph_edges, word_vertices
from inkwell.session import checkpoint_path, delete_path, enable_checkpoints, materialize, planned_layout, working_tables

TIE_DIGITS = 9
WHOLE_LINKS = 500_000  # nodes and links of a graph that one task may rank by itself, and about as many of a bundle of graphs


def shared_words_similarity(shared: Column, n_a: Column, n_b: Column) -> Column:
    """Distinct shared words / (ln words of a + ln words of b); 0 if both have a single word."""
    bottom = F.log(n_a) + F.log(n_b)
    return F.when(bottom < 1e-12, 0.0).otherwise(F.try_divide(shared, bottom))


def sentence_graph_edges(
    word_lists: DataFrame,
    words_col: str = "words",
    similarity: Callable[[Column, Column, Column], Column] = shared_words_similarity,
) -> DataFrame:
    """Weighted sentence pairs, self-pairs included: ``(doc_id, src, dst, weight)``, ``src <= dst``.

    ``words`` is ``array<array<string>>``. Shared words are counted inside the document's row, a block of
    source sentences at a time: no join, no shuffle, and memory follows a block's links.
    """
    shared = word_lists.select("doc_id", F.col(words_col)).mapInArrow(
        kernels.shared_word_counts, f"doc_id {word_lists.schema['doc_id'].dataType.simpleString()}, src int, dst int, n_a int, n_b int, shared long"
    )
    weight = similarity(F.col("shared"), F.col("n_a"), F.col("n_b")).cast("double")
    return shared.select("doc_id", "src", "dst", weight.alias("weight")).where("weight > 0")


def score_sentences(
    docs: DataFrame,
    stop_words=(),
    source: str = "all_filters",
    token_class: str = "reference",
    lower: bool = True,
    delimiters=text.SENTENCE_DELIMITERS,
    allowed_tags=text.ALLOWED_TAGS,
    segment=None,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    teleport: Callable[[Column], Column] | None = None,
    dangling: Callable[[Column], Column] | None = None,
    start: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(doc_id, ranked array<struct<rank, idx, sentence, weight>>)``, best sentence first.

    Splitting, scoring and ordering all happen inside the document's row: there is no
    shuffle. Equal scores (to 9 places) keep sentence order. ``teleport``, ``dangling`` and ``start`` make an array of
    weights from a document's array of sentences: where jumps land, where the mass of sentences without links goes (where jumps
    land, unless given), and the scores to begin with.
    """
    content = F.col("content")
    if segment is None:
        words = text.sentence_words(content, source, stop_words, token_class, lower, delimiters, allowed_tags)
    else:
        runs = F.transform(
            text.sentences(content, delimiters), lambda s: text.raw_runs(s, token_class, sentence=True)
        )
        words = F.transform(
            segment(runs, nested=True),
            lambda pieces: text.select_words(
                text.lower_words(pieces) if lower else pieces, source, stop_words, allowed_tags
            ),
        )
    rank = kernels.sentence_ranker(alpha, max_iter, tol)
    split = docs.select("doc_id", text.sentences(content, delimiters).alias("sentences"), words.alias("words"))
    if teleport or dangling or start:
        none = F.lit(None).cast("array<double>")
        weights = {name: (make(F.col("sentences")).cast("array<double>") if make else none) for name, make in (("_teleport", teleport), ("_dangling", dangling), ("_start", start))}
        split = split.select("*", *(column.alias(name) for name, column in weights.items()))
        scores = kernels.on_columns(kernels.personal_sentence_ranker(alpha, max_iter, tol), "words", *weights)
    else:
        scores = kernels.on_columns(rank, "words")
    scored = split.select("doc_id", "sentences", scores.alias("scores"))
    return scored.select("doc_id", in_order(F.col("scores"), F.col("sentences")).alias("ranked"))


def in_order(scores: Column, sentences: Column) -> Column:
    """Items by descending score, ties (to ``TIE_DIGITS`` places) by position; arrays sort structs field by field."""
    items = F.zip_with(
        scores, sentences, lambda weight, item: F.struct(weight.alias("weight"), item.alias("sentence"))
    )
    keyed = F.transform(
        items,
        lambda item, idx: F.struct(
            (-F.round(item["weight"], TIE_DIGITS)).alias("order"),
            idx.alias("idx"),
            item["sentence"].alias("sentence"),
            item["weight"].alias("weight"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda item, at: F.struct(
            (at + 1).alias("rank"), item["idx"].alias("idx"),
            item["sentence"].alias("sentence"), item["weight"].alias("weight"),
        ),
    )


def summary(ranked: Column, num: int = 6, min_length: int = 6) -> Column:
    """The first ``num`` sentences of at least ``min_length`` characters, in rank order."""
    long_enough = F.filter(ranked, lambda item: F.length(item["sentence"]) >= min_length)
    return F.slice(long_enough, 1, num)


def score_words(
    word_lists: DataFrame,
    vertex_col: str = "words",
    edge_col: str = "words",
    window: int = 2,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
) -> DataFrame:
    """Words ranked within each document: ``(doc_id, word, weight, rank)``, in the document's row."""
    rank = kernels.word_ranker(window, alpha, max_iter, tol)
    scored = word_lists.select(
        "doc_id",
        F.array_distinct(F.flatten(vertex_col)).alias("words"),
        kernels.on_columns(rank, vertex_col, edge_col).alias("scores"),
    )
    ranked = exploded_structs(scored, ["doc_id"], in_order(F.col("scores"), F.col("words")))
    return ranked.select("doc_id", F.col("sentence").alias("word"), "weight", "rank")


def corpus_word_graph(word_lists: DataFrame, words_col: str = "words", window: int = 2):
    """Vertices and edges of the one word graph of a whole corpus, for ``pagerank``."""
    vertices = word_vertices(word_lists, words_col).select("word").distinct()
    edges = word_graph_edges(word_lists, words_col, words_col, window).select("w1", "w2").distinct()
    nodes = vertices.select(F.lit(0).alias("graph"), F.col("word").alias("node"))
    links = edges.select(
        F.lit(0).alias("graph"), F.col("w1").alias("src"), F.col("w2").alias("dst"), F.lit(1.0).alias("weight")
    )
    return nodes, links


def sentence_graph(word_lists: DataFrame, words_col: str = "words", similarity=shared_words_similarity):
    """Vertices and both directions of every edge of each document's sentence graph, for ``pagerank``."""
    nodes = exploded(word_lists, [F.col("doc_id").alias("graph")], words_col, "node", "_words")
    edges = sentence_graph_edges(word_lists, words_col, similarity)
    ends = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    links = edges.select(F.col("doc_id").alias("graph"), F.explode(ends).alias("link"), "weight")
    return nodes.select("graph", "node"), links.select("graph", "link.src", "link.dst", "weight")


def pagerank(
    nodes: DataFrame,
    links: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    shard_rows: int = SHARD_ROWS,
    whole_links: int = WHOLE_LINKS,
) -> DataFrame:
    """Distributed PageRank of undirected graphs: ``(graph, node, score)``.

    ``nodes (graph, node)``; ``links (graph, src, dst, weight)`` in both directions,
    self-loops once. Any number of graphs of any size run together; a graph stops when
    its L1 change is below ``tol`` times its node count, and ``tol=0`` runs ``max_iter``
    rounds. A node row that repeats has a row of its own.

    Graphs of at most ``whole_links`` nodes and links are bundled, and each bundle meets its links once, in a task that goes through
    all rounds (``functions.kernels.graph_ranker``). What follows is for larger ones.

    Nodes get numeric ids first, so a round moves and compares longs only. Every link
    stores its share of the source's weight. A node with more links than ``shard_rows``
    is a hub: its links are split over shards by target and its score row is repeated per
    shard. One round joins scores to links and adds up per target, with map-side combine,
    so a hub's incoming links shuffle as one partial sum per partition. Links are laid out
    and sorted by their join key once, before the first round; without hubs the node table
    has the same layout, and the partial sums are a round's only shuffle.

    A node without links only ever receives the even share, the same as every other such
    node of its graph, so the dangling mass travels as a column and is never summed up.
    Each round ends in a checkpoint of the node table: the plan stays one round long, and
    a lost executor costs at most one round. A checkpoint goes when the next one is written.
    """
    enable_checkpoints(nodes.sparkSession)
    with working_tables(nodes.sparkSession) as work:
        nodes, links = materialize(nodes, "rank-nodes"), materialize(links, "rank-given")  # made once, read several times
        each = nodes.groupBy("graph").agg(F.count("*").alias("n")).unionByName(links.groupBy("graph").agg(F.count("*").alias("n")))
        sizes = materialize(each.where("graph IS NOT NULL").groupBy("graph").agg(F.sum("n").alias("n")), "rank-sizes")
        total = sizes.agg(F.sum(F.when(F.col("n") <= whole_links, F.col("n"))).alias("small"), F.count_if(F.col("n") > whole_links).alias("large")).first()
        if not total["small"]:
            return work.keep(_ranked(nodes, links, alpha, max_iter, tol, shard_rows), "ranked")
        large = sizes.where(F.col("n") > whole_links).select("graph")
        if not total["large"]:
            return work.keep(_bundled(nodes, links, alpha, max_iter, tol, total["small"], whole_links), "ranked")
        inside, outside = ([df.join(large, "graph", how) for df in (nodes, links)] for how in ("left_anti", "left_semi"))
        small = _bundled(*inside, alpha, max_iter, tol, total["small"], whole_links)
        return work.keep(small.unionByName(_ranked(*outside, alpha, max_iter, tol, shard_rows)), "ranked")


def _bundled(nodes: DataFrame, links: DataFrame, alpha: float, max_iter: int, tol: float, rows: int, whole_links: int) -> DataFrame:
    bundle = F.pmod(F.xxhash64("graph"), F.lit(max(1, -(-rows // max(whole_links, 1))))).cast("int").alias("bundle")
    nodes = nodes.where("graph IS NOT NULL").select(bundle, "graph", "node")
    links = links.where("graph IS NOT NULL AND src IS NOT NULL").select(bundle, "graph", "src", "dst", F.col("weight").cast("double").alias("weight"))
    types = dict(nodes.dtypes)
    rank = kernels.graph_ranker(alpha, max_iter, tol)
    return nodes.groupBy("bundle").cogroup(links.groupBy("bundle")).applyInPandas(rank, f"graph {types['graph']}, node {types['node']}, score double")


def _ranked(nodes: DataFrame, links: DataFrame, alpha: float, max_iter: int, tol: float, shard_rows: int) -> DataFrame:
    end = F.struct("graph", "node").alias("end")
    out = links.groupBy("graph", F.col("src").alias("node")).agg(F.sum("weight").alias("out"), F.count("*").alias("links"))
    # Written down before it is used twice, which also fixes the ids.
    numbered = materialize(
        nodes.join(out, ["graph", "node"], "left")
        .withColumn("shards", F.when(F.col("links") > 0, shards_for(F.col("links"), shard_rows)).otherwise(0))
        .withColumn("id", F.monotonically_increasing_id()),
        "rank-numbered",
    )
    sizes = numbered.groupBy("graph").agg(F.count("*").alias("n"), F.count_if(F.col("shards") == 0).alias("loose"))
    state = join_counted(
        numbered.select("id", "graph", "shards"), sizes, "graph", "id", F.col("n"), shard_rows
    )
    ends = numbered.where("shards > 0").select(end, "id", "out", "shards", "links")
    by_source = links.select(F.struct("graph", F.col("src").alias("node")).alias("end"), "graph", "dst", "weight")
    by_target = join_counted(by_source, ends, "end", "dst", F.col("links"), shard_rows).select(
        F.struct("graph", F.col("dst").alias("node")).alias("end"),
        F.col("id").alias("src"), (F.col("weight") / F.col("out")).alias("share"), F.col("shards").alias("src_shards"),
    )
    numbered_links = join_counted(by_target, ends, "end", "src", F.col("links"), shard_rows).select(
        "src", F.col("id").alias("dst"), "share", F.expr("pmod(xxhash64(id), src_shards)").cast("int").alias("shard")
    )
    link_key = ["src"] if numbered.where("shards > 1").isEmpty() else ["src", "shard"]
    with planned_layout(nodes.sparkSession):
        scores = _iterate(state, numbered_links, link_key, alpha, max_iter, tol, shard_rows)
    return numbered.select("id", "graph", "node").join(scores, "id").select("graph", "node", "score")


def _iterate(nodes, links, link_key, alpha, max_iter, tol, shard_rows) -> DataFrame:
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = materialize(links, "rank-links").repartition(partitions, *link_key).sortWithinPartitions(*link_key).persist()
    start = 1 / F.col("n")
    state = nodes.repartition(partitions, "id").select(
        "*", start.alias("score"), start.alias("even"), F.lit(False).alias("finished")
    )
    written = None
    for _ in range(max_iter):
        state = _moved(state, _received(state, links, link_key), alpha).checkpoint()
        before, written = written, checkpoint_path(state)
        if before:
            delete_path(nodes.sparkSession, before)
        if tol > 0:
            change = F.sum(F.abs(F.col("score") - F.col("previous")))
            changed = state.groupBy("graph").agg(F.max("n").alias("rows"), change.alias("change"))
            settled = changed.select("graph", "rows", (F.col("change") < F.col("rows") * tol).alias("finished"))
            if settled.where("not finished").isEmpty():
                break
            state = join_counted(state.drop("finished"), settled, "graph", "id", F.col("rows"), shard_rows)
    result = materialize(state.select("id", "score"), "rank-scores")
    links.unpersist()
    if written:
        delete_path(nodes.sparkSession, written)
    return result


def _received(state: DataFrame, links: DataFrame, link_key: list[str]) -> DataFrame:
    """What each node is passed over its links, as sums per target."""
    sources = state.where("shards > 0").withColumnRenamed("id", "src")
    if "shard" in link_key:
        sources = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    passed = links.join(sources.select(*link_key, "score"), link_key).select(
        F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("passed")
    )
    return passed.groupBy("id").agg(F.sum("passed").alias("received"))


def _moved(state: DataFrame, received: DataFrame, alpha: float) -> DataFrame:
    """One round; a graph that has met the tolerance keeps its scores."""
    even = (alpha * F.col("loose") * F.col("even") + (1 - alpha)) / F.col("n")
    score = alpha * F.coalesce("received", F.lit(0.0)) + even
    return state.join(received, "id", "left").select(
        "id", "graph", "shards", "n", "loose", "finished",
        F.col("score").alias("previous"),
        F.when(F.col("finished"), F.col("score")).otherwise(score).alias("score"),
        even.alias("even"),
    )
