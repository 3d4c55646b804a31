"""Tokens, sentences and word pairs as rows.

A document is one row, so everything within a document is computed inside that row;
only operators that compare documents shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import han, text
from inkwell.functions.kernels import column_kernel
from inkwell.operators.rows import exploded, exploded_structs


def tokenize(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, content)`` -> ``(doc_id, tokens array<string>)``; token-less documents stay.

    Options as in ``functions.text.document_tokens``.
    """
    return docs.select("doc_id", text.document_tokens(F.col("content"), **options).alias("tokens"))


def token_rows(tokenized: DataFrame) -> DataFrame:
    """One row per token: ``(doc_id, pos, token)``."""
    return exploded(tokenized, ["doc_id"], "tokens", "pos", "token")


def without_stop_words(rows: DataFrame, stop_words: DataFrame, token: str = "token") -> DataFrame:
    """Anti-join of token rows with a stop-word table ``(word)``; the match is case-sensitive."""
    return rows.join(stop_words.select(F.col("word").alias(token)), token, "left_anti")


def with_allowed_tags(rows: DataFrame, lexicon: DataFrame, allowed_tags=text.ALLOWED_TAGS) -> DataFrame:
    """Token rows whose tag is allowed.

    A token's tag comes from the lexicon ``(word, tag)``; a token the lexicon does not
    list is ``eng`` if it is an ASCII word and has no tag otherwise. The lexicon is
    reduced to one row per word, so a single outer join decides both cases.
    """
    listed = lexicon.groupBy(F.col("word").alias("token")).agg(
        F.bool_or(F.col("tag").isin(list(allowed_tags))).alias("_listed")
    )
    unlisted = F.col("token").rlike("^[A-Za-z][A-Za-z0-9]*$") if "eng" in allowed_tags else F.lit(False)
    return rows.join(listed, "token", "left").where(F.coalesce("_listed", unlisted)).drop("_listed")


def sentence_rows(docs: DataFrame, delimiters=text.SENTENCE_DELIMITERS) -> DataFrame:
    """One row per sentence: ``(doc_id, idx, sentence)``."""
    return exploded(docs, ["doc_id"], text.sentences(F.col("content"), delimiters), "idx", "sentence")


def sentence_word_lists(
    docs: DataFrame,
    stop_words=(),
    token_class: str = "reference",
    lower: bool = False,
    delimiters=text.SENTENCE_DELIMITERS,
    allowed_tags=text.ALLOWED_TAGS,
    segment=None,
) -> DataFrame:
    """Each sentence with its three word lists; words are found once, and tagged once where a segmenter tags them."""
    rows = sentence_rows(docs, delimiters)
    if segment is None:  # a word's tag follows from its first character
        rows = rows.withColumn("_runs", text.sentence_runs(F.col("sentence"), token_class, lower))
        rows = rows.withColumn("_kept", text.without_words(F.col("_runs"), stop_words))
        lists = [F.col("_runs").alias("words_no_filter"), F.col("_kept").alias("words_no_stop_words")]
        return rows.select("doc_id", "idx", "sentence", *lists, text.with_tags(F.col("_kept"), allowed_tags).alias("words_all_filters"))
    tagged = rows.withColumn("tagged", text.tagged_words(F.col("sentence"), token_class, lower, segment))
    lists = [
        text.select_words(F.col("tagged"), source, stop_words, allowed_tags).alias(f"words_{source}")
        for source in ("no_filter", "no_stop_words", "all_filters")
    ]
    return tagged.select("doc_id", "idx", "sentence", *lists)


def within_window(words: Column, window: int = 2) -> Column:
    """Pairs of words less than ``window`` apart, as ``array<struct<distance, w1, w2>>``, nearest first."""

    def at_distance(distance: Column) -> Column:
        length = F.greatest(F.size(words) - distance, F.lit(0))
        return F.zip_with(
            F.slice(words, F.lit(1), length),
            F.slice(words, distance + 1, length),
            lambda a, b: F.struct(distance.alias("distance"), a.alias("w1"), b.alias("w2")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(window, 2) - 1)), at_distance))


def window_pairs(sentences: DataFrame, words_col: str = "words", window: int = 2) -> DataFrame:
    """Sliding-window word pairs of every sentence; a window below 2 counts as 2."""
    return exploded_structs(sentences, ["doc_id", "idx"], within_window(F.col(words_col), window))


def word_vertices(word_lists: DataFrame, words_col: str = "words") -> DataFrame:
    """Each document's distinct words numbered by first appearance.

    ``words`` is ``array<array<string>>``. ``array_distinct`` keeps first-seen order, so
    the numbering needs no window and no shuffle.
    """
    distinct = F.array_distinct(F.flatten(F.col(words_col)))
    return exploded(word_lists, ["doc_id"], distinct, "vertex", "word")


def word_graph_edges(
    word_lists: DataFrame, vertex_col: str = "words", edge_col: str = "words", window: int = 2
) -> DataFrame:
    """Both directions of every 0/1 edge between words near each other: ``(doc_id, w1, w2)``.

    A document's edges come from its own row alone: no join, no shuffle. Where vertices and
    edges use different word lists, only edges between vertices stay. ``doc_id`` is one row's.
    """
    lists = word_lists.select("doc_id", F.col(vertex_col).alias("_vertices"), F.col(edge_col).alias("_edges"))
    pairs = F.flatten(F.transform(F.col("_edges"), lambda words: within_window(words, window)))
    if vertex_col != edge_col:
        unknown = F.array_except(F.flatten("_edges"), F.flatten("_vertices"))
        lists = lists.withColumn("_unknown", unknown)
        known = lambda p: ~F.array_contains("_unknown", p["w1"]) & ~F.array_contains("_unknown", p["w2"])
        pairs = F.filter(pairs, known)
    # Arrays of strings are made distinct by hash, arrays of structs by comparing all with all; the
    # length in front tells where the first word ends.
    joined = lambda a, b: F.concat(F.length(a).cast("string"), F.lit(":"), a, b)
    both = F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(joined(p["w1"], p["w2"]), joined(p["w2"], p["w1"])))))
    edges = exploded(lists, ["doc_id"], both, "_edge")
    size = F.substring_index("_edge", ":", 1)
    rest = F.substr("_edge", F.length(size) + 2)
    return edges.select(
        "doc_id", F.substr(rest, F.lit(1), size.cast("int")).alias("w1"), F.substr(rest, size.cast("int") + 1).alias("w2")
    )


def segment_runs(docs: DataFrame, lexicon: DataFrame, token_class: str = "reference") -> DataFrame:
    """Dictionary segmentation for a lexicon too large to broadcast: joins instead.

    ``(doc_id, content)`` -> ``(doc_id, pieces array<struct<word, tag>>)``, the same
    pieces as ``functions.han.segmenter``. Each distinct Han run is offered every
    substring up to the longest word; the lexicon keeps those it knows; a run's matches
    (at most its length times the longest word) are then walked from the left.
    """
    longest = lexicon.agg(F.max(F.length("word"))).first()[0] or 1
    runs = exploded(docs, ["doc_id"], text.raw_runs(F.col("content"), token_class), "pos", "run")
    distinct = runs.where(han.han_only(F.col("run"))).select("run").distinct()
    starts = distinct.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("start") + 1))
    offered = starts.select("run", "start", F.explode(sizes).alias("size")).withColumn(
        "word", F.substring("run", F.col("start"), F.col("size"))
    )
    best = offered.join(lexicon.groupBy("word").agg(F.max("tag").alias("tag")), "word")
    best = best.groupBy("run", "start").agg(F.max(F.struct("size", "tag")).alias("match"))
    matches = best.groupBy("run").agg(
        F.collect_list(F.struct("start", "match.size", "match.tag")).alias("matches")
    )

    @column_kernel(han.PIECES)
    def walk(run_col: pa.Array, match_col: pa.Array) -> pa.Array:
        rows = []
        for run, found in zip(run_col.to_pylist(), match_col.to_pylist()):
            tags = {m["start"] - 1: (m["size"], m["tag"]) for m in found or []}
            pieces, at, loose = [], 0, 0
            while at < len(run):
                if at not in tags:
                    at += 1
                    continue
                if loose < at:
                    pieces += [(word, "n") for word in han.bigrams(run[loose:at])]
                size, tag = tags[at]
                pieces.append((run[at : at + size], tag))
                at += size
                loose = at
            if loose < len(run):
                pieces += [(word, "n") for word in han.bigrams(run[loose:])]
            rows.append([{"word": word, "tag": tag} for word, tag in pieces])
        return pa.array(rows, pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())])))

    cut = distinct.join(matches, "run", "left").select("run", walk("run", "matches").alias("pieces"))
    latin = F.array(F.struct(F.col("run").alias("word"), text.word_tag(F.col("run")).alias("tag")))
    placed = runs.join(cut, "run", "left").select(
        "doc_id", F.struct("pos", F.coalesce("pieces", latin).alias("pieces")).alias("part")
    )
    joined = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    pieces = F.flatten(F.transform("parts", lambda part: part["pieces"]))
    return docs.select("doc_id").join(joined.select("doc_id", pieces.alias("pieces")), "doc_id", "left").select(
        "doc_id", F.coalesce("pieces", F.array().cast(han.PIECES)).alias("pieces")
    )
