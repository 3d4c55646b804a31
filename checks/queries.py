"""The registered queries: one per operator, each over whole tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text, vectors
from inkwell.functions.stopwords import default_stop_words
from inkwell.operators import aggregates, features, graph, han_words, sharded_topics, similarity, tokens, topics
from inkwell.operators.metric_index import MetricIndex
from inkwell.operators.rows import exploded, exploded_structs
from inkwell.plans import clustering, corpora, summaries, topic_modelling
from inkwell.plans.similarity import nearest_documents
from inkwell.session import materialize, scratch_path
from inkwell.sources import corpus
from inkwell.sources.vectors import read_vector_csv, write_vector_csv

STOP_WORDS = default_stop_words()
TOKENS = dict(token_class="letters", lower=True)
WORDS = dict(token_class="letters", stop_words=STOP_WORDS)
ROUNDS = dict(max_iter=100, tol=1e-6)  # stop at 100 rounds, or when a graph moves by less than tol times its nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpus.read_table(spark, "parquet", f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spread(corpus.corpus(table(spark, sf_dir, "documents"), "text", "doc_id"), "doc_id")


def tokenized(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return tokens.tokenize(documents(spark, sf_dir), **{**TOKENS, **options})


def benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.corpus(table(spark, sf_dir, "benchmark"), "text", "item_id")
    return tokens.tokenize(items, **TOKENS)


def word_lists(spark: SparkSession, sf_dir: str, source: str = "all_filters") -> DataFrame:
    words = text.sentence_words(F.col("content"), source, **WORDS)
    return documents(spark, sf_dir).select("doc_id", words.alias("words"))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as topic distributions."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), vectors.softmax(F.col("embedding")).alias("topic_distribution"))


def joined(column, separator: str = " "):
    return F.concat_ws(separator, column)


# Sources and sinks


def corpus_scan(spark, sf_dir):
    return corpus.corpus(table(spark, sf_dir, "documents"), "text", "doc_id")


def corpus_projected_limit(spark, sf_dir):
    docs = corpus.corpus(table(spark, sf_dir, "documents"), "text", "doc_id")
    return corpus.first_documents(docs.na.drop(how="any", subset="content"), 200)


def corpus_nonempty(spark, sf_dir):
    return corpus.nonempty(corpus.corpus(table(spark, sf_dir, "conversations"), "text", "conv_id"))


def corpus_remap(spark, sf_dir):
    fields = {"title": "url", "html": "html", "time": "publicTime", "org": "puborg"}
    return corpus.remap(table(spark, sf_dir, "pages"), fields, "page_id")


def corpus_union(spark, sf_dir):
    """Two sources in one collection, saved source by source and read back."""
    path = scratch_path(spark, "collection")
    corpora.transfer_to(
        path,
        {
            "documents": (table(spark, sf_dir, "documents"), {"html": "text", "org": "source"}, "doc_id"),
            "pages": (table(spark, sf_dir, "pages"), {"title": "url", "html": "html"}, "page_id"),
        },
    )
    return corpus.read_table(spark, "parquet", path)


def corpus_clean(spark, sf_dir):
    return corpus.clean(corpus.corpus(table(spark, sf_dir, "documents"), "text", None))


def corpus_distinct_with_id(spark, sf_dir):
    return corpus.clean(corpus.corpus(table(spark, sf_dir, "documents"), "text", "doc_id"))


def stopwords_table(spark, sf_dir):
    """The words found in at least a quarter of the benchmark items, through a stop-word file."""
    items = benchmark_tokens(spark, sf_dir)
    common = features.document_frequency(items).where(F.col("df") * 4 >= items.select(F.count("*")).scalar())
    path = scratch_path(spark, "stop-words")
    common.select(F.concat(F.lit(" "), "term", F.lit("　")).alias("value")).write.text(path)
    return corpus.read_stop_words(spark, path)


def text_lines_scan(spark, sf_dir):
    return corpus.read_lines(spark, keyword_file(spark, sf_dir))


def keyword_file(spark, sf_dir):
    """Each document's distinct tokens as a line ``[a,b,c]`` of a text file."""
    lines = tokenized(spark, sf_dir, stop_words=STOP_WORDS)
    path = scratch_path(spark, "keywords")
    lines.select(F.concat(F.lit("["), joined(F.array_distinct("tokens"), ","), F.lit("]"))).write.text(path)
    return path


def vector_csv_roundtrip(spark, sf_dir):
    rows = distributions(spark, sf_dir).select(
        F.format_string("Row(oid='%s')", F.col("doc_id").cast("string")).alias("id"),
        vectors.argmax(F.col("topic_distribution")).alias("topic_num"),
        "topic_distribution",
    )
    path = scratch_path(spark, "vectors")
    write_vector_csv(rows, path)
    loaded = read_vector_csv(spark, path, rendered_ids=True)
    entries = loaded.select("id", "topic_num", F.posexplode("topic_distribution").alias("dim", "value"))
    return entries.withColumn("value", F.round("value", 6))


def decode_text(spark, sf_dir):
    """Documents with invalid bytes put around their text decode to the text alone."""
    broken = F.concat(
        F.lit(bytearray(b"\xc3(")), F.encode("text", "UTF-8"), F.lit(bytearray(b"\xef\xbf\xbd\xff\xe4\xbd"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.decode_text(broken).alias("content"))


# Text


def tokenize(spark, sf_dir):
    docs = topic_modelling.tokenized_corpus(documents(spark, sf_dir), **TOKENS)
    return docs.select("doc_id", joined("tokens").alias("tokens"), F.size("tokens").alias("n_tokens"))


def token_filter(spark, sf_dir):
    docs = tokens.tokenize(documents(spark, sf_dir), stop_words=STOP_WORDS)
    return docs.select("doc_id", joined("tokens").alias("tokens"), F.size("tokens").alias("n_tokens"))


def tokens_stopword_anti(spark, sf_dir):
    rows = tokens.token_rows(tokenized(spark, sf_dir))
    return tokens.without_stop_words(rows, stopwords_table(spark, sf_dir)).select("doc_id", "pos", "token")


def benchmark_lexicon(spark, sf_dir):
    """The benchmark's words, tagged by their ending."""
    words = features.document_frequency(benchmark_tokens(spark, sf_dir))
    tag = F.expr(
        "CASE WHEN term LIKE '%ly' THEN 'd' WHEN term LIKE '%ed' THEN 'v' WHEN term LIKE '%er' THEN 'a' ELSE 'n' END"
    )
    return words.select(F.col("term").alias("word"), tag.alias("tag"))


def tokens_tag_filter(spark, sf_dir):
    rows = tokens.token_rows(tokenized(spark, sf_dir))
    return tokens.with_allowed_tags(rows, benchmark_lexicon(spark, sf_dir)).select("doc_id", "pos", "token")


def strip_whitespace(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.strip_space(F.col("content"), "all").alias("content"))


def _with_marks(spark, sf_dir):
    """Documents carrying quoted titles and document numbers built from their own columns."""
    marked = F.concat(
        F.lit("《"), "source", F.lit("》"), "text", F.lit("《"), "lang", F.lit("》（"), "source", F.lit("号）"),
        F.col("n_chars").cast("string"), F.lit("《"), "source", F.lit("》（"), "lang", F.lit("）end（"), "lang", F.lit("号）"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("content"))


def extract_titles(spark, sf_dir):
    whole = text.strip_space(F.col("content"), "all")
    return _with_marks(spark, sf_dir).select(
        "doc_id",
        joined(text.title_names(whole), "|").alias("titles"),
        text.drop_titles(whole).alias("rest"),
    )


def drop_doc_numbers(spark, sf_dir):
    whole = text.strip_space(F.col("content"), "all")
    return _with_marks(spark, sf_dir).select(
        "doc_id",
        text.drop_document_numbers(whole).alias("per_bracket"),
        text.drop_document_numbers(whole, greedy=True).alias("greedy"),
    )


def sentence_split(spark, sf_dir):
    return tokens.sentence_rows(documents(spark, sf_dir))


def sentence_words(spark, sf_dir):
    lists = tokens.sentence_word_lists(documents(spark, sf_dir), STOP_WORDS, "letters", lower=True)
    names = ("words_no_filter", "words_no_stop_words", "words_all_filters")
    return lists.select("doc_id", "idx", *[joined(name).alias(name) for name in names])


def parse_keyword_line(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("["), "lang", F.lit(", "), "text", F.lit(","), "source", F.lit("]")).alias("line")
    )
    items = text.keyword_line(F.col("line"))
    return lines.select("doc_id", F.size(items).alias("n"), joined(items, "|").alias("items"))


def _han_corpus(spark, sf_dir):
    """Documents with their letters mapped to Han characters and without whitespace, and all their words as the lexicon."""
    latin, chars = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
    to_han = lambda c: F.translate(F.lower(c), latin, chars)
    docs = documents(spark, sf_dir)
    words = features.term_frequency(tokens.tokenize(docs, lower=True)).groupBy("term").agg(F.sum("tf").alias("n"))
    lexicon = words.select(to_han(F.col("term")).alias("word"), F.lit("n").alias("tag"), F.col("n").cast("double").alias("weight"))
    content = text.clean_document(to_han(F.col("content")), "all")
    return docs.select("doc_id", content.alias("content")), lexicon


def han_tokens(spark, sf_dir):
    """Documents cut under the lexicon of all their words, along the most probable paths."""
    docs, lexicon = _han_corpus(spark, sf_dir)
    words = F.transform("pieces", lambda piece: piece["word"])
    kept = F.filter(words, lambda word: text.keep_token(word, [], "reference"))
    return han_words.segment(docs, lexicon).select("doc_id", joined(kept).alias("tokens"), F.size(kept).alias("n_tokens"))


def han_cover(spark, sf_dir):
    """What the pieces of every document spell when no stretch is unknown: its word runs, end to end, as a checksum."""
    docs, lexicon = _han_corpus(spark, sf_dir)
    single = lexicon.select(F.explode(F.split("word", "")).alias("word")).where("word <> ''").distinct().select("word", F.lit("c").alias("tag"), F.lit(1.0).alias("weight"))
    words = F.transform(F.col("pieces"), lambda piece: piece["word"])
    cut = han_words.segment(docs, lexicon.unionByName(single))
    return cut.select("doc_id", F.md5(F.array_join(words, "")).alias("spelled"))


# Features


def term_frequency(spark, sf_dir):
    return features.term_frequency(tokenized(spark, sf_dir))


def document_frequency(spark, sf_dir):
    return features.document_frequency(tokenized(spark, sf_dir))


def tfidf(spark, sf_dir):
    rows = features.tfidf(tokenized(spark, sf_dir))
    return rows.withColumn("tfidf", F.round("tfidf", 6))


def count_vectors(spark, sf_dir):
    docs = materialize(tokenized(spark, sf_dir), "tokens")
    return features.count_entries(docs).select("doc_id", "term", "tf")


def idf_vectors(spark, sf_dir):
    docs = materialize(tokenized(spark, sf_dir), "tokens")
    return features.idf_entries(docs).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


def hashing_tf(spark, sf_dir):
    hashed = features.hashing_tf().transform(tokenized(spark, sf_dir))
    return features.sparse_entries(hashed, "features").withColumnRenamed("index", "bucket")


def hashing_tf_totals(spark, sf_dir):
    return hashing_tf(spark, sf_dir).groupBy("doc_id").agg(F.sum("value").cast("bigint").alias("n_tokens"))


def word_vectors(spark, sf_dir):
    model, docs = features.fit_word_vectors(tokenized(spark, sf_dir, stop_words=STOP_WORDS), size=100)
    from pyspark.ml.functions import vector_to_array

    return model.transform(docs).select("doc_id", vector_to_array("features").alias("vector"))


def list_concat_by_key(spark, sf_dir):
    docs = corpus.spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "doc_id")
    lists = docs.select("source", "doc_id", text.document_tokens(F.col("text"), **TOKENS).alias("tokens"))
    return aggregates.concat_lists(lists, "source", "tokens", "doc_id").withColumnRenamed("value", "token")


def _longest(a, b):
    return max(a, b, key=lambda x: -1 if x is None else x)


def combine_lengths(spark, sf_dir):
    """A caller's own three functions: documents, characters and longest text of every source."""
    rows = table(spark, sf_dir, "documents").select("source", F.length("text").alias("size"))
    found = aggregates.combine_by_key(
        rows, "source", "size",
        create=lambda n: {"docs": 1, "chars": n or 0, "longest": n},
        merge_value=lambda c, n: {"docs": c["docs"] + 1, "chars": c["chars"] + (n or 0), "longest": _longest(c["longest"], n)},
        merge_combiners=lambda a, b: {"docs": a["docs"] + b["docs"], "chars": a["chars"] + b["chars"], "longest": _longest(a["longest"], b["longest"])},
        combiner_type="struct<docs:bigint,chars:bigint,longest:int>",
    )
    return found.select("source", "combined.docs", "combined.chars", "combined.longest")


# Graph ranking


def sentence_graph_edges(spark, sf_dir):
    edges = graph.sentence_graph_edges(word_lists(spark, sf_dir))
    return edges.withColumn("weight", F.round("weight", 6))


def textrank_scores(spark, sf_dir):
    ranked = graph.score_sentences(documents(spark, sf_dir), **WORDS, **ROUNDS)
    rows = exploded_structs(ranked, ["doc_id"], "ranked")
    return rows.select("doc_id", "idx", "sentence", F.round("weight", 9).alias("weight"), "rank")


def textrank_summary(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    corpus.save(summaries.summaries(documents(spark, sf_dir), **WORDS, **ROUNDS), path)
    docs = corpus.read_table(spark, "parquet", path)
    return docs.select("doc_id", joined("html", "\n").alias("html"), F.size("html").alias("n_sentences"))


def textrank_personal(spark, sf_dir):
    """Sentences ranked with jumps that favour a document's beginning and dangling mass that favours long sentences."""
    ranked = graph.score_sentences(
        documents(spark, sf_dir),
        teleport=lambda sentences: F.transform(sentences, lambda s, i: 1.0 / (i + 1)),
        dangling=lambda sentences: F.transform(sentences, lambda s: F.length(s)),
        start=lambda sentences: F.transform(sentences, lambda s, i: F.when(i == 0, 1.0).otherwise(0.0)),
        **WORDS, **ROUNDS,
    )
    rows = exploded_structs(ranked, ["doc_id"], "ranked")
    return rows.select("doc_id", "idx", F.round("weight", 9).alias("weight"), "rank")


def textrank_custom_similarity(spark, sf_dir):
    """Sentences ranked under a caller's own similarity, by the distributed iteration."""
    nodes, links = graph.sentence_graph(
        word_lists(spark, sf_dir), similarity=lambda shared, n_a, n_b: shared / (n_a + n_b)
    )
    scores = graph.pagerank(nodes, links, max_iter=30, tol=0)  # the option of a fixed number of rounds
    return scores.select(F.col("graph").alias("doc_id"), F.col("node").alias("idx"), F.round("score", 9).alias("weight"))


def token_window_pairs(spark, sf_dir):
    docs = word_lists(spark, sf_dir).repartition("doc_id")  # placed before pairs are made of them
    sentences = exploded(docs, ["doc_id"], "words", "idx", "words")
    pairs = tokens.window_pairs(sentences, window=3)
    return pairs.groupBy("doc_id", "idx", "distance", "w1", "w2").agg(F.count("*").alias("n"))


def word_vertices(spark, sf_dir):
    return tokens.word_vertices(word_lists(spark, sf_dir))


def word_graph_edges(spark, sf_dir):
    """Vertices from the filtered lists, edges from the unfiltered ones."""
    docs = documents(spark, sf_dir).select(
        "doc_id",
        text.sentence_words(F.col("content"), "all_filters", **WORDS).alias("vertices"),
        text.sentence_words(F.col("content"), "no_stop_words", **WORDS).alias("edges"),
    )
    return tokens.word_graph_edges(docs, "vertices", "edges", window=2)


def keyword_rank(spark, sf_dir):
    ranked = graph.score_words(word_lists(spark, sf_dir), window=2, **ROUNDS)
    return ranked.withColumn("weight", F.round("weight", 9))


def corpus_keyword_rank(spark, sf_dir):
    """Words ranked in the one word graph of all documents."""
    nodes, links = graph.corpus_word_graph(word_lists(spark, sf_dir), window=2)
    scores = graph.pagerank(nodes, links, **ROUNDS)
    return scores.select(F.col("node").alias("word"), F.round("score", 9).alias("weight"))


# Similarity


def topic_argmax(spark, sf_dir):
    rows = distributions(spark, sf_dir)
    return rows.select("doc_id", vectors.argmax(F.col("topic_distribution")).alias("topic_num"))


def doc_similarity_kl_top5(spark, sf_dir):
    rows = distributions(spark, sf_dir)
    found = nearest_documents(rows, rows)
    return found.select("id1", "id2", F.round("distance", 6).alias("kl"), "rank")


def doc_similarity_euclid_top5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = similarity.nearest(rows, rows, 5, "euclid", "vec_id", "vec_id", "embedding")
    return found.select(
        "id1", "id2", F.round("distance", 6).alias("distance"),
        F.round(1 / (1 + F.col("distance")), 6).alias("similarity"), "rank",
    )


def vowel_counts(text):
    """How often each vowel and anything else stands in a text, and once more, as a distribution to be scaled."""
    lower = F.translate(text, "AEIOU", "aeiou")
    vowels = F.transform(F.array(*(F.lit(c) for c in "aeiou")), lambda c: F.length(lower) - F.length(F.replace(lower, c, F.lit(""))) + 1)
    rest = F.length(F.translate(lower, "aeiou", "")) + 1
    return F.transform(F.concat(vowels, F.array(rest)), lambda n: n.cast("double"))


def _turns_and_documents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    turns = turns.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), vowel_counts(F.col("text")).alias("topic_distribution"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", vowel_counts(F.col("text")).alias("topic_distribution"))
    return materialize(turns, "turns"), materialize(docs, "documents")


def doc_similarity_index_kl(spark, sf_dir):
    """Every turn's nearest documents by the divergence of their vowels, from a stored index of the documents."""
    turns, docs = _turns_and_documents(spark, sf_dir)
    path = scratch_path(spark, "index")
    MetricIndex.build(docs, path, "kl")
    found = MetricIndex(spark, path).search(turns, 5)
    return found.select("id1", "id2", F.round("distance", 6).alias("kl"), "rank")


def doc_similarity_index_euclid(spark, sf_dir):
    """The same by the distance of their shares of vowels."""
    turns, docs = (df.withColumn("topic_distribution", vectors.normalize(F.col("topic_distribution"))) for df in _turns_and_documents(spark, sf_dir))
    found = MetricIndex.build(docs, scratch_path(spark, "index"), "euclid").search(turns, 5)
    return found.select("id1", "id2", F.round("distance", 6).alias("distance"), "rank")


# Topics


def _topic_rows(described):
    words = F.arrays_zip("words", "term_weights")
    return described.select("topic", F.posexplode(words).alias("pos", "term")).select(
        "topic", "pos", F.col("term.words").alias("word"), F.col("term.term_weights").alias("weight")
    )


def _training(spark, sf_dir):
    return tokenized(spark, sf_dir, stop_words=STOP_WORDS)


def lda_topics(spark, sf_dir):
    return _topic_rows(topic_modelling.count_topics(_training(spark, sf_dir))[1])


def topics_count_idf(spark, sf_dir):
    return _topic_rows(topic_modelling.count_idf_topics(_training(spark, sf_dir), weighting="tfidf")[1])


def topics_hashing_idf(spark, sf_dir):
    return topic_modelling.hashing_idf_topics(_training(spark, sf_dir))[1]


def topic_distribution(spark, sf_dir):
    """Train on the documents, label conversations and pages with the same vocabulary."""
    turns = table(spark, sf_dir, "conversations").select(
        F.format_string("conversation %d turn %d", "conv_id", "turn").alias("doc_id"), F.col("text").alias("content")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.format_string("page %d", "page_id").alias("doc_id"), F.col("html").alias("content")
    )
    others = {
        name: topic_modelling.tokenized_corpus(docs, stop_words=STOP_WORDS, titles=True, document_numbers="bracket", **TOKENS)
        for name, docs in {"conversations": turns, "pages": pages}.items()
    }
    _, _, labelled = topic_modelling.topics_across(_training(spark, sf_dir), others)
    return corpus.union_corpora(labelled)


def _sharded(spark, sf_dir, **options):
    return sharded_topics.fitted(_training(spark, sf_dir).select("tokens"), **{"k": 10, "rounds": 5, **options})


def sharded_topic_words(spark, sf_dir):
    """Every term of a trained model with what its topics hold of it, which together is its number of occurrences."""
    model = _sharded(spark, sf_dir)
    held = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w - model.eta)
    return model.topics.select("term", F.round(held, 4).alias("held"))


def sharded_topic_idf_words(spark, sf_dir):
    """The same, trained on counts times inverse document frequency."""
    model = _sharded(spark, sf_dir, weighting="tfidf")
    held = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w - model.eta)
    return model.topics.select("term", F.round(held, 3).alias("held"))


def sharded_topic_shape(spark, sf_dir):
    """Per topic: its number of described terms, whether their weights fall, and whether it is a distribution over all terms."""
    model = _sharded(spark, sf_dir)
    described = model.describe(15).withColumn("falls", F.coalesce(F.lag("weight").over(Window.partitionBy("topic").orderBy("pos")) >= F.col("weight"), F.lit(True)))
    whole = model.topics.select(F.posexplode("weights").alias("topic", "w")).groupBy("topic").agg(F.round(F.sum("w") / F.sum("w"), 6).alias("share"), F.min("w").alias("least"))
    shape = described.groupBy("topic").agg(F.count("*").alias("terms"), F.min("falls").alias("falls"), F.sum("weight").alias("top"))
    return shape.join(whole, "topic").select("topic", "terms", "falls", ((F.col("top") > 0) & (F.col("top") <= 1) & (F.col("least") >= model.eta)).alias("shares"))


def sharded_topic_labels(spark, sf_dir):
    """Train on the documents, label turns and pages: known tokens, whether shares add up, whether the label is the largest share."""
    model = _sharded(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(F.format_string("turn %d %d", "conv_id", "turn").alias("doc_id"), F.col("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(F.format_string("page %d", "page_id").alias("doc_id"), F.col("html").alias("content"))
    both = tokens.tokenize(turns.unionByName(pages), stop_words=STOP_WORDS, **TOKENS)
    labelled = model.assign(both)
    total = F.round(F.aggregate("topic_distribution", F.lit(0.0), lambda a, x: a + x), 6)
    first = F.col("topic_num").eqNullSafe(vectors.argmax(F.col("topic_distribution")))
    return labelled.select("doc_id", "n_known", total.alias("total"), first.alias("first"))


def topics_label_compare(spark, sf_dir):
    """One job: train on the documents, label turns and benchmark items, and find every item's nearest turns by their topics."""
    model = _sharded(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), F.col("text").alias("content"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"))
    found = topic_modelling.label_and_compare(model, *(tokens.tokenize(d, stop_words=STOP_WORDS, **TOKENS) for d in (items, turns)), path=scratch_path(spark, "index"))
    return found.select("id1", "id2", F.round("distance", 6).alias("kl"), "rank")


def topics_parquet_roundtrip(spark, sf_dir):
    _, described = topic_modelling.count_topics(_training(spark, sf_dir), optimizer="online")
    path = scratch_path(spark, "topics")
    topics.save_topics(described, path)
    return _topic_rows(spark.read.parquet(path))


def model_roundtrip(spark, sf_dir):
    training = _training(spark, sf_dir)
    path = scratch_path(spark, "model")
    topics.save_model(topics.fit_topics(training, k=10, optimizer="online"), path)
    return topics.assign_topics(topics.load_model(path), training)


# Clusters


def sentence_clusters(spark, sf_dir):
    return clustering.sentence_clusters(documents(spark, sf_dir), **TOKENS)


def sentence_clusters_whole(spark, sf_dir):
    """Every whole sentence as a single token."""
    return clustering.sentence_clusters(documents(spark, sf_dir), unit="sentence")


def digest_clusters(spark, sf_dir):
    return clustering.keyword_line_clusters(spark, keyword_file(spark, sf_dir))


def topic_word_clusters(spark, sf_dir):
    """Topics from a saved table, clustered by their words."""
    _, described = topic_modelling.count_topics(_training(spark, sf_dir), optimizer="online")
    path = scratch_path(spark, "topics")
    topics.save_topics(described, path)
    return clustering.topic_word_clusters(spark.read.parquet(path), min_count=1)


ALL = [
    corpus_scan, corpus_projected_limit, corpus_nonempty, corpus_remap, corpus_union, corpus_clean,
    corpus_distinct_with_id, stopwords_table, text_lines_scan, vector_csv_roundtrip, decode_text,
    tokenize, token_filter, tokens_stopword_anti, tokens_tag_filter, strip_whitespace, extract_titles,
    drop_doc_numbers, sentence_split, sentence_words, parse_keyword_line, han_tokens, han_cover,
    term_frequency, document_frequency, tfidf, count_vectors, idf_vectors, hashing_tf, hashing_tf_totals,
    word_vectors, list_concat_by_key, combine_lengths,
    sentence_graph_edges, textrank_scores, textrank_summary, textrank_personal, textrank_custom_similarity, token_window_pairs,
    word_vertices, word_graph_edges, keyword_rank, corpus_keyword_rank,
    topic_argmax, doc_similarity_kl_top5, doc_similarity_euclid_top5, doc_similarity_index_kl, doc_similarity_index_euclid,
    lda_topics, topics_count_idf, topics_hashing_idf, topic_distribution, topics_parquet_roundtrip, model_roundtrip,
    sharded_topic_words, sharded_topic_idf_words, sharded_topic_shape, sharded_topic_labels, topics_label_compare,
    sentence_clusters, sentence_clusters_whole, digest_clusters, topic_word_clusters,
]

QUERIES = {query.__name__: query for query in ALL}
