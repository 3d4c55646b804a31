"""Topic models: one pipeline is fitted on a training corpus and applied to every other.

Vocabulary and topics are tables, trained in blocks as in ``sharded_topics``: neither the driver nor a task ever holds them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import term_blocks, variational
from inkwell.operators import features, sharded_topics
from inkwell.operators.rows import numbered
from inkwell.operators.sharded_topics import ShardedTopics
from inkwell.session import delete_path, drop_tables, materialize, scratch_path, shuffles_deleted, working_tables

BATCH_SHARE, OFFSET, DECAY = 0.05, 1024, 0.51  # of online training
LEAST_BATCH_ENTRIES = 50_000  # of a block of a batch


class Counts:
    """The stage that counts terms: ``terms`` (term, index, df), most frequent first, ties by term."""

    def __init__(self, terms: DataFrame):
        self.terms = terms

    @property
    def vocabulary(self) -> list[str]:
        """All terms, collected to the driver."""
        return [row["term"] for row in self.terms.orderBy("index").select("term").collect()]


class Weights:
    """The stage that weighs terms by inverse document frequency: ``idf`` (term, idf)."""

    def __init__(self, terms: DataFrame, n_docs: int):
        self.idf = terms.select("term", sharded_topics.idf_of("df", n_docs).alias("idf"))


class Topics(ShardedTopics):
    """The stage that holds the topics, as they were trained on ``features`` or on their weights, ``idf``."""

    def getFeaturesCol(self) -> str:
        return "idf" if "idf" in self.topics.columns else "features"


class TopicModel:
    """A trained pipeline at ``path``: stages that count, weigh and infer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row, terms = spark.read.parquet(f"{path}/counted").first(), spark.read.parquet(f"{path}/terms")
        self.buckets, self.n_docs = row["buckets"], row["n_docs"]
        counts = features.hashing_tf(self.buckets) if self.buckets else Counts(terms)
        self.stages = [counts, Weights(terms, self.n_docs), Topics(spark, path)]


def fit_topics(
    tokenized: DataFrame,
    k: int = 20,
    weighting: str = "count",
    vectorizer: str = "count",
    optimizer: str = "em",
    max_iter: int = 20,
    seed: int = 1,
    vocab_size: int | None = None,
    min_df: int = 1,
    block_entries: int | None = None,
) -> TopicModel:
    """Count, weigh and train: a ``TopicModel`` that takes ``tokens``.

    ``weighting="count"`` trains on term counts; ``"tfidf"`` on TF-IDF weights. With
    ``"count"`` the terms' IDF is still produced. ``vectorizer`` is ``"count"`` or
    ``"hashing"``. ``optimizer="em"`` parts every occurrence of a term in a document among the topics
    in each of ``max_iter`` rounds over the corpus; ``"online"`` takes ``max_iter`` mini-batches of a
    twentieth of the documents, drawn with replacement, and is the choice for large corpora. Every term of the
    corpus is in the vocabulary unless ``vocab_size`` names fewer.

    Both follow Spark's trainers of these names. What is random comes from hashes of terms and documents, so that the result does
    not depend on how rows are laid out, but for rounding; copies of a document are drawn together.
    """
    spark, path = tokenized.sparkSession, scratch_path(tokenized.sparkSession, "topic-model")
    buckets = (vocab_size or features.BUCKETS) if vectorizer == "hashing" else None
    with working_tables(spark) as work:
        rows = _counted(tokenized, buckets, F.xxhash64("doc_id", "tokens"))
        n_docs, weighted = rows.count(), weighting == "tfidf"
        if optimizer == "em":
            docs, terms, blocks = sharded_topics.laid_out(rows, block_entries)
            totals = sharded_topics.vocabulary_of(terms)
        else:
            totals = rows.select("terms", "n").mapInArrow(term_blocks.term_totals, "term string, df long, total long")
            totals = sharded_topics.vocabulary_of(totals)
            batch = math.ceil(BATCH_SHARE * sharded_topics.entries(rows))
            draw = _drawn(max_iter, seed)
            docs, terms, blocks = sharded_topics.laid_out(rows, block_entries, batch, draw, LEAST_BATCH_ENTRIES)
        vocabulary = _vocabulary(totals, n_docs, buckets, vocab_size, min_df)
        (vocabulary, size), idf = sharded_topics.sharded(vocabulary), ["idf"] * weighted
        work.drop(rows)
        meets = sharded_topics.meetings(terms, vocabulary, idf)
        train = _em if optimizer == "em" else _online
        state, about = train(docs, meets, vocabulary, size, blocks, k, max_iter, seed, n_docs)
        sharded_topics.save(sharded_topics.unpacked(vocabulary, state, k, idf), path, k, *about)
        with shuffles_deleted(spark):
            vocabulary.select("term", "index", "df").write.parquet(f"{path}/terms")
        spark.createDataFrame([(buckets, n_docs)], "buckets int, n_docs long").coalesce(1).write.parquet(f"{path}/counted")
    return TopicModel(spark, path)


def _counted(tokenized: DataFrame, buckets: int | None, *named: Column) -> DataFrame:
    """(row, h, terms, n) of tokens, or of their buckets, written down; ``named`` is the hash, and columns to keep."""
    tokens = F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
    row, h, *kept = F.monotonically_increasing_id().alias("row"), named[0].alias("h"), *named[1:]
    if buckets is None:
        return sharded_topics.packed(tokenized.select(row, h, *kept, tokens))
    hashed = features.hashing_tf(buckets).transform(tokenized.withColumn("tokens", tokens))
    vector = F.unwrap_udt("features")
    parts = vector["indices"].cast("array<string>").alias("terms"), vector["values"].cast("array<int>").alias("n")
    return materialize(hashed.select(row, h, *kept, *parts), "rows")


def _vocabulary(totals: DataFrame, n_docs: int, buckets: int | None, size: int | None, min_df: int) -> DataFrame:
    """(term, df, total, idf, index). Indices follow the total, ties by term; those of buckets are their numbers."""
    if buckets is None:
        known = numbered(totals.where(F.col("df") >= min_df), [F.desc("total"), F.asc("term")], "index")
        known = known.where(F.col("index") < size) if size else known
    else:
        every = totals.sparkSession.range(buckets).select(F.col("id").cast("string").alias("term"), F.col("id").alias("index"))
        known = every.join(totals, "term", "left").na.fill(0)
    return known.withColumn("idf", sharded_topics.idf_of("df", n_docs))


def _drawn(batches: int, seed: int) -> Column:
    """The batches that a document is in, once for each time: Poisson draws from its hash."""

    def times(t: Column) -> Column:
        u = (F.pmod(F.xxhash64("h", t, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        at_most = np.cumsum([math.exp(-BATCH_SHARE) * BATCH_SHARE**i / math.factorial(i) for i in range(8)])
        return sum((u > float(p)).cast("int") for p in at_most)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(batches - 1)), lambda t: F.array_repeat(t, times(t))))


def _em(docs, meets, vocabulary, size: int, blocks: int, k: int, rounds: int, seed: int, n_docs: int):
    """Expectation-maximisation: topics hold their terms' counts, documents theirs, and every round parts all counts anew by both."""
    alpha, eta, every = 50 / k + 1, 1.1, range(blocks)

    def begun(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows or not known.num_rows:
            return term_blocks.NOTHING
        known = term_blocks.Parts(known, 1)  # the terms' hashes
        block = term_blocks.Block(docs, known)
        held, added = variational.parted_at_random(block.n, block.starts, block.word, block.weights[:, 0].view(np.uint64), block.hashes, k, seed)
        return known.returned(added, block.states_of(held))

    def going(totals: np.ndarray):
        def moved(docs: pa.Table, known: pa.Table) -> pa.Table:
            if not docs.num_rows or not known.num_rows:
                return term_blocks.NOTHING
            known = term_blocks.Parts(known, k)
            block = term_blocks.Block(docs, known)
            words = (block.weights + (eta - 1)) / (totals + (eta - 1) * size)
            held, added = variational.parted(block.n, block.starts, block.word, words, block.states.reshape(-1, k) + (alpha - 1))
            return known.returned(added, block.states_of(held))

        return moved

    hashes = materialize(vocabulary.select("key", "pos", F.array(F.xxhash64("term")).alias("weights")).groupBy("key").applyInArrow(term_blocks.packed_state, "key bigint, weights binary"), "hashes")
    state = sharded_topics.round_of(docs, meets, hashes, begun, every, k, width=1)
    for _ in range(rounds):
        topics, states = state.where("key >= 0"), state.where("key < 0")
        number = -1 - F.col("key")
        place = F.shiftright(number, 24).cast("int").alias("block"), number.bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("at")
        both = docs.unionByName(states.select(*place, F.col("weights").alias("state")), allowMissingColumns=True)
        before, state = state, sharded_topics.round_of(both, meets, topics, going(sharded_topics.totals_of(topics, k)), every, k)
        drop_tables(before)
    topics = state.where("key >= 0")
    return topics, (alpha, eta, sharded_topics.totals_of(topics, k))


def _online(docs, meets, vocabulary, size: int, blocks: int, k: int, batches: int, seed: int, n_docs: int):
    """Variational Bayes by mini-batches: topics move towards what each batch alone would make of them, ever less; so does ``alpha``.

    The table holds (weights - eta) / scale, where scale is the product of all 1 - rho, so that terms not in a batch stay as they are."""
    eta, alpha, scale, done = 1 / k, np.full(k, 1 / k), 1.0, 0
    start = F.transform(sharded_topics.initial_weights(k, seed), lambda x: x - eta)
    state = sharded_topics.packed_by(vocabulary.select("key", "pos", start.alias("weights")))

    def batch(totals: np.ndarray, alpha: np.ndarray, scale: float, by: float):
        def added(docs: pa.Table, known: pa.Table) -> pa.Table:
            if not docs.num_rows or not known.num_rows:
                return term_blocks.NOTHING
            known = term_blocks.Parts(known, k)
            block = term_blocks.Block(docs, known)
            factors = variational.topic_factors(block.weights * scale + eta, totals)
            gamma = variational.mixtures(block.n, block.starts, block.word, factors, alpha)
            found = variational.statistics(gamma, block.n, block.starts, block.word, factors, block.terms)
            some = gamma[np.bincount(np.repeat(np.arange(len(block.size)), block.size), block.n, len(block.size)) > 0]
            mean = (variational.digamma(some) - variational.digamma(some.sum(axis=1))[:, None]).sum(axis=0)
            about = [(term_blocks.state_key(block.number, 0), term_blocks.bound(np.append(mean, float(len(some)))))]
            return known.returned(found * by, about)

        return added

    share = math.ceil(BATCH_SHARE * n_docs)
    for t in range(batches):
        here = range(t * blocks, (t + 1) * blocks)
        if docs.where(F.col("block").between(here.start, here.stop - 1)).isEmpty():
            continue  # a batch without terms
        done += 1
        rho = (OFFSET + done) ** -DECAY
        totals = sharded_topics.totals_of(state, k, missing=0.0) * scale + eta * size
        after = scale * (1 - rho)
        step = batch(totals, alpha, scale, rho * n_docs / share / after)
        before, moved = state, sharded_topics.round_of(docs, meets, state, step, here, k, so_far=state)
        drop_tables(before)
        state, scale = moved.where("key >= 0"), after
        state._written_at = moved._written_at
        found = [np.frombuffer(row["weights"]) for row in moved.where("key < 0").select("weights").collect()]  # one row a block
        if found and (means := sum(found))[k]:
            alpha = _alpha(alpha, means[:k] / means[k], means[k], rho)

    def scaled(batches):
        for batch in batches:
            weights = [term_blocks.bound(np.frombuffer(x.as_buffer()) * scale + eta) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.binary())], ["key", "weights"])

    found = materialize(state.mapInArrow(scaled, "key bigint, weights binary"), "topics")
    return found, ([float(x) for x in alpha], eta, sharded_topics.totals_of(found, k))


def _alpha(alpha: np.ndarray, mean: np.ndarray, n: float, rho: float) -> np.ndarray:
    """A step of Newton's method towards the prior under which documents' mixtures are likeliest, if it stays positive."""
    gradient = n * (variational.digamma(alpha.sum()) - variational.digamma(alpha) + mean)
    c, q = n * variational.trigamma(alpha.sum()), -n * variational.trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - rho * (gradient - b) / q
    return moved if (moved > 0).all() else alpha


def describe_topics(model: TopicModel, terms: int = 10) -> DataFrame:
    """``(topic, term_indices, words, term_weights)``, heaviest term first.

    Hashed features have no vocabulary, so their ``words`` are NULL.
    """
    top = model.stages[-1].describe(terms).join(model.spark.read.parquet(f"{model.path}/terms").select(F.col("term").alias("word"), "index"), "word")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("index").cast("int").alias("i"), "word", "weight")))
    rows = top.groupBy("topic").agg(listed.alias("t")).orderBy("topic")
    words = F.lit(None).cast("array<string>") if isinstance(model.stages[0], HashingTF) else F.col("t.word")
    return rows.select("topic", F.col("t.i").alias("term_indices"), words.alias("words"), F.col("t.weight").alias("term_weights"))


def assign_topics(model: TopicModel, tokenized: DataFrame) -> DataFrame:
    """``(doc_id, topic_num, topic_distribution array<double>)`` for any corpus.

    The fitted vocabulary is used whatever the corpus. A document without a known token
    keeps its row with an all-zero distribution and a NULL topic.
    """
    with working_tables(model.spark) as work:
        rows = _counted(tokenized, model.buckets, F.lit(0).cast("long"), F.col("doc_id"))
        labelled = model.stages[-1].labelled(rows)
        return work.keep(labelled.select("doc_id", "topic_num", "topic_distribution"), "labelled")


def save_model(model: TopicModel, path: str) -> None:
    for name in ("topics", "about", "terms", "counted"):
        model.spark.read.parquet(f"{model.path}/{name}").write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(path: str) -> TopicModel:
    return TopicModel(SparkSession.active(), path)


def drop(model: TopicModel) -> None:
    delete_path(model.spark, model.path)


def save_topics(topics: DataFrame, path: str, mode: str = "error") -> None:
    topics.select("topic", "words", "term_weights").write.mode(mode).parquet(path)
