"""Term counts, document frequencies and word vectors."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import kernels
from inkwell.operators.joins import SHARD_ROWS, join_counted
from inkwell.operators.rows import exploded, numbered
from inkwell.operators.word_vectors import WordVectors
from inkwell.session import materialize

BUCKETS = 1 << 18  # of hashed counts, unless given


def term_frequency(tokenized: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``. A row's tokens are counted in the row, without a shuffle.

    Only ids that several rows hold are counted over rows; whether there are any is found from the ids alone."""
    rows = tokenized.select("doc_id", "tokens")
    repeated = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")), "repeated-ids")
    if repeated.isEmpty():
        return _counted(rows)
    known = F.col("doc_id").eqNullSafe(F.col("_id"))
    parts = _counted(rows.join(repeated, known, "left_semi")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return _counted(rows.join(repeated, known, "left_anti")).unionByName(parts)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(kernels.term_counts, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, term string, tf long")


def document_frequency(tokenized: DataFrame) -> DataFrame:
    """``(term, df)``. Repeats vanish inside each document, so no distinct count is shuffled."""
    terms = exploded(tokenized, [], F.array_distinct("tokens"), "term")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def inverse_document_frequency(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1))


def tfidf(tokenized: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, term, tf, df, tfidf)``; token-less documents count in the number of documents.

    Document frequencies come from the term counts, which are written down, so the corpus is tokenised
    once. A term found in a large share of all documents is spread over shards.
    """
    tf = materialize(term_frequency(tokenized), "counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n_docs = tokenized.select(F.count("*")).scalar()
    joined = join_counted(tf, df, "term", "doc_id", F.col("df"), shard_rows)
    return joined.select(
        "doc_id", "term", "tf", "df",
        (F.col("tf") * inverse_document_frequency(F.col("df"), n_docs)).alias("tfidf"),
    )


def vocabulary(tokenized: DataFrame, min_df: int = 1) -> DataFrame:
    """``(term, df, index)``: every term found in ``min_df`` documents, the most frequent first, ties by term.

    A distributed table of any size; nothing of it reaches the driver.
    """
    terms = document_frequency(tokenized).where(F.col("df") >= min_df)
    return numbered(terms, [F.desc("df"), F.asc("term")], "index")


def count_entries(tokenized: DataFrame, terms: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Sparse count vectors as rows ``(doc_id, index, term, tf, df)``, over ``terms`` from :func:`vocabulary`."""
    terms = vocabulary(tokenized) if terms is None else terms
    joined = join_counted(term_frequency(tokenized), terms, "term", "doc_id", F.col("df"), shard_rows)
    return joined.select("doc_id", "index", "term", "tf", "df")


def idf_entries(tokenized: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Sparse TF-IDF vectors as rows ``(doc_id, index, term, tfidf)``; token-less documents count."""
    n_docs = tokenized.select(F.count("*")).scalar()
    weight = F.col("tf") * inverse_document_frequency(F.col("df"), n_docs)
    return count_entries(tokenized, terms).select("doc_id", "index", "term", weight.alias("tfidf"))


def count_vectorizer(tokenized: DataFrame, vocab_size: int | None = None, min_df: int = 1, output: str = "features"):
    """A fitted count model for trainers that take vectors.

    It holds every term found in ``min_df`` documents on the driver, about 100 bytes each; only a
    caller who names ``vocab_size`` gets fewer. Terms with equal counts come in no fixed order, so
    results name terms and never their indices.
    """
    size = vocab_size or max(1, document_frequency(tokenized).where(F.col("df") >= min_df).count())
    return CountVectorizer(inputCol="tokens", outputCol=output, vocabSize=size, minDF=min_df).fit(tokenized)


def hashing_tf(buckets: int = BUCKETS, output: str = "features") -> HashingTF:
    return HashingTF(inputCol="tokens", outputCol=output, numFeatures=buckets)


def idf(output: str = "idf", source: str = "features") -> IDF:
    return IDF(inputCol=source, outputCol=output)


def sparse_entries(vectors: DataFrame, vector_col: str, id_col: str = "doc_id") -> DataFrame:
    """A sparse vector's stored entries as rows ``(id, index, value)``, read without leaving the JVM."""
    parts = F.unwrap_udt(F.col(vector_col))
    entries = F.arrays_zip(parts["indices"].alias("index"), parts["values"].alias("value"))
    return vectors.select(id_col, F.inline(entries))


def hashed_words(tokenized: DataFrame, buckets: int, tokens_col: str = "tokens") -> DataFrame:
    """Words replaced by one of ``buckets`` hash buckets; words that share a bucket will share a vector."""
    bucket = F.transform(tokens_col, lambda word: F.pmod(F.xxhash64(word), F.lit(buckets)).cast("string"))
    return tokenized.withColumn(tokens_col, bucket)


def fit_word_vectors(
    tokenized: DataFrame,
    size: int = 100,
    min_count: int = 1,
    seed: int = 1,
    partitions: int | None = None,
    buckets: int | None = None,
    tokens_col: str = "tokens",
):
    """Train skip-gram word vectors; returns the model and the documents as it expects them.

    Training runs in ``partitions`` parts, the session's parallelism unless given, and more when a part would grow
    too large for a task. Vectors are a table, so the vocabulary may have any size; words are hashed only when a caller
    names a number of ``buckets``. With an explicit seed and the same layout of the documents, results repeat.
    """
    partitions = partitions or tokenized.sparkSession.sparkContext.defaultParallelism
    docs = hashed_words(tokenized, buckets, tokens_col) if buckets else tokenized
    return WordVectors.fit(docs, size, min_count, seed, partitions, tokens_col), docs
