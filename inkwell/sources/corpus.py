"""Reading, shaping and writing document collections.

Any Spark format works: a document store is a format name and its options.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The common corpus schema, and where raw web pages keep each field.
CORPUS_FIELDS = {"title": "string", "time": "string", "html": "string", "org": "string"}
WEB_PAGE_FIELDS = {"title": "title", "time": "publicTime", "html": "html", "org": "puborg"}


def read_table(
    spark: SparkSession,
    fmt: str = "parquet",
    path: str | None = None,
    schema: StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give per-document work every core, at the price of one shuffle of a small input.

    For a reader's output. An input that already scans in at least as many partitions as
    there are cores, as any large one does, comes back unchanged and is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def document_id(column: str | Column) -> Column:
    """Id column, also from a store's id structure by its field, e.g. ``"_id.oid"``."""
    return (F.col(column) if isinstance(column, str) else column).alias("doc_id")


def corpus(df: DataFrame, text_col: str = "html", id_col: str | None = "doc_id") -> DataFrame:
    """The columns a text job needs, under their working names ``doc_id`` and ``content``."""
    text = F.col(text_col).alias("content")
    return df.select(text) if id_col is None else df.select(document_id(id_col), text)


def clean(docs: DataFrame) -> DataFrame:
    """Whole rows once each, without missing text.

    Missing text is dropped before the distinct so those rows are never shuffled, and
    copies collapse inside each partition before the shuffle.
    """
    return docs.na.drop(how="any", subset="content").distinct()


def nonempty(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("content") > 0)


def first_documents(docs: DataFrame, n: int, order_by: str = "doc_id") -> DataFrame:
    """The first ``n`` documents by id: a distributed top-n, never a full sort."""
    return docs.orderBy(order_by).limit(n)


def remap(df: DataFrame, fields: Mapping[str, str | None] = WEB_PAGE_FIELDS, id_col: str = "doc_id") -> DataFrame:
    """A source in the common corpus schema; fields it lacks become NULL."""
    present = set(df.columns)

    def field(name: str, kind: str) -> Column:
        source = fields.get(name)
        column = F.col(source) if source in present else F.lit(None)
        return column.cast(kind).alias(name)

    return df.select(document_id(id_col), *[field(name, kind) for name, kind in CORPUS_FIELDS.items()])


def union_corpora(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """Remapped sources one after another, tagged with their name: a union, so no shuffle."""
    tagged = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    return reduce(DataFrame.unionByName, tagged)


def save(df: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str = "error", **options) -> None:
    """Write to any Spark format; like Spark's own default, an existing target is an error."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if path:
        writer.save(path)
    else:
        writer.save()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as ``content``."""
    return spark.read.text(path).select(F.col("value").alias("content"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One stop word per line, trimmed, once each, as column ``word``."""
    from inkwell.functions.text import trim_space

    return spark.read.text(path).select(trim_space(F.col("value")).alias("word")).distinct()


def stop_word_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(word,) for word in sorted(set(words))], "word string")
