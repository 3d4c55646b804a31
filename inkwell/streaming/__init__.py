"""File streams as a corpus.

The text, tokenising and summarising functions work on one row at a time, so they accept
the stream this returns exactly as they accept a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.sources.corpus import corpus


def stream_corpus(
    spark: SparkSession, fmt: str, path: str, schema, text_col: str = "html", id_col: str | None = "doc_id"
) -> DataFrame:
    return corpus(spark.readStream.format(fmt).schema(schema).load(path), text_col, id_col)
