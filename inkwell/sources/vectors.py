"""Topic vectors as CSV text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.vectors import format_vector, object_id, parse_vector

CSV_SCHEMA = "id string, topic_num int, topicDistribution string"


def write_vector_csv(vectors: DataFrame, path: str, mode: str = "error") -> None:
    """``(id, topic_num, topic_distribution array<double>)`` as CSV with a header.

    Executors write their own parts; nothing passes through the driver.
    """
    vectors.select(
        F.col("id").cast("string").alias("id"),
        "topic_num",
        F.concat(F.lit("["), format_vector(F.col("topic_distribution")), F.lit("]")).alias("topicDistribution"),
    ).write.mode(mode).csv(path, header=True, escape='"')


def read_vector_csv(spark: SparkSession, path: str, rendered_ids: bool = False) -> DataFrame:
    """Vectors written by ``write_vector_csv``; ``rendered_ids`` unwraps ids like ``Row(oid='…')``."""
    rows = spark.read.csv(path, header=True, schema=CSV_SCHEMA, escape='"')
    key = object_id(F.col("id")) if rendered_ids else F.col("id")
    return rows.select(
        key.alias("id"), "topic_num", parse_vector(F.col("topicDistribution")).alias("topic_distribution")
    )
