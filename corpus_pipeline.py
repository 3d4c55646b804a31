"""From raw documents to packed sequences: each stage reads what the one before wrote.

All stages but the last return documents with the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup, jaccard_join, language_id, packing, pii
from inkwell.llm.queries import BYTE_BPE
from inkwell.session import materialize, working_tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with a language in doubt, go."""
    return language_id.accepted(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.kept(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar texts (five words, 0.8) the document with the smallest id stays."""
    return jaccard_join.representatives(docs, words=5, num=4, den=5)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text."""
    size = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return pii.redact(docs).withColumn("n_chars", size)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("pii", private),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # language models, fields and tokenizers are beyond SQL; tests hold the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with working_tables(spark) as work:
        for name, stage in STAGES:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            work.drop(before)  # a stage's input goes when its output is written
        return work.keep(docs)
