"""Extractive summaries and keyword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import graph
from inkwell.operators.rows import exploded_structs


def summaries(docs: DataFrame, num: int = 3, min_length: int = 6, **options) -> DataFrame:
    """``(doc_id, html array<string>)``: each document's best sentences, in rank order."""
    picked = graph.summary(F.col("ranked"), num, min_length)
    ranked = graph.score_sentences(docs, **options)
    return ranked.select("doc_id", F.transform(picked, lambda item: item["sentence"]).alias("html"))


def key_sentences(docs: DataFrame, num: int = 6, min_length: int = 6, **options) -> DataFrame:
    """The same sentences as rows: ``(doc_id, rank, idx, sentence, weight)``; ``rank`` is the overall rank."""
    ranked = graph.score_sentences(docs, **options)
    return exploded_structs(ranked, ["doc_id"], graph.summary(F.col("ranked"), num, min_length))
