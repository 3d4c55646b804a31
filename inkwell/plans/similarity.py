"""Nearest documents between two labelled collections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from inkwell.operators.similarity import nearest


def nearest_documents(labelled: DataFrame, among: DataFrame, k: int = 5, metric: str = "kl", **options) -> DataFrame:
    """For each row of ``labelled`` its ``k`` nearest in ``among``, both from ``assign_topics``."""
    return nearest(labelled, among, k, metric, left_id="doc_id", right_id="doc_id", **options)
