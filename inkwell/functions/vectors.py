"""Numeric vectors (``array<double>``) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def parse_vector(text: Column) -> Column:
    """``"[0.1,0.2]"`` or ``"0.1,0.2"`` as an array of doubles."""
    bare = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.transform(F.split(bare, ","), lambda x: x.cast("double"))


def format_vector(values: Column) -> Column:
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


def object_id(text: Column) -> Column:
    """The quoted part of a rendered id such as ``Row(oid='5c1f')``."""
    return F.regexp_extract(text, "'([^']*)'", 1)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(values: Column) -> Column:
    """Scaled to sum 1; NULL elements for a zero vector."""
    return _let(_total(values), lambda total: F.transform(values, lambda x: F.try_divide(x, total)))


def softmax(values: Column) -> Column:
    return _let(F.transform(values, lambda x: F.exp(x.cast("double"))), normalize)


def kl_divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of ``p`` from ``q``, natural logarithm.

    Both sides are scaled to sum 1 first. NULL for unequal lengths or a zero
    vector; infinite where ``q`` is zero and ``p`` is not.
    """

    def term(x: Column, y: Column) -> Column:
        return F.when(x == 0, 0.0).when(y == 0, float("inf")).otherwise(x * F.ln(x / y))

    usable = (F.size(p) == F.size(q)) & (_total(p) > 0) & (_total(q) > 0)
    return F.when(usable, _total(F.zip_with(normalize(p), normalize(q), term)))


def euclidean_distance(a: Column, b: Column) -> Column:
    """NULL for unequal lengths."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(_total(squares)))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """``1 / (1 + distance)``: larger is closer."""
    return 1 / (1 + euclidean_distance(a, b))


def argmax(values: Column) -> Column:
    """0-based position of the first largest element; NULL for an all-zero vector."""
    top = F.array_max(values)
    return F.when(top > 0, (F.array_position(values, top) - 1).cast("int"))
