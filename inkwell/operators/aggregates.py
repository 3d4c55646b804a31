"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inkwell.operators.rows import RANGE_ROWS, exploded, in_ranges

SALTS = 32  # tasks that share a key's partial results before its last merge
HELD_KEYS = 100_000  # partial results that a task holds before it passes them on


def concat_lists(df: DataFrame, key: str, values: str, order_by: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Each key's lists laid end to end in ``order_by`` order, one row per element: ``(key, pos, value)``.

    Rows are laid out by ranges of (key, order), so a key of any size is spread over as many
    ranges as it fills. An element's position is its place in its list, after the lists before
    it in the range and after the ranges before. Lists with equal ``order_by`` come in the order of
    their values; NULL and empty lists have no elements.
    """
    lists = df.select(F.col(key).alias("_key"), F.col(order_by).alias("_order"), F.col(values).alias("_list"))
    laid = in_ranges(lists.where(F.size("_list") > 0), [F.asc("_key"), F.asc("_order"), F.asc("_list")], rows_per_range)
    ranges = laid.groupBy("_key", "_range").agg(F.sum(F.size("_list")).alias("_size"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_key", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", "_key").orderBy("_order", "_list").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("_before", F.coalesce(F.sum(F.size("_list")).over(inside), F.lit(0)))
    same_key = F.expr("_key <=> _k")
    offsets = offsets.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_offset")
    joined = placed.join(offsets, same_key & (F.col("_range") == F.col("_r")))
    start = (F.col("_offset") + F.col("_before")).alias("_start")
    items = exploded(joined, ["_key", start], "_list", "_i", "_item")
    return items.select(F.col("_key").alias(key), (F.col("_start") + F.col("_i")).alias("pos"), F.col("_item").alias("value"))


def combine_by_key(
    df: DataFrame,
    key: str,
    value: str,
    create: Callable[[Any], Any],
    merge_value: Callable[[Any, Any], Any],
    merge_combiners: Callable[[Any, Any], Any],
    combiner_type: str,
    salts: int = SALTS,
    held_keys: int = HELD_KEYS,
) -> DataFrame:
    """The caller's own aggregate: ``(key, combined)``, one row per key, NULL included.

    ``create`` makes a combiner of a key's first value, ``merge_value`` adds a value, ``merge_combiners`` joins two; values and
    combiners are plain Python objects, combiners of the Spark type ``combiner_type``. Values come in no fixed order, so the three
    must give the same whatever it is. Keys must be hashable in Python.

    Every task combines what it reads, so that a key's rows leave it as one; partial results of one key are merged by
    ``salts`` tasks and then by one, which holds one combiner at a time. Memory is ``held_keys`` combiners at most.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, combined {combiner_type}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def table(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), types.field(0).type), pa.array(list(held.values()), types.field(1).type)], ["key", "combined"])

    def combined(first: Callable, add: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[k] = add(held[k], v) if k in held else first(v)
                    if len(held) >= held_keys:
                        yield table(held)
                        held = {}
            if held:
                yield table(held)

        return work

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their keys."""
        held: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and k not in held:
                    yield table(held)
                    held = {}
                held[k] = merge_combiners(held[k], v) if k in held else v
        if held:
            yield table(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = rows.mapInArrow(combined(create, merge_value), schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = partial.repartition(parts, "key", "_salt").drop("_salt").mapInArrow(combined(lambda v: v, merge_combiners), schema)
    found = merged.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(last, schema)
    return found.select(F.col("key").alias(key), "combined")
