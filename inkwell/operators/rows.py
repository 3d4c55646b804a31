"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize

RANGE_ROWS = 1_000_000  # rows that one range of an ordered table is meant to hold


def exploded(df: DataFrame, keep: list, array: Column | str, *names: str) -> DataFrame:
    """One row per array element: ``names`` is (element) or (position, element).

    For a plain explode the optimizer infers a filter on the array's size, pushes it down
    to the scan and so computes the array twice. The outer form computes it once; the
    rows it adds for empty arrays are dropped by their NULL element.
    """
    generator = F.explode_outer(array) if len(names) == 1 else F.posexplode_outer(array)
    return df.select(*keep, generator.alias(*names)).where(F.col(names[-1]).isNotNull())


def exploded_structs(df: DataFrame, keep: list[str], array: Column | str) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    return exploded(df, keep, array, "_item").select(*keep, "_item.*")


def in_ranges(df: DataFrame, order: list[Column], rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """``df`` written down in ranges of ``order``, with the range's number as ``_range``."""
    laid = materialize(df, "rows")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-laid.count() // rows_per_range))
    return materialize(laid.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Number all rows from 0 in ``order`` without one task seeing them all.

    Rows are numbered inside their range; the ranges before are added up over one row per range.
    """
    laid = in_ranges(df, order, rows_per_range)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = laid.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_range", "_before", "_n")
