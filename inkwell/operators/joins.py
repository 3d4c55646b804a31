"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over several shards of the join.
SHARD_ROWS = 2_000_000


def shards_for(rows: Column, shard_rows: int = SHARD_ROWS) -> Column:
    """How many shards a key with this many rows needs."""
    return F.greatest(F.ceil(rows / F.lit(float(shard_rows))), F.lit(1)).cast("int")


def join_counted(
    facts: DataFrame,
    keyed: DataFrame,
    key: str,
    spread_by: str,
    rows: Column,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Inner-join ``facts`` to ``keyed``, one row per ``key``, whose ``rows`` counts its facts.

    Keys above ``shard_rows`` are hot. A hot fact row goes to the shard its ``spread_by``
    value hashes to, and the hot row of ``keyed`` is repeated once per shard; every other
    key stays in shard 0. The broadcast holds hot keys only, so at most
    (all facts / ``shard_rows``) of them. The join itself carries no hint: Catalyst
    broadcasts what it measures as small and otherwise sorts and merges.
    """
    sized = keyed.withColumn("_shards", shards_for(rows, shard_rows))
    hot = sized.where("_shards > 1").select(key, "_shards")
    placed = (
        facts.join(F.broadcast(hot), key, "left")
        .withColumn("_shard", F.coalesce(F.expr(f"pmod(xxhash64({spread_by}), _shards)"), F.lit(0)).cast("int"))
        .drop("_shards")
    )
    repeated = sized.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).drop("_shards")
    return placed.join(repeated, [key, "_shard"]).drop("_shard")
