"""Lookups by id lists, and block pruning by zone maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requests of up to so many ids are also pushed to the scan as an IN list, and broadcast.
PUSHED_IDS = 10_000


def requests(spark: SparkSession, ids: Sequence[int]) -> DataFrame:
    """pos (from 0), req_id."""
    if not 0 < len(ids) <= PUSHED_IDS:
        return spark.createDataFrame(list(enumerate(ids)), "pos int, req_id long")
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("pos", "req_id"))


def lookup(entities: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """pos, req_id and the entity's columns for each request: duplicates stay, a missing id gives nulls.

    ids: a list, or a DataFrame (pos, req_id) of any size.  Rows carry pos; sort by it to get request order.
    """
    if isinstance(ids, DataFrame):
        return ids.join(entities, F.col("req_id") == F.col("id"), "left")
    asked = requests(entities.sparkSession, ids)
    if len(ids) > PUSHED_IDS:
        return asked.join(entities, F.col("req_id") == F.col("id"), "left")
    found = F.broadcast(entities.where(F.col("id").isin(sorted(set(ids)))))  # no more rows than requests: ids are unique
    return asked.join(found, F.col("req_id") == F.col("id"), "left")


def prune_blocks(blobs: DataFrame, ids: Sequence[int], kind: str) -> DataFrame:
    """Blocks whose id range of that kind holds one of the ids; a null range holds none."""
    wanted = F.array(*(F.lit(i).cast("long") for i in sorted(set(ids))))
    low, high = F.col(f"min_{kind}_id"), F.col(f"max_{kind}_id")
    return blobs.where(F.exists(wanted, lambda i: (i >= low) & (i <= high)))


def misses(wanted: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    """Rows of wanted whose key the cache lacks."""
    return wanted.join(cached.select(key), key, "left_anti")


def position_in(values, value):
    """Place of value in an array from 0, -1 if it isn't there."""
    return F.array_position(values, value) - 1
