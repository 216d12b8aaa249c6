"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import drop_scratch, join_unique, materialize


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable from each vertex that has an edge.

    edges: columns u, v (long); direction, repeats and loops don't matter; rows with a null end are ignored.
    Edges stay distributed; each round is written to the shared folder.  The rounds needed grow with the
    logarithm of the size, also for long chains.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull().__and__(F.col("v").isNotNull()).alias("ok"))
    e = materialize(e.where("ok and u > v").drop("ok").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
        large = join_unique(both, least, "u", "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        joined = join_unique(large, least, "u", "w")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialize(small, "small-star")
        drop_scratch(old, large)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    out = e.groupBy("u").agg(F.min("v").alias("v"))
    roots = out.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return out.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
