"""Block statistics, totals and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.tags import rendered

KINDS = ("node", "way", "relation")


def block_stats(ids: DataFrame, size: int) -> DataFrame:
    """block, n, min_id, max_id of blocks of `size` ids."""
    return ids.groupBy(F.floor((F.col("id") - 1) / size).alias("block")).agg(F.count("*").alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def by_entity(blobs: DataFrame) -> DataFrame:
    """entity, pbf_ofs, n of the blocks that hold any."""
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), F.col(f"{k}_count").alias("n")) for k in KINDS))).alias("e")
    return blobs.select("pbf_ofs", stacked).where("e.n > 0").select("e.entity", "pbf_ofs", "e.n")


def totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(*(F.sum(f"{k}_count").alias(f"{k}s") for k in KINDS))


def byte_totals(blobs: DataFrame) -> DataFrame:
    """Stored bytes, and bytes with every payload inflated."""
    return blobs.agg(F.sum("blob_len").alias("stored"), F.sum(F.col("blob_len") - F.col("zlib_len") + F.col("raw_size")).alias("inflated"))


def blob_text(blob: dict[str, Column]) -> Column:
    """A blob in one line: its place, sizes and counts, and the id range of the first kind that it has."""
    own = {"pbfOfs": blob["pbf_ofs"], "blobLen": blob["blob_len"], "rawSize": blob["raw_size"], "zlibOfs": blob["zlib_ofs"], "zlibLen": blob["zlib_len"]}
    own |= {f"{k}Count": blob[f"{k}_count"] for k in KINDS}
    out = rendered(**own)
    for k in reversed(KINDS):
        ranged = own | {f"min{k.title()}Id": blob[f"min_{k}_id"], f"max{k.title()}Id": blob[f"max_{k}_id"]}
        out = F.when(blob[f"{k}_count"] > 0, rendered(**ranged)).otherwise(out)
    return out


def member_text(kind: Column, ref: Column, role: Column) -> Column:
    """A member in one line, its id named after its kind."""
    out = rendered(type=kind, memberId=ref, role=role)
    for i, k in enumerate(KINDS):
        out = F.when(kind == i, rendered(type=F.lit(k.title()), **{f"{k}Id": ref}, role=role)).otherwise(out)
    return out


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, code: codes from 0 by first appearance; one row a distinct value is ranked."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first", value)) - 1).alias("code"))
