"""Zigzag, varint and delta coding as Column expressions; histograms of values and of their steps."""

from __future__ import annotations

import gzip
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.sources.wire import varints


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def varint_length(u: Column) -> Column:
    """Bytes of the base-128 coding of a long read as unsigned."""
    bits = F.when(u < 0, F.lit(64)).when(u == 0, F.lit(1)).otherwise(F.length(F.bin(u)))
    return F.floor((bits + 6) / 7).cast("int")


def varint_length_product(a: Column, b: Column, c: Column) -> Column:
    """Bytes of the base-128 coding of a * b * c: varint_length() of a long, and past a long as many as the exact product has.

    A product of 10^38 and more is an error.
    """
    a, b, c = (x.cast("decimal(19,0)") for x in (a, b, c))
    wide = (a * b).cast("decimal(38,0)") * c
    narrow = F.when(wide.between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63 - 1))), wide).cast("long")
    high = F.call_function("div", wide, F.lit(Decimal(2**64)))
    bits = F.lit(64) + F.when(high == 0, F.lit(0)).otherwise(F.length(F.bin(high)))
    return F.when(wide.isNull() | narrow.isNotNull(), varint_length(narrow)).when(wide < 0, F.lit(10)).otherwise(F.floor((bits + 6) / 7)).cast("int")


def delta(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with out: value less the one before in its group, the first less 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.col(value) - F.lag(value, 1, 0).over(w))


def undelta(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def packed_sizes(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, raw, gzip, delta_gzip, proto_gzip: bytes of each group's values as 16-bit numbers in order, plain and
    compressed at level 9; their steps as 16-bit numbers, and as zigzag varints, compressed.  A group is one grid."""

    def sizes(table: pa.Table) -> pa.Table:
        v = table.sort_by(order)[value].to_numpy().astype("<i2")
        step = np.diff(v, prepend=v.dtype.type(0))
        forms = (v.tobytes(), step.tobytes(), varints.zigzag_encode(step))
        row = [len(v) * 2, *(len(gzip.compress(x, 9)) for x in forms)]
        return pa.table({group: table[group].slice(0, 1), **{c: pa.array([n], pa.int64()) for c, n in zip(("raw", "gzip", "delta_gzip", "proto_gzip"), row, strict=True)}})

    rows = df.select(F.col(group).cast("long").alias(group), order, value)
    return rows.groupBy(group).applyInArrow(sizes, f"{group} long, raw long, gzip long, delta_gzip long, proto_gzip long")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """value, n; sort it by n descending, then value, to read it."""
    return df.groupBy(value).agg(F.count("*").alias("n"))


def utf8_length(text: Column) -> Column:
    """Bytes of a text and of its varint length prefix."""
    n = F.octet_length(text).cast("long")
    return n + varint_length(n)
