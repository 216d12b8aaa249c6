"""Text, raster and index files: points, elevation grids, block tables, vertex lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_point(text: Column, swap: bool = False) -> tuple[Column, Column]:
    """(x, y) of "x,y"; a comma, spaces or tabs part them."""
    parts = F.split(F.trim(text), "[ ,\t]+", 2)
    x, y = F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")
    return (y, x) if swap else (x, y)


def read_points(spark: SparkSession, path: str, swap: bool = False) -> DataFrame:
    x, y = parse_point(F.col("value"), swap)
    return spark.read.text(path).where("trim(value) <> ''").select(x.alias("x"), y.alias("y"))


def write_vertices(vertices: DataFrame, path: str, compression: str = "none") -> None:
    """lat_code,lon_code lines, in the order of place within each file; compression: none or gzip."""
    line = F.concat_ws(",", F.col("lat_code").cast("string"), F.col("lon_code").cast("string"))
    vertices.repartitionByRange("place").sortWithinPartitions("place").select(line.alias("value")).write.option("compression", compression).text(path)


def write_regions(vertices: DataFrame, path: str, compression: str = "none") -> None:
    """vertices (root, role, place, lat_code, lon_code) as one file of lat_code,lon_code lines a root and role, in the
    order of place: path/root=R/role=outer and inner.  A region's border is one task's work."""
    line = F.concat_ws(",", F.col("lat_code").cast("string"), F.col("lon_code").cast("string"))
    dealt = vertices.repartition("root", "role").sortWithinPartitions("root", "role", "place")
    dealt.select("root", "role", line.alias("value")).write.option("compression", compression).partitionBy("root", "role").text(path)


def to_tsv(blobs: DataFrame, columns: list[str]) -> DataFrame:
    """One text line a row; null is an empty field."""
    return blobs.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line"))


def from_tsv(lines: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns of tab-separated lines; an empty field is null, as is one that a short line lacks."""
    parts = F.split("line", "\t", -1)
    at = lambda i: F.get(parts, F.lit(i))
    return lines.select(*(F.when(at(i) != "", at(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(columns)))


def write_tsv(blobs: DataFrame, path: str, columns: list[str], compression: str = "none") -> None:
    """A folder of text files of to_tsv(); compression: none or gzip."""
    to_tsv(blobs, columns).write.option("compression", compression).text(path)


def read_tsv(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """The rows of block tables as text, plain or gzip."""
    return from_tsv(spark.read.text(path).select(F.col("value").alias("line")), columns)


def file_number(path: Column) -> Column:
    """The number of a block file: the last but one of the parts of its name between underscores."""
    return F.regexp_extract(path, r"_(\d+)_[^_]*$", 1).cast("long")


def read_elevations(spark: SparkSession, path: str) -> DataFrame:
    """path, place, elevation of grids of big-endian 16-bit numbers."""

    def grid(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(data.as_buffer(), ">i2").astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], ["path", "place", "elevation"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(grid, "path string, place long, elevation short")
