"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _uri(at) -> str:
    out = at.toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme and authority: one without is of the default file system, on every machine alike."""
    files, at = _hadoop(spark, path)
    return _uri(files.makeQualified(at))


def arrow_folder(spark: SparkSession, path: str) -> str:
    """The URI of the folder path, made here if need be, for readers and writers that go through Arrow's file systems.

    Mounts are followed to what they stand for.  ValueError for a store that Arrow can't open.
    """
    files, at = _hadoop(spark, qualified(spark, path))
    files.mkdirs(at)
    out = _uri(files.resolvePath(at))
    try:
        fs.FileSystem.from_uri(out)
    except (pa.ArrowException, OSError) as e:
        raise ValueError(f"{out} is not in a store that Arrow opens (a file, hdfs, s3 or gs path is)") from e
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, root)


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/geoloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in frames:
        drop_path(df.sparkSession, df.scratch)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application.  Results that weren't written elsewhere still read some
    of them, so this is for when all results have been written or read."""
    drop_path(spark, _folder(spark))
