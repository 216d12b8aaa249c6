"""A Spark data source for map files (.osm.pbf): spark.read.format("osmpbf").option("entity", "node").load(path).

path is a file or a folder of files that end in .pbf.  Options: entity (node, way, relation, blob, header);
tags=false leaves out tags; metadata=true adds version, timestamp_ms, changeset, uid, user and visible (null where a
file hasn't them), which are skipped otherwise; mode=PERMISSIVE drops blobs that can't be read; index names a Parquet sidecar written
by write_index(), whose id ranges prune blocks for pushed id filters; partitionBytes is the stored bytes of a
partition at most, tasks the partitions that small inputs are dealt over; fromOffset and toOffset bound the places of
the blobs read; files (a line each) are read instead of those of path.  Only headers are read on the driver, and
not even those of blobs that the index has.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from geoloom.scratch import arrow_folder, drop_scratch, materialize, qualified
from geoloom.sources.wire import blocks, writer
from geoloom.sources.wire.blocks import Blob, Block, PbfParseError

#: Blobs that one job of write_index() reads; an interrupted index goes on after the last whole job.
INDEX_BLOBS = 65_536
#: Stored bytes of a partition at least, where there are few for so many tasks.
LEAST_BYTES = 256 << 10
_TAGS = "tags array<struct<key:string,value:string>>"
BLOB_FIELDS = ("pbf_ofs", "blob_len", "zlib_ofs", "zlib_len", "raw_size", "scanned", "node_count", "min_node_id", "max_node_id", "way_count", "min_way_id", "max_way_id", "relation_count", "min_relation_id", "max_relation_id")
SCHEMAS = {
    "node": f"id long, lat_code int, lon_code int, {_TAGS}",
    "way": f"id long, {_TAGS}, node_ids array<long>",
    "relation": f"id long, {_TAGS}, members array<struct<id:long,type:tinyint,role:string>>",
    "blob": ", ".join(f"{c} {'boolean' if c == 'scanned' else 'long'}" for c in BLOB_FIELDS) + ", file string",
    "header": "left long, right long, top long, bottom long, required_features array<string>, optional_features array<string>, writingprogram string, source string, replication_timestamp long, replication_seq long, replication_url string",
}
METADATA = "version int, timestamp_ms long, changeset long, uid int, `user` string, visible boolean"
_BLOB_SCHEMA = pa.schema([(c, pa.bool_() if c == "scanned" else pa.int64()) for c in BLOB_FIELDS] + [("file", pa.string())])


def _located(path: str):
    """Arrow's file system and path of a local path or a URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str):
    """A seekable stream of a local path or a URI that Arrow's file systems read."""
    files, inner = _located(path)
    return files.open_input_file(inner)


def files_of(path: str) -> list[str]:
    """path itself, or the files of the folder path that end in .pbf, in the order of their names."""
    files, inner = _located(path)
    if files.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = (os.path.basename(x.path) for x in files.get_file_info(fs.FileSelector(inner)) if x.is_file)
    return [f"{path.rstrip('/')}/{name}" for name in sorted(names) if name.endswith(".pbf")]


@dataclass
class Blobs(InputPartition):
    blobs: tuple[tuple[str, Blob], ...]


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entity = options["path"], options.get("entity", "node")
        self.tags, self.permissive = options.get("tags", "true") != "false", options.get("mode", "").upper() == "PERMISSIVE"
        self.metadata = options.get("metadata", "false") == "true"
        self.index, self.bytes = options.get("index"), int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))
        self.tasks, self.names = int(options.get("tasks", 1)), options.get("files")
        self.first, self.last = (int(options[k]) if k in options else None for k in ("fromoffset", "tooffset"))
        self.low, self.high, self.ids = None, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if self.entity in ("node", "way", "relation") and getattr(f, "attribute", None) == ("id",):
                if isinstance(f, (EqualTo, In)):
                    own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.ids = own if self.ids is None else self.ids & own
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # Spark filters rows again: blocks are pruned here, rows aren't

    def _wanted(self, row: dict, ids: list[int] | None) -> bool:
        low, high = row[f"min_{self.entity}_id"], row[f"max_{self.entity}_id"]
        if not row[f"{self.entity}_count"]:
            return False
        if (self.low is not None and high < self.low) or (self.high is not None and low > self.high):
            return False
        return ids is None or ((at := bisect_left(ids, low)) < len(ids) and ids[at] <= high)

    def _found(self, file: str) -> Iterator[Blob]:
        """The blobs of a file that may hold what is asked for; those that the index has aren't looked up in the file."""
        after = self.first or 0
        if self.index and self.entity in ("node", "way", "relation"):
            ids = None if self.ids is None else sorted(self.ids)
            for row in read_index(file, self.index, self.entity) or []:
                after = max(after, row["pbf_ofs"] + row["blob_len"])
                if self._wanted(row, ids):
                    yield Blob(row["pbf_ofs"], row["blob_len"], "OSMData", None)
        with opened(file) as f:
            for b in blocks.walk(f, after):
                if self.last is not None and b.pbf_ofs > self.last:
                    return
                if (b.kind == "OSMHeader") == (self.entity == "header"):
                    yield b
                elif self.entity == "header":
                    return  # headers come first

    def partitions(self):
        found = [(file, b) for file in (self.names.split("\n") if self.names else files_of(self.path)) for b in self._found(file)]
        most = min(self.bytes, max(LEAST_BYTES, sum(b.blob_len for _, b in found) // self.tasks))
        parts, held, size = [], [], 0
        for file, b in found:
            held.append((file, b))
            size += b.blob_len
            if size >= most:
                parts.append(Blobs(tuple(held)))
                held, size = [], 0
        return parts + [Blobs(tuple(held))] if held or not parts else parts

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        try:
            for file, b in partition.blobs:
                if file != name:
                    if held is not None:
                        held.close()
                    held, name = opened(file), file
                try:
                    if b.data_ofs is None:
                        b = blocks.blob_at(held, b.pbf_ofs)
                    held.seek(b.pbf_ofs + b.data_ofs)
                    body = held.read(b.blob_len - b.data_ofs)
                    if len(body) < b.blob_len - b.data_ofs:
                        raise PbfParseError("the file ends within a blob", b.pbf_ofs)
                    batches = list(self._decode(b, body, file))
                except (ValueError, IndexError, KeyError) as e:
                    if self.permissive:
                        continue
                    raise e if isinstance(e, PbfParseError) and e.offset is not None else PbfParseError(f"{type(e).__name__}: {e}", b.pbf_ofs) from e
                yield from batches
        finally:
            if held is not None:
                held.close()

    def _decode(self, b: Blob, body: bytes, file: str) -> Iterator[pa.RecordBatch]:
        data = blocks.inflate(body, b.pbf_ofs)
        if self.entity == "header":
            row = blocks.header(data)
            kinds = {k: pa.list_(pa.string()) if "features" in k else pa.string() if k in ("writingprogram", "source", "replication_url") else pa.int64() for k in row}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(list(kinds.items())))
        elif self.entity == "blob":
            packed = next(((n, v) for n, v in blocks.fields(body) if n in (1, 3)), (1, b""))[1]
            at = body.find(bytes(packed)) if len(packed) else 0
            row = {"pbf_ofs": b.pbf_ofs, "blob_len": b.blob_len, "zlib_ofs": b.data_ofs + at, "zlib_len": len(packed), "raw_size": len(data), "scanned": True, "file": file}
            for kind, (n, low, high) in blocks.statistics(data).items():
                row |= {f"{kind}_count": n, f"min_{kind}_id": low, f"max_{kind}_id": high}
            yield pa.RecordBatch.from_pylist([row], schema=_BLOB_SCHEMA)
        else:
            decode = {"node": blocks.nodes, "way": blocks.ways, "relation": blocks.relations}[self.entity]
            yield from decode(Block.of(data, self.tags or self.metadata or self.entity == "relation"), self.tags, self.metadata)


class PbfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        entity = self.options.get("entity", "node")
        if entity not in SCHEMAS:
            raise ValueError(f"entity {entity!r}: one of {', '.join(SCHEMAS)}")
        wanted = self.options.get("metadata", "false") == "true" and entity in ("node", "way", "relation")
        return f"{SCHEMAS[entity]}, {METADATA}" if wanted else SCHEMAS[entity]

    def reader(self, schema) -> PbfReader:
        return PbfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbfDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, entity: str = "node", **options) -> DataFrame:
    register(spark)
    options |= {k: qualified(spark, options[k]) for k in ("index",) if options.get(k)}
    options = {"tasks": 4 * spark.sparkContext.defaultParallelism} | options
    return spark.read.format("osmpbf").option("entity", entity).options(**options).load(qualified(spark, path))


def stamp(path: str) -> str:
    """Size and change time of a file: an index with another stamp is stale."""
    files, inner = _located(path)
    info = files.get_file_info(inner)
    return f"{info.size}:{info.mtime_ns}"


def write_index(spark: SparkSession, path: str, index: str, blobs: int = INDEX_BLOBS) -> None:
    """Append the block statistics of the files of path, with their stamps, to the Parquet table index.

    What an index of the same stamp has already is not read again, so that a call that was interrupted goes on
    after the last of its jobs, each of which reads so many blobs.  Nothing but blob places comes to the driver.
    """
    index = qualified(spark, index)

    def put(files: list[str], **bounds) -> None:
        stamps = F.create_map(*(F.lit(x) for file in files for x in (_named(file), stamp(file))))
        own = read(spark, path, "blob", files="\n".join(files), **bounds)
        own.withColumn("stamp", stamps[F.col("file")]).write.mode("append").parquet(index)

    held, n = [], 0  # whole files that go into one job
    for file in files_of(qualified(spark, path)):
        rows = read_index(file, index) or []
        with opened(file) as f:
            places = [b.pbf_ofs for b in blocks.walk(f, max((r["pbf_ofs"] + r["blob_len"] for r in rows), default=0)) if b.kind == "OSMData"]
        if rows or len(places) > blobs:
            for at in range(0, len(places), blobs):
                part = places[at : at + blobs]
                put([file], fromOffset=part[0], toOffset=part[-1])
        elif places:
            if n + len(places) > blobs:
                put(held)
                held, n = [], 0
            held.append(file)
            n += len(places)
    if held:
        put(held)


def _named(path: str) -> str:
    """A file's name as indexes have it."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def read_index(path: str, index: str, entity: str | None = None) -> list[dict] | None:
    """Rows of an index on a file in the order of their places, those of an entity only its range; None if they are missing or stale."""
    files, inner = _located(index)
    if files.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    columns = list(BLOB_FIELDS) if entity is None else ["pbf_ofs", "blob_len", f"{entity}_count", f"min_{entity}_id", f"max_{entity}_id"]
    table = ds.dataset(inner, filesystem=files, format="parquet", exclude_invalid_files=False)
    rows = table.to_table(columns=columns, filter=(ds.field("file") == _named(path)) & (ds.field("stamp") == stamp(path)))
    return rows.sort_by("pbf_ofs").to_pylist() or None


_ENCODED = "kind int, block long, data binary"


def _bounds(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the blobs of rows in the order of their blocks begin and end, and the numbers before each: a blob is a
    block, or a part of one where a block has more than BLOB_NUMBERS."""
    held = lambda c: np.asarray(pc.list_value_length(table[c]).fill_null(0)).astype(np.int64)
    sizes = 4 + 2 * held("tags") + (held("node_ids") if kind == 1 else 3 * held("members") if kind == 2 else 0)
    here, total = np.asarray(table["block"]), np.concatenate([[0], np.cumsum(sizes)])
    starts, out = [*np.flatnonzero(np.append(True, here[1:] != here[:-1])).tolist(), len(here)], []
    for low, high in zip(starts[:-1], starts[1:], strict=True):
        while low < high:
            out.append(low)
            low = min(high, max(low + 1, int(np.searchsorted(total, total[low] + writer.BLOB_NUMBERS, "right")) - 1))
    return np.array([*out, len(here)]), total[out]


def _encoded(rows: DataFrame, kind: int, block: int) -> DataFrame:
    """kind, block, data: a blob of each block of so many ids, in the order of the blocks and ids within."""

    def encode(batches):
        # a batch's last block may go on in the next
        held = []
        for batch in batches:
            if not len(batch):
                continue
            here = np.asarray(batch["block"])
            cut = int(np.searchsorted(here, here[-1]))
            if held and (cut or held[-1]["block"][-1].as_py() != here[0].item()):
                yield from put(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from put(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from put(pa.Table.from_batches(held))

    def put(table: pa.Table):
        bounds, before = _bounds(table, kind)
        here = table["block"].combine_chunks().take(pa.array(bounds[:-1]))
        # so many blobs are coded at once as have BLOB_NUMBERS together
        run = np.append(np.flatnonzero(np.diff(before // writer.BLOB_NUMBERS, prepend=-1)), len(before))
        for at, end in zip(run[:-1].tolist(), run[1:].tolist(), strict=True):
            low, high = bounds[[at, end]].tolist()
            data = list(writer.blobs(kind, table.slice(low, high - low), bounds[at : end + 1] - low))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int32()), here.slice(at, end - at), pa.array(data, pa.binary())], ["kind", "block", "data"])

    dealt = rows.withColumn("block", F.floor((F.col("id") - 1) / block)).repartition("block").sortWithinPartitions("block", "id")
    return dealt.mapInArrow(encode, _ENCODED)


def write(spark: SparkSession, path: str, nodes: DataFrame | None = None, ways: DataFrame | None = None, relations: DataFrame | None = None, block: int = 8000) -> str:
    """Write entities (with the columns that read() gives them) into a folder of map files, nodes before ways before relations.

    Blocks hold up to `block` ids; a task writes one file under a name that no other attempt has, and files of
    attempts that failed are deleted in the end.  Returns the folder's URI.
    """
    blobs = None
    for kind, rows in enumerate((nodes, ways, relations)):
        if rows is not None:
            own = _encoded(rows, kind, block)
            blobs = own if blobs is None else blobs.unionByName(own)
    folder = arrow_folder(spark, path)

    def put(batches):
        files, inner = fs.FileSystem.from_uri(folder)
        out, name = None, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pbf"
        for batch in batches:
            if out is None and len(batch):
                out = files.open_output_stream(f"{inner}/{name}")
                out.write(writer.header())
            for data in batch.column(0):
                out.write(data.as_buffer())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    # encoded once: to deal by range reads its input twice
    blobs = materialize(blobs, "map-blobs")
    done = {r.name for r in blobs.repartitionByRange("kind", "block").sortWithinPartitions("kind", "block").select("data").mapInArrow(put, "name string").collect()}
    drop_scratch(blobs)
    files, inner = fs.FileSystem.from_uri(folder)
    for x in files.get_file_info(fs.FileSelector(inner)):
        if x.is_file and os.path.basename(x.path) not in done and os.path.basename(x.path).startswith("part-"):
            files.delete_file(x.path)
    return folder
