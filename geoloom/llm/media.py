"""Media columns: content-addressed payloads in tar shards, read back by byte ranges.

A payload is stored as a grayscale PNG of 8-bit samples under its SHA-256, as a member of a tar file in the shared
folder.  Rows carry digest, shard, offset and length.  Metadata columns need only the PNG's first 33 bytes.  A
task writes shards of its own, under names that no other attempt has; only shards that rows name are live, so lost executors
and repeated tasks do no harm.  A digest is stored once a shard.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.llm.common import materialize, scratch_path, texts_of
from geoloom.scratch import arrow_folder

#: A shard is closed when it has so many bytes.
SHARD_BYTES = 256 << 20
#: Stored bytes that a task reads back, and the parts of shards by which they are dealt.
READ_BYTES, PART_BYTES = 16 << 20, 2 << 20
#: Samples of a row of the image; a payload is a positive multiple of it.
WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"
#: Signature, and the chunk with width, height, depth and colour type.
HEADER_BYTES = 33


def payload_of(data: bytes) -> bytes:
    """data, then bytes 255 up to a positive multiple of WIDTH."""
    return data + b"\xff" * (WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a leading 0 in each row: no filter
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> dict:
    """Format, width, height, depth and channels from the first HEADER_BYTES of a PNG."""
    if len(head) < HEADER_BYTES or head[:8] != _PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the start of a PNG")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"format": "png", "width": width, "height": height, "depth": depth, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]}


def samples_of(png: bytes) -> np.ndarray:
    """The samples of a PNG that png_of() made."""
    head, at, data = header_of(png[:HEADER_BYTES]), HEADER_BYTES, []
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head["height"], head["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered PNG row")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit mark of where 64 equal runs of them lie above the mean."""
    flat = samples.reshape(-1)
    n = np.bincount(flat, minlength=256)
    share = n[n > 0] / len(flat)
    runs = np.add.reduceat(flat.astype(np.int64), np.arange(64) * len(flat) // 64)
    size = np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
    above = np.packbits(runs * len(flat) > size * int(flat.sum(dtype=np.int64))).tobytes().hex()
    return f"{flat.mean():.4f}:{flat.std():.4f}:{-(share * np.log2(share)).sum():.4f}:{above}"


def store(docs: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row of docs (doc_id, text): its payload is stored under root.

    A null text is empty; every row gets a place, equal texts of a shard the same one.  The rows are written to
    the shared folder, so that the shards they name are never written again.  A root without a scheme is of the
    cluster's default file system; one in a store that Arrow can't open is an error.
    """
    spark = docs.sparkSession
    root = arrow_folder(spark, root or scratch_path(spark, "media"))

    def write(batches):
        files, folder = fs.FileSystem.from_uri(root)
        files.create_dir(folder, recursive=True)
        out, name, at, held = None, "", 0, {}
        try:
            for batch in batches:
                rows = [[] for _ in range(5)]
                for data in texts_of(batch.column(1)):
                    payload = payload_of(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in held:
                        if out is None:
                            name, at, held = f"{uuid.uuid4().hex}.tar", 0, {}
                            out = files.open_output_stream(f"{folder}/{name}")
                        png = png_of(payload)
                        info = tarfile.TarInfo(digest.hex() + ".png")
                        info.size = len(png)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + png + bytes(-len(png) % 512))
                        held[digest] = (name, at + len(head), len(png))
                        at += len(head) + len(png) + -len(png) % 512
                    for column, x in zip(rows, (len(data), digest, *held[digest]), strict=True):
                        column.append(x)
                    if at >= SHARD_BYTES:
                        out.write(bytes(1024))
                        out.close()
                        out, held = None, {}
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(write, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "media-rows")
    return rows.withColumn("shard", F.concat(F.lit(root + "/"), "shard"))


class _Ranges:
    """Reads byte ranges; keeps one shard open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            files, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, files.open_input_file(path)
        return self.file.read_at(length, offset)


def _more(rows: DataFrame, fields: str) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(fields).fields])


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows of store() with format, width, height, depth, channels, from HEADER_BYTES of each member."""

    def read(batches):
        ranges = _Ranges()
        for batch in batches:
            found = [header_of(ranges.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x["format"] for x in found], pa.string()), *(pa.array([x[c] for x in found], pa.int32()) for c in ("width", "height", "depth", "channels"))], [*batch.schema.names, "format", "width", "height", "depth", "channels"])

    return rows.mapInArrow(read, _more(rows, "format string, width int, height int, depth int, channels int"))


def dealt(rows: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """rows of store() dealt to tasks by the stored bytes that they name, in the order of those bytes.

    Rows that name the same bytes come after one another, and count their bytes once each.
    """
    total = rows.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / PART_BYTES)
    return rows.repartition(max(1, math.ceil(total / read_bytes)), F.col("shard"), part).sortWithinPartitions("shard", "offset")


def with_contents(rows: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """rows of store() with what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature.

    About read_bytes of shards are a task's share.
    """
    rows = dealt(rows, read_bytes)

    def read(batches):
        ranges, last, got = _Ranges(), None, None
        for batch in batches:
            out = [[] for _ in range(5)]
            for place in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if place != last:
                    png = ranges.read(*place)
                    samples = samples_of(png)
                    payload = samples.tobytes()
                    last, got = place, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(png).hexdigest(), feature_of(samples))
                for column, x in zip(out, got, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    return rows.mapInArrow(read, _more(rows, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"))
