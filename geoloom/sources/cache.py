"""A cache of complete relations as Parquet, and binary forms of entities."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.wire import varints

BUCKETS = 64


def write_bundles(bundles: DataFrame, path: str) -> None:
    """Append bundles (with an id), parted by id modulo BUCKETS."""
    bundles.withColumn("bucket", F.pmod("id", F.lit(BUCKETS))).write.mode("append").partitionBy("bucket").parquet(path)


def read_bundles(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The bundles of those ids; only their buckets are read."""
    return spark.read.parquet(path).where(F.col("bucket").isin(sorted({i % BUCKETS for i in ids})) & F.col("id").isin(ids)).drop("bucket")


def write_paths(paths: DataFrame, path: str) -> None:
    """Append located paths (path_id, place and any other columns), parted by path_id modulo BUCKETS, in order."""
    dealt = paths.withColumn("bucket", F.pmod("path_id", F.lit(BUCKETS))).repartition("bucket").sortWithinPartitions("path_id", "place")
    dealt.write.mode("append").partitionBy("bucket").parquet(path)


def read_path(spark: SparkSession, path: str, path_id: int) -> DataFrame:
    """The rows of one path; sort them by place.  Only its bucket is read."""
    return spark.read.parquet(path).where((F.col("bucket") == path_id % BUCKETS) & (F.col("path_id") == path_id)).drop("bucket")


def _text(s: str) -> bytes:
    b = s.encode()
    return varints.encode([len(b)]) + b


def _read_text(data: bytes, at: int) -> tuple[str, int]:
    n, at = varints.one(data, at)
    return data[at : at + n].decode(), at + n


def _tags(tags: list[dict]) -> bytes:
    return varints.encode([len(tags)]) + b"".join(_text(t["key"]) + _text(t["value"]) for t in tags)


def _read_tags(data: bytes, at: int) -> tuple[list[dict], int]:
    n, at = varints.one(data, at)
    tags = []
    for _ in range(n):
        k, at = _read_text(data, at)
        v, at = _read_text(data, at)
        tags.append({"key": k, "value": v})
    return tags, at


def encode_node(node: dict) -> bytes:
    return varints.encode([node["id"]]) + varints.zigzag_encode([node["lat_code"], node["lon_code"]]) + _tags(node["tags"])


def decode_node(data: bytes) -> dict:
    node_id, at = varints.one(data, 0)
    lat, at = varints.one(data, at)
    lon, at = varints.one(data, at)
    tags, _ = _read_tags(data, at)
    return {"id": varints.signed(node_id), "lat_code": varints.unzigzag_one(lat), "lon_code": varints.unzigzag_one(lon), "tags": tags}


def encode_way(way: dict) -> bytes:
    steps = [b - a for a, b in zip([0, *way["node_ids"]], way["node_ids"], strict=False)]
    return varints.encode([way["id"], len(steps)]) + varints.zigzag_encode(steps) + _tags(way["tags"])


def decode_way(data: bytes) -> dict:
    way_id, at = varints.one(data, 0)
    n, at = varints.one(data, at)
    ids, last = [], 0
    for _ in range(n):
        step, at = varints.one(data, at)
        last += varints.unzigzag_one(step)
        ids.append(last)
    return {"id": varints.signed(way_id), "node_ids": ids, "tags": _read_tags(data, at)[0]}


def encode_member(member: dict) -> bytes:
    return varints.encode([member["type"], member["id"]]) + _text(member["role"])


def _read_member(data: bytes, at: int) -> tuple[dict, int]:
    kind, at = varints.one(data, at)
    ref, at = varints.one(data, at)
    role, at = _read_text(data, at)
    return {"type": kind, "id": varints.signed(ref), "role": role}, at


def decode_member(data: bytes) -> dict:
    return _read_member(data, 0)[0]


def encode_relation(relation: dict) -> bytes:
    members = relation["members"]
    return varints.encode([relation["id"], len(members)]) + b"".join(map(encode_member, members)) + _tags(relation["tags"])


def decode_relation(data: bytes) -> dict:
    relation_id, at = varints.one(data, 0)
    n, at = varints.one(data, at)
    members = []
    for _ in range(n):
        member, at = _read_member(data, at)
        members.append(member)
    return {"id": varints.signed(relation_id), "members": members, "tags": _read_tags(data, at)[0]}


def framed(parts: list[bytes]) -> bytes:
    """Byte strings, each after its 32-bit length."""
    return b"".join(struct.pack("<i", len(p)) + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<i", data, at)[0]
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
