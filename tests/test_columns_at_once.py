"""Whole columns of entities through the source: coded and decoded at once, as a message at a time would be."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.sources import osmpbf
from geoloom.sources.wire import blocks, varints, writer
from geoloom.sources.wire.blocks import Block

COLUMNS = [("lat_code", "lon_code"), ("node_ids",), ("members",)]
DECODE = (blocks.nodes, blocks.ways, blocks.relations)


def entities(kind, n, r):
    tags = lambda: [{"key": r.choice(["", "a", "b", "ü"]), "value": r.choice(["", "x", "y" * r.randrange(300)])} for _ in range(r.choice([0, 0, 1, 3]))]
    big = lambda: r.randrange(2 ** r.randrange(1, 62)) * r.choice([1, 1, -1])
    several = lambda make: [make() for _ in range(r.choice([0, 1, 5]))]
    own = {
        "lat_code": lambda: r.randrange(-(2**31), 2**31), "lon_code": lambda: r.randrange(-(2**31), 2**31),
        "node_ids": lambda: several(big), "members": lambda: several(lambda: {"id": big(), "type": r.randrange(3), "role": r.choice(["", "o", "inner"])}),
    }
    ids = sorted(r.sample(range(-(10**12), 10**12), n))
    return [{"id": i, "tags": tags(), **{c: own[c]() for c in COLUMNS[kind]}} for i in ids]


def content(blob):
    return blocks.inflate(blob[4 + struct.unpack(">I", blob[:4])[0] :])


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_blobs(kind, monkeypatch):
    rows = entities(kind, 400, random.Random(kind))
    schema = (blocks.NODES, blocks.WAYS, blocks.RELATIONS)[kind]
    bounds = np.array([0, 1, 100, 101, 400])
    blobs = [content(b) for b in writer.blobs(kind, pa.Table.from_pylist(rows, schema=schema), bounds)]
    read = lambda: [x for b in blobs for batch in DECODE[kind](Block.of(b)) for x in batch.to_pylist()]
    fast, counts = read(), [blocks.statistics(b) for b in blobs]
    assert fast == [{c: r[c] for c in schema.names} for r in rows]
    monkeypatch.setattr(blocks, "_columns", lambda *a: None)  # now a message at a time
    assert read() == fast and [blocks.statistics(b) for b in blobs] == counts


def test_odd_messages_are_read_one_at_a_time():
    """Fields of other wire types, a missing id and a number that ends beyond its list are left to the slow way."""
    s = writer.Strings()
    way = writer.ways(s, [(7, [], [1, 2])])
    odd = varints.field(3, varints.encode([1 << 3, 9]) + varints.encode([5 << 3 | 5]) + b"abcd")
    assert blocks._columns(way + way, 3, (2, 3, 8)) is not None
    assert blocks._columns(way + odd, 3, (2, 3, 8)) is None and blocks._columns(varints.field(3, varints.field(8, b"\x02")), 3) is None
    assert blocks._columns(varints.field(3, varints.encode([1 << 3, 9]) + varints.field(8, b"\x80")), 3, (8,)) is None
    b = Block.of(writer.block(s, [way + odd]))
    assert [x["id"] for batch in blocks.ways(b) for x in batch.to_pylist()] == [7, 9]
    with pytest.raises(KeyError):
        list(blocks.ways(Block.of(writer.block(s, [varints.field(3, varints.field(8, b"\x02"))]))))


def test_blobs_are_bounded_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """A block with very many members is several blobs, the rows of all blocks are whole, and small files are dealt over tasks."""
    members = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda x: F.struct((x * F.col("id")).alias("id"), F.lit(1).cast("tinyint").alias("type"), F.lit("r").alias("role")))
    tags = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    large = spark.range(1, 26).select("id", tags.alias("tags"), members.alias("members"))
    small = spark.range(1000, 60_000).select("id", tags.alias("tags"), F.expr("cast(array() as array<struct<id:bigint,type:tinyint,role:string>>)").alias("members"))
    path = osmpbf.write(spark, str(tmp_path / "map"), relations=large.unionByName(small), block=100)
    blobs = osmpbf.read(spark, path, "blob").collect()
    assert max(b.raw_size for b in blobs) < 8 << 20 and len([b for b in blobs if b.min_relation_id < 100]) > 5
    assert len([b for b in blobs if b.min_relation_id >= 1000]) == 591
    got = osmpbf.read(spark, path, "relation").select("id", F.size("members").alias("n"), F.expr("get(members, 99999).id").alias("last")).orderBy("id").collect()
    assert [(r.id, r.n, r.last) for r in got[:25]] == [(i, 100_000, 100_000 * i) for i in range(1, 26)] and len(got) == 25 + 59_000
    monkeypatch.setattr(osmpbf, "LEAST_BYTES", 1000)
    parts = lambda **o: osmpbf.PbfReader({"path": path, "entity": "relation", **o}).partitions()
    assert len(parts()) == 1 and len(parts(tasks="8")) > 4 and sum(len(p.blobs) for p in parts(tasks="8")) == len(blobs)


def test_an_index_of_many_files_is_one_job(spark, tmp_path):
    tags = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    nodes = spark.range(1, 20_001).select("id", F.lit(1).alias("lat_code"), F.lit(2).alias("lon_code"), tags.alias("tags"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path, index = osmpbf.write(spark, str(tmp_path / "map"), nodes=nodes, block=10), str(tmp_path / "index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = osmpbf.files_of(path)
    writes = []
    real = osmpbf.read
    try:
        osmpbf.read = lambda *a, **k: writes.append(1) or real(*a, **k)
        osmpbf.write_index(spark, path, index)
    finally:
        osmpbf.read = real
    assert len(files) > 1 and len(writes) == 1
    assert sum(r["node_count"] for f in files for r in osmpbf.read_index(f, index)) == 20_000
    assert [r.id for r in osmpbf.read(spark, path, index=index).where("id = 777").collect()] == [777]
