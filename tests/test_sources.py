import struct

import pytest
from pyspark.sql import functions as F

from geoloom.sources import cache, osmpbf, text
from geoloom.sources.wire import varints, writer
from geoloom.sources.wire.varints import field


def tagged(tags):
    return [tuple(t) for t in tags]


def write(path, *blobs):
    path.write_bytes(writer.header() + b"".join(blobs))
    return str(path)


NODES = [(5, 520000000, 130000000, [("name", "a"), ("name", "b")]), (7, 520000001, 129999999, []), (6, -1, -2, [("k", "ü")])]


def block(build, *rows, extra=b"", **how):
    s = writer.Strings()
    groups = [b(s, r, **how) for b, r in zip(build, rows, strict=True)]
    return writer.block(s, groups, extra)


def data(b, raw=False):
    return writer.blob("OSMData", b, raw)


def test_dense_sparse_raw_and_mixed(spark, tmp_path):
    ways = [(10, [("highway", "x")], [5, 7, 6, 5]), (11, [], [])]
    rels = [(20, [("type", "r")], [(10, 1, "outer"), (5, 0, ""), (21, 2, "sub")]), (21, [], [])]
    path = write(tmp_path / "a.pbf", data(block([writer.dense, writer.ways, writer.relations], NODES, ways, rels)), data(block([writer.sparse], [(100 + i, a, b, t) for i, a, b, t in NODES]), raw=True))
    got = [(r.id, r.lat_code, r.lon_code, tagged(r.tags)) for r in osmpbf.read(spark, path).collect()]
    assert sorted(got) == sorted(NODES + [(100 + i, a, b, t) for i, a, b, t in NODES])
    assert {r.id for r in osmpbf.read(spark, path, tags="false").where(F.size("tags") == 0).collect()} == {5, 6, 7, 105, 106, 107}
    assert sorted((r.id, tagged(r.tags), r.node_ids) for r in osmpbf.read(spark, path, "way").collect()) == ways
    assert sorted((r.id, tagged(r.tags), tagged(r.members)) for r in osmpbf.read(spark, path, "relation").collect()) == rels
    head = osmpbf.read(spark, path, "header").first()
    assert (head.left, head.bottom, head.required_features, head.writingprogram) == (6000000000, 47000000000, ["OsmSchema-V0.6", "DenseNodes"], "geoloom")
    blobs = osmpbf.read(spark, path, "blob").orderBy("pbf_ofs").collect()
    assert [(b.node_count, b.min_node_id, b.max_node_id, b.way_count, b.relation_count) for b in blobs] == [(3, 5, 7, 2, 2), (3, 105, 107, 0, 0)]
    assert blobs[0].pbf_ofs + blobs[0].blob_len == blobs[1].pbf_ofs and blobs[0].min_way_id == 10 and blobs[1].max_relation_id is None


def test_tagless_granularity_and_negative_ids(spark, tmp_path):
    rows = [(-9, 4, 8, []), (-20, 5, 9, [])]
    extra = varints.encode([17 << 3, 1000, 19 << 3, 500]) + varints.encode([20 << 3, -300])
    path = write(tmp_path / "b.pbf", data(block([writer.dense], rows, tags=False, extra=extra)))
    assert [(r.id, r.lat_code, r.lon_code, r.tags) for r in osmpbf.read(spark, path).collect()] == [(-9, 45, 77, []), (-20, 55, 87, [])]
    b = osmpbf.read(spark, path, "blob").first()
    assert (b.min_node_id, b.max_node_id) == (-20, -9)


def test_index_prunes_and_goes_stale(spark, tmp_path):
    blobs = [data(block([writer.dense], [(i * 10 + j, i, j, []) for j in range(10)])) for i in range(8)]
    path, index = write(tmp_path / "c.pbf", *blobs), str(tmp_path / "c.index")
    osmpbf.write_index(spark, path, index)
    df = osmpbf.read(spark, path, index=index, partitionBytes=1)
    assert df.rdd.getNumPartitions() == 8
    for condition, parts, n in (("id = 33", 1, 1), ("id in (3, 77, 500)", 2, 2), ("id >= 70", 1, 10), ("id > 500", 1, 0), ("id between 15 and 24", 2, 10)):
        some = df.where(condition)
        assert some.count() == n and some.rdd.getNumPartitions() <= parts
    assert len(osmpbf.read_index(path, index)) == 8
    assert osmpbf.read(spark, f"file://{path}", index=f"file://{index}", partitionBytes=1).where("id = 33").rdd.getNumPartitions() == 1
    write(tmp_path / "c.pbf", *blobs, blobs[0])
    assert osmpbf.read_index(path, index) is None and osmpbf.read(spark, path, index=index).count() == 90


def test_index_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    blobs = [data(block([writer.dense], [(i * 10 + j, i, j, []) for j in range(10)])) for i in range(9)]
    path, index = write(tmp_path / "c.pbf", *blobs), str(tmp_path / "c.index")
    jobs, read = [], osmpbf.read

    def failing(spark, path, entity, **options):
        jobs.append(options)
        if len(jobs) == 3:
            raise RuntimeError("lost")
        return read(spark, path, entity, **options)

    monkeypatch.setattr(osmpbf, "read", failing)
    with pytest.raises(RuntimeError):
        osmpbf.write_index(spark, path, index, blobs=2)
    assert len(osmpbf.read_index(path, index)) == 4
    assert read(spark, path, index=index).where("id >= 15").count() == 75  # what the index lacks is read whole
    osmpbf.write_index(spark, path, index, blobs=2)
    assert [r["min_node_id"] for r in osmpbf.read_index(path, index)] == [i * 10 for i in range(9)] and len(jobs) == 6
    assert read(spark, path, index=index, partitionBytes=1).where("id = 88").rdd.getNumPartitions() == 1


def test_a_value_that_is_string_zero(spark, tmp_path):
    s = writer.Strings()
    k = s("k")
    body = b"".join(field(n, varints.delta_encode(v)) for n, v in ((1, [1, 2]), (8, [0, 0]), (9, [0, 0])))
    path = write(tmp_path / "z.pbf", data(writer.block(s, [field(2, body + field(10, varints.encode([k, 0, 0, 0])))])))
    assert [(r.id, tagged(r.tags)) for r in osmpbf.read(spark, path).collect()] == [(1, [("k", "")]), (2, [])]


def test_metadata(spark, tmp_path):
    s = writer.Strings()
    anna, k = s("anna"), s("k")
    whole = [(1, [3, 4]), (2, [100, 90]), (3, [7, 8]), (4, [5, 5]), (5, [anna, 0])]
    steps = b"".join(field(n, varints.encode(v) if n == 1 else varints.delta_encode(v)) for n, v in whole)
    place = b"".join(field(n, varints.delta_encode(v)) for n, v in ((1, [1, 2]), (8, [0, 0]), (9, [0, 0])))
    own = field(4, field(1, 2) + field(2, 50) + field(5, anna) + field(6, 0))
    dense = field(2, place + field(5, steps + field(6, varints.encode([1, 0]))))
    bare = field(2, b"".join(field(n, varints.delta_encode([9])) for n in (1, 8, 9)))
    sparse = field(1, field(1, 20) + own + field(8, 0) + field(9, 0)) + field(1, field(1, 22) + field(8, 0) + field(9, 0))
    ways, relations = field(3, field(1, 30) + field(2, varints.encode([k])) + field(3, varints.encode([anna])) + own), field(4, field(1, 40) + own)
    path = write(tmp_path / "m.pbf", data(writer.block(s, [dense, bare, sparse, ways, relations], field(18, 10))))
    columns = ["id", "version", "timestamp_ms", "changeset", "uid", "user", "visible"]
    mine, none = (2, 500, None, None, "anna", False), (None,) * 6
    got = {tuple(r) for r in osmpbf.read(spark, path, metadata="true").select(columns).collect()}
    assert got == {(1, 3, 1000, 7, 5, "anna", True), (2, 4, 900, 8, 5, "", False), (9, *none), (10, *mine), (11, *none)}
    assert [tuple(r) for r in osmpbf.read(spark, path, "way", metadata="true", tags="false").select(columns).collect()] == [(30, *mine)]
    assert [tuple(r) for r in osmpbf.read(spark, path, "relation", metadata="true").select(columns).collect()] == [(40, *mine)]
    assert osmpbf.read(spark, path, "way").columns == ["id", "tags", "node_ids"] and osmpbf.read(spark, path).count() == 5
    uneven = field(2, place + field(5, field(1, varints.encode([3]))))
    path = write(tmp_path / "u.pbf", data(writer.block(s, [uneven])))
    assert osmpbf.read(spark, path).count() == 2
    with pytest.raises(Exception, match="version of 1 entities for 2"):
        osmpbf.read(spark, path, metadata="true").collect()


def test_written_folder(spark, tmp_path):
    tags = "array<struct<key:string,value:string>>"
    nodes = spark.createDataFrame([(i, i * 3, -i, [("n", str(i))] if i % 2 else []) for i in range(1, 60)], f"id long, lat_code int, lon_code int, tags {tags}").repartition(4)
    ways = spark.createDataFrame([(i, [("k", "v")], list(range(i % 5))) for i in range(1, 30)], f"id long, tags {tags}, node_ids array<long>")
    relations = spark.createDataFrame([(i, [], [(i, 1, "outer")] * (i % 3)) for i in range(1, 20)], f"id long, tags {tags}, members array<struct<id:long,type:tinyint,role:string>>")
    path = osmpbf.write(spark, str(tmp_path / "map"), nodes, ways, relations, block=10)
    for entity, rows in (("node", nodes), ("way", ways), ("relation", relations)):
        assert sorted(osmpbf.read(spark, path, entity).collect()) == sorted(rows.collect())
    osmpbf.write_index(spark, path, str(tmp_path / "index"))
    some = osmpbf.read(spark, path, "way", index=str(tmp_path / "index"), partitionBytes=1).where("id = 25")
    assert some.count() == 1 and some.rdd.getNumPartitions() == 1
    assert osmpbf.read(spark, path, "blob").agg({"node_count": "sum"}).first()[0] == 59


def test_damage(spark, tmp_path):
    good = data(block([writer.dense], NODES))
    lzma = writer.blob("OSMData", b"", body=field(2, 10) + field(4, b"zz"))
    size = writer.blob("OSMData", b"", body=field(2, 999) + field(3, __import__("zlib").compress(b"abc")))
    torn = writer.blob("OSMData", b"", body=field(2, 3) + field(3, b"\x78\x9c\x01"))
    uneven = data(writer.block(writer.Strings(), [field(2, field(1, varints.delta_encode([1, 2])) + field(8, varints.delta_encode([1])) + field(9, varints.delta_encode([1])))]))
    for bad in (lzma, size, torn, uneven):
        path = write(tmp_path / "d.pbf", good, bad)
        with pytest.raises(Exception, match=f"blob at {len(writer.header()) + len(good)}"):
            osmpbf.read(spark, path).collect()
        assert osmpbf.read(spark, path, mode="PERMISSIVE").count() == 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1,2\n-3   4\n5\t6\n\n")
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "p.txt")).collect()] == [(1, 2), (-3, 4), (5, 6)]
    assert [tuple(r) for r in text.read_points(spark, str(tmp_path / "p.txt"), swap=True).collect()][0] == (2, 1)
    (tmp_path / "e.hgt").write_bytes(struct.pack(">4h", 1, -2, 300, -32768))
    assert [r.elevation for r in text.read_elevations(spark, str(tmp_path / "e.hgt")).orderBy("place").collect()] == [1, -2, 300, -32768]
    vertices = spark.createDataFrame([("b", 3, 4), ("a", 1, 2)], "place string, lat_code int, lon_code int")
    text.write_vertices(vertices, str(tmp_path / "v"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "v")).collect()) == ["1,2", "3,4"]


def test_tables_and_regions_as_text(spark, tmp_path):
    lines = spark.createDataFrame([("1\t\tx",), ("2",), ("3\t4\ty\tmore",)], "line string")
    assert [tuple(r) for r in text.from_tsv(lines, [("a", "long"), ("b", "int"), ("c", "string")]).collect()] == [(1, None, "x"), (2, None, None), (3, 4, "y")]
    text.write_tsv(spark.createDataFrame([(1, None)], "a long, b int"), str(tmp_path / "t"), ["a", "b"], "gzip")
    assert list((tmp_path / "t").glob("*.gz")) and [tuple(r) for r in text.read_tsv(spark, str(tmp_path / "t"), [("a", "long"), ("b", "int")]).collect()] == [(1, None)]
    rows = [(r, role, f"{p:03}", p, -p) for r in (7, 9) for role in ("outer", "inner") for p in (5, 1, 12)]
    text.write_regions(spark.createDataFrame(rows, "root long, role string, place string, lat_code int, lon_code int").repartition(5), str(tmp_path / "r"))
    for folder in ("root=7/role=outer", "root=9/role=inner"):
        (file,) = (tmp_path / "r" / folder).glob("part-*")
        assert file.read_text() == "1,-1\n5,-5\n12,-12\n"


def test_path_cache(spark, tmp_path):
    paths = spark.createDataFrame([(p, i, p * i) for p in (3, 67, 5) for i in range(4)], "path_id long, place int, id long")
    cache.write_paths(paths, str(tmp_path / "paths"))
    assert [tuple(r) for r in cache.read_path(spark, str(tmp_path / "paths"), 67).orderBy("place").collect()] == [(67, i, 67 * i) for i in range(4)]


def test_cache(spark, tmp_path):
    node = {"id": 300, "lat_code": -5, "lon_code": 70, "tags": [{"key": "k", "value": "ü"}]}
    assert cache.decode_node(cache.encode_node(node)) == node and cache.unframed(cache.framed([b"a", b"", b"bcd"])) == [b"a", b"", b"bcd"]
    path = str(tmp_path / "bundles")
    cache.write_bundles(spark.range(200).withColumn("v", F.col("id") * 2), path)
    cache.write_bundles(spark.range(200, 210).withColumn("v", F.col("id") * 2), path)
    assert sorted(tuple(r) for r in cache.read_bundles(spark, path, [3, 205, 999]).collect()) == [(3, 6), (205, 410)]
