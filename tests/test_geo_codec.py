import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import codec, geo, tags
from geoloom.operators import layout, region, topology
from geoloom.sources.wire import varints


def value(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first())


def lit(v):
    return F.lit(v).cast("long")


@pytest.mark.parametrize(("lat", "lon", "x", "y", "z"), [
    (525000000, 134000000, 1934000000, 375000000, 1670046682787602432), (481000000, 116000000, 1916000000, 419000000, 1694672356196065280),
    (-900000000, -1800000000, 0, 1800000000, 2921183053739458560), (900000000, 1800000000, 3600000000, 0, 5842366107478917120), (0, 0, 1800000000, 900000000, 2190887290304593920),
])
def test_positions(spark, lat, lon, x, y, z):
    assert value(spark, *geo.from_node(lit(lat), lit(lon)), geo.zorder(lit(x), lit(y)), *geo.from_zorder(lit(z))) == (x, y, z, x, y)


def test_degrees_and_distance(spark):
    d = lambda v: F.lit(float(v))
    assert value(spark, *geo.from_degrees(d(0), d(5)), *geo.from_degrees(d(5), d(0))) == (0, 0, 0, 0)
    assert round(value(spark, geo.distance(d(52.5), d(13.4), d(48.1), d(11.6)))[0], 3) == 506198.591
    assert round(value(spark, geo.distance(d(0), d(0), d(0), d(90)))[0], 3) == 10018538.972
    assert value(spark, geo.distance(d(52.5), d(13.4), d(52.5), d(13.4)))[0] < 1
    assert value(spark, geo.to_int64(d(52.5), d(13.4)), geo.to_int64(d(52.5), d(13.4), legacy=True)) == (1670046682787602432, 0)


@pytest.mark.parametrize(("p", "want"), [((9, 5, 0, 0, 20, 10), True), ((8, 5, 0, 0, 20, 10), False), ((10, 0, 0, 0, 20, 10), False), ((30, 10, 0, 0, 20, 10), True), ((5, 5, 20, 0, 0, 10), False), ((11, 5, 20, 0, 0, 10), True)])
def test_crossings(spark, p, want):
    assert value(spark, geo.crosses(*map(lit, p))) == (want,)
    big = 1_000_000_000
    assert value(spark, geo.crosses(lit(p[0]), lit(p[1]), lit(-3 * big), lit(p[1] - big), lit(-2 * big), lit(p[1] + big))) == (True,)


def test_coding(spark):
    assert value(spark, codec.zigzag(lit(-5)), codec.unzigzag(lit(9))) == (9, -5)
    for v in (0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**63 - 1, -1):
        assert value(spark, codec.varint_length(lit(v))) == (len(varints.encode([v])),)
    assert varints.encode([300]) == b"\xac\x02"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_varints(values):
    data = np.frombuffer(varints.zigzag_encode(values), np.uint8)
    assert varints.zigzag_decode(data).tolist() == values
    assert layout.zigzag_bytes(np.array(values, np.int64)).sum() == len(data)


@given(st.lists(st.integers(-(2**61), 2**61), max_size=30))
def test_deltas(values):
    assert varints.delta_decode(np.frombuffer(varints.delta_encode(values), np.uint8)).tolist() == values


def test_tags(spark):
    rows = spark.createDataFrame([([("a", "1"), ("a", "2"), ("b", "3")],), ([],)], "tags array<struct<key:string,value:string>>")
    got = rows.select(tags.first(F.col("tags"), "a").alias("a"), tags.first(F.col("tags"), "z", "xx").alias("z"), tags.as_map(F.col("tags")).alias("m"), tags.has(F.col("tags"), "a", "2").alias("h")).collect()
    assert [tuple(r) for r in got] == [("1", "xx", {"a": "1", "b": "3"}, True), (None, "xx", {}, False)]


def test_grid(spark):
    got = [(r.x, r.y) for r in region.zigzag_grid(spark, 3).orderBy("place").collect()]
    assert got == [(0, 0), (1, 0), (0, 1), (0, 2), (1, 1), (2, 0), (2, 1), (1, 2), (2, 2)]


def test_bands_equal_the_naive_form(spark):
    seg = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(0, 0, 90, 100), (90, 100, 10, 300), (-50, 40, 10, 300), (-50, 40, 0, 0)])], "path_id int, pos int, x1 long, y1 long, x2 long, y2 long")
    seg = seg.select("path_id", "pos", *(F.when(F.col("y1") <= F.col("y2"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("x2", "x1"))), F.least("y1", "y2").alias("y1"), F.greatest("y1", "y2").alias("y2"))
    points = spark.range(4000).select(F.col("id").alias("p"), (F.col("id") * 37 % 200 - 100).alias("pos_x"), (F.col("id") * 53 % 350 - 20).alias("pos_y"))
    for bits in (3, 5, 22):
        got = {r.p for r in region.points_in_polygons(points, seg, "p", region.Grid(bits, bits, max(0, 8 - bits), -50)).collect()}
        hit = geo.crosses(*(F.col(c) for c in ("pos_x", "pos_y", "x1", "y1", "x2", "y2")))
        want = {r.p for r in points.crossJoin(seg.where("y1 < y2")).where(hit).groupBy("p").count().where("count % 2 = 1").collect()}
        assert got == want and got


def test_stitching_and_cycles(spark):
    ways = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [5, 4, 3]), (1, 3, [9, 8]), (1, 4, [5, 6])], "rel_id long, pos int, node_ids array<long>")
    got = [(r.node_id, r.joined) for r in topology.stitch(ways).orderBy("place").collect()]
    assert [n for n, _ in got] == [1, 2, 3, 4, 5, 6, 9, 8] and [n for n, j in got if not j] == [9]
    members = spark.createDataFrame([(1, 2, 2), (2, 2, 3), (3, 2, 1)], "rel_id long, type int, ref long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert sorted(tuple(r) for r in topology.closure(roots, members).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_pages(spark):
    nodes = spark.range(3000).select((F.col("id") * 3 - 500).alias("id"), (F.col("id") * 7919 % 800_000_000).cast("int").alias("lat_code"), (F.col("id") * 104729 % 1_700_000_000).cast("int").alias("lon_code"))
    pages = layout.node_pages(nodes)
    assert all(len(r.data) % layout.PAGE == 0 for r in pages.collect()) and pages.count() >= 3
    z = geo.zorder(*geo.from_node(F.col("lat_code"), F.col("lon_code")))
    assert {tuple(r) for r in layout.read_pages(pages).collect()} == {tuple(r) for r in nodes.select("id", z.alias("z")).collect()}
