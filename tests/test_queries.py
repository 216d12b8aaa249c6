"""Every query against its DuckDB equivalent, and the plans of some."""

import contextlib
import gzip
import io
import struct
import zlib

import duckdb
import pytest

import __spark_entry__
from geoloom.operators import region
from geoloom.plans.fixtures import MapData
from geoloom.plans.oracles import ORACLES
from geoloom.plans.queries import QUERIES
from geoloom.sources.wire import varints

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    a = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
    b = sorted(duck.sql(f"select {listed} from ({ORACLES[name]})").fetchall(), key=str)
    assert a == b and a


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    points = spark.createDataFrame([(1, 2, 3)], "p int, pos_x long, pos_y long")
    seg = spark.createDataFrame([(1, 1, 0, 0, 5, 5)], "path_id int, pos int, x1 long, y1 long, x2 long, y2 long")
    celled = plan(region.points_in_polygons(points, seg, "p"))
    assert "NestedLoop" not in celled and "Cartesian" not in celled
    assert "BroadcastHashJoin" not in celled and "SortMergeJoin" in celled
    own = {n for n in ORACLES if n.startswith("source_") or n == "dense_decode"}  # these read files
    eager = {"relation_closure", "region_vertices", "point_in_polygon", "raster_fill", "blob_tsv_roundtrip"}  # these write tables as they go
    for name in set(ORACLES) - own - eager:
        assert "Python" not in plan(QUERIES[name](spark, DIR)) and "Arrow" not in plan(QUERIES[name](spark, DIR)), name
    assert "ReadSchema: struct<p_partkey:bigint>" in plan(QUERIES["gps_from_node"](spark, DIR))


def test_rows_only(spark):
    path = QUERIES["stitch_path"](spark, DIR).collect()
    assert path and len({(r.rel_id, r.place) for r in path}) == len(path)
    series = {}
    for r in MapData(spark, DIR).series().where("v < 32768").collect():
        series.setdefault(r.grp, []).append((r.pos, r.v))
    sizes = {r.grp: r for r in QUERIES["packed_sizes"](spark, DIR).collect()}
    for grp, rows in series.items():
        v = [x for _, x in sorted(rows)]
        step = [b - a for a, b in zip([0, *v], v, strict=False)]
        forms = [struct.pack(f"<{len(v)}h", *v), struct.pack(f"<{len(v)}h", *step), varints.zigzag_encode(step)]
        assert tuple(sizes[grp]) == (grp, 2 * len(v), *(len(gzip.compress(x, 9)) for x in forms))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.crc == zlib.crc32((docs[r.doc_id] or "").encode()) for r in QUERIES["crc32_text"](spark, DIR).collect())
