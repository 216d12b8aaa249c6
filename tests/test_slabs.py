"""Points in polygons slab by slab: against cells and against the crossing rule over all pairs."""

import random

import pytest
from test_region import crossed, paths

from geoloom.operators import region, slabs


@pytest.mark.parametrize("seed, size, scale", [(1, 12, 1.0), (2, 300, 0.7), (3, 100_000, 0.3), (4, 3_000_000_000, 1.0)])
def test_against_every_pair(spark, seed, size, scale, monkeypatch):
    r = random.Random(seed)
    places = spark.createDataFrame(paths(r, 12, size, scale), "path_id int, pos int, pos_x long, pos_y long")
    seg = region.segments(places)
    corners = [(x.pos_x + r.randrange(-1, 2), x.pos_y + r.randrange(-1, 2)) for x in places.collect()]
    rows = [(i, *p) for i, p in enumerate(corners + [(r.randrange(-5, size + 5), r.randrange(-5, size + 5)) for _ in range(600)])]
    rows += [(len(rows) - 1, *rows[3][1:]), rows[5]]  # keys that repeat, at another place and at the same
    points = spark.createDataFrame(rows, "p long, pos_x long, pos_y long")
    lines = seg.collect()
    n = {}
    for i, x, y in rows:
        for s in lines:
            if crossed(x, y, s.x1, s.y1, s.x2, s.y2):
                n[s.path_id, i] = n.get((s.path_id, i), 0) + 1
    want = sorted(k for k, v in n.items() if v % 2)
    up = seg.where("y1 < y2")
    assert sorted(map(tuple, slabs.points_in_polygons(points, up, "p", len(rows)).collect())) == want and want
    # bands in several groups, paths dealt, and segments of one path dealt
    for limits in ({"GROUP_POINTS": 100, "GROUP_SEGMENTS": 40}, {"GROUP_SEGMENTS": 3}):
        for name, value in limits.items():
            monkeypatch.setattr(slabs, name, value)
        assert sorted(map(tuple, slabs.points_in_polygons(points, up, "p", len(rows)).collect())) == want
    assert slabs.points_in_polygons(points.limit(0), up, "p", 0).count() == 0 and slabs.points_in_polygons(points, up.limit(0), "p", 9).count() == 0


def test_few_paths_of_many_segments_make_no_rows_a_piece(spark, monkeypatch):
    """Slabs are taken for few large paths, cells for many small ones; the result and its types are the same."""
    r = random.Random(5)
    size = 90_000_000
    places = spark.createDataFrame([(i % 3, i // 3, r.randrange(size), r.randrange(size)) for i in range(3000)], "path_id int, pos int, pos_x long, pos_y long")
    points = spark.range(20_000).selectExpr("id as p", f"id * 3266489917 % {size} as pos_x", f"id * 2246822519 % {size} as pos_y")
    seg = region.segments(places)
    assert not region.in_slabs(seg, 20_000)
    cells = region.points_in_polygons(points, seg, "p")
    monkeypatch.setattr(region, "MANY_PIECES", 10_000)
    assert region.in_slabs(seg, 20_000) and not region.in_slabs(seg.selectExpr("pos as path_id", "pos", "x1", "y1", "x2", "y2"), 20_000)
    monkeypatch.setattr(region, "_pieces", None)  # slabs cut no pieces
    got = region.points_in_polygons(points, seg, "p")
    assert got.schema.simpleString() == cells.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cells.collect()))
