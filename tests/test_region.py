"""Points in polygons against the crossing rule over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import region


def crossed(x, y, x1, y1, x2, y2):
    if not y1 < y <= y2 or (x1 > x and x2 > x):
        return False
    a, b = (2 * y - 2 * y1 - 1) * (x2 - x1), 2 * y2 - 2 * y1
    return x1 + (abs(a) // b) * (1 if a >= 0 else -1) <= x


def paths(r, n, size, scale):
    """Closed and open paths with flat edges, repeated vertices and spikes."""
    rows = []
    for path in range(n):
        x, y = r.randrange(size), r.randrange(size)
        vertices = [(x, y)]
        for _ in range(r.randrange(2, 14)):
            x, y = (r.randrange(size), r.choice([y, r.randrange(size)])) if r.random() < scale else (x + r.randrange(-4, 5), y + r.randrange(-4, 5))
            vertices.append((x, y))
        if r.random() < 0.8:
            vertices.append(vertices[0])
        rows += [(path, i, *v) for i, v in enumerate(vertices)]
    return rows


@pytest.mark.parametrize("seed, size, scale", [(1, 12, 1.0), (2, 300, 0.7), (3, 100_000, 0.3), (4, 3_000_000_000, 1.0)])
def test_against_every_pair(spark, seed, size, scale):
    r = random.Random(seed)
    places = spark.createDataFrame(paths(r, 12, size, scale), "path_id long, pos int, pos_x long, pos_y long")
    seg = region.segments(places)
    corners = [(x.pos_x + r.randrange(-1, 2), x.pos_y + r.randrange(-1, 2)) for x in places.collect()]
    rows = [(i, *p) for i, p in enumerate(corners + [(r.randrange(-5, size + 5), r.randrange(-5, size + 5)) for _ in range(300)])]
    points = spark.createDataFrame(rows, "p long, pos_x long, pos_y long")
    lines = seg.collect()
    want = set()
    for i, x, y in rows:
        for path in range(12):
            if sum(crossed(x, y, s.x1, s.y1, s.x2, s.y2) for s in lines if s.path_id == path) % 2:
                want.add((path, i))
    got = [tuple(x) for x in region.points_in_polygons(points, seg, "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert region.points_in_polygons(points.limit(0), seg, "p").count() == 0 and region.points_in_polygons(points, seg.limit(0), "p").count() == 0


def test_few_exact_tests(spark):
    """Long random edges: cells leave a point at least 20 times fewer tests than a band without cells has."""
    r = random.Random(8)
    size, n = 90_000_000, 1500
    places = spark.createDataFrame([(i % 5, i // 5, r.randrange(size), r.randrange(size)) for i in range(n)], "path_id long, pos int, pos_x long, pos_y long")
    seg = region.segments(places)
    grid = region.Grid.over(seg, 100_000)
    pieces = region._pieces(seg, grid)
    cells = (size >> grid.row_bits) * (size >> grid.column_bits)
    tests = pieces.agg(F.sum(F.col("right") - F.col("left") + 1)).first()[0] / cells
    banded = region.bands(seg).count() / (size >> region.BAND_BITS)
    assert tests * 20 < banded
