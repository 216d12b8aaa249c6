import random
import time

import pytest

from geoloom.operators import topology

MEMBERS = "rel_id long, pos int, type int, ref long, role string"


def chain(spark, n):
    """Relations 1 to n, each within the one before, the last within itself by way of the first; way 100 + i of each."""
    rows = [(i, 1, 2, i % n + 1, "") for i in range(1, n + 1)] + [(i, 2, 1, 100 + i, "outer") for i in range(1, n + 1)]
    refs = spark.createDataFrame([(100 + i, 1, 1000 + i) for i in range(1, n + 1)], "way_id long, pos int, node_id long")
    return spark.createDataFrame([(1,)], "id long"), spark.createDataFrame(rows, MEMBERS), refs


@pytest.mark.parametrize("n", [6, 20])
def test_deep_chains_that_end_in_a_cycle(spark, n):
    roots, members, refs = chain(spark, n)
    began = time.perf_counter()
    got = topology.closure(roots, members).collect()
    assert sorted(tuple(x) for x in got) == [(1, i, i - 1) for i in range(1, n + 1)]
    got = topology.region_vertices(roots, members, refs).orderBy("place").collect()
    assert [x.node_id for x in got] == [1000 + i for i in range(n, 0, -1)]
    assert time.perf_counter() - began < 120  # a level is computed once: the time grows with the levels


def test_closure_of_several_roots_and_repeated_edges(spark):
    edges = [(1, 2), (1, 2), (2, 3), (1, 3), (3, 1), (9, 9)]
    members = spark.createDataFrame([(a, i, 2, b, "") for i, (a, b) in enumerate(edges)], MEMBERS)
    roots = spark.createDataFrame([(1,), (9,), (9,), (5,)], "id long")
    got = sorted(tuple(x) for x in topology.closure(roots, members).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (5, 5, 0), (9, 9, 0)]
    assert topology.closure(roots.limit(0), members).count() == 0
    assert topology.region_vertices(roots.limit(0), members, spark.createDataFrame([], "way_id long, pos int, node_id long")).count() == 0


def test_positions_beyond_seven_digits(spark):
    members = spark.createDataFrame([(1, 9, 1, 10, "outer"), (1, 12_345_678, 1, 11, "outer")], MEMBERS)
    refs = spark.createDataFrame([(10, 1, 100), (11, 2_000_000_000, 200), (11, 3, 300)], "way_id long, pos int, node_id long")
    got = topology.region_vertices(spark.createDataFrame([(1,)], "id long"), members, refs).orderBy("place").collect()
    assert [x.node_id for x in got] == [100, 300, 200]


def plainly(ways):
    """The path by trying every waiting way in turn."""
    waiting, path, flags = [w for w in ways if w], [], []
    while waiting:
        hit = next((i for i, w in enumerate(waiting) if path and path[-1] in (w[0], w[-1])), None)
        way = waiting.pop(hit or 0)
        if hit is not None and way[0] != path[-1]:
            way = way[::-1]
        fresh = way if hit is None else way[1:]
        flags += [hit is not None or not path or i > 0 for i in range(len(fresh))]
        path += fresh
    return list(zip(path, flags, strict=True))


def test_stitch_against_plain_search(spark):
    r = random.Random(4)
    rows = [(rel, pos, [r.randrange(12) for _ in range(r.randrange(5))]) for rel in range(40) for pos in range(r.randrange(1, 12))]
    got = topology.stitch(spark.createDataFrame(rows, "rel_id long, pos int, node_ids array<long>").repartition(3)).orderBy("rel_id", "place").collect()
    want = [(rel, *x) for rel in range(40) for x in plainly([w for k, _, w in rows if k == rel])]
    assert [(x.rel_id, x.node_id, x.joined) for x in got] == want
