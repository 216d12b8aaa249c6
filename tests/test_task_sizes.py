"""Rows are told apart by tasks whose number, and not whose size, grows with the input."""

import contextlib
import io
import re

from geoloom.operators import topology
from geoloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def dealings(df):
    """Numbers of partitions of the plan's exchanges that stay as they are."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", out.getvalue())]


def test_same_rows_counts_repeated_ones(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "a int, b string")
    a, b = rows((1, "x"), (1, "x"), (2, None), (3, "z")), rows((1, "x"), (2, None), (4, "w"), (4, "w"), (5, "v"))
    for tasks in (None, 3):
        assert tuple(topology.same_rows(a, b, tasks).first()) == (2, 3)
        assert tuple(topology.same_rows(a, a, tasks).first()) == (0, 0) and tuple(topology.same_rows(a.limit(0), b.limit(0), tasks).first()) == (0, 0)


def test_bundle_equality_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(topology, "TASK_ROWS", 100)
    df = QUERIES["bundle_equality"](spark, DIR)
    assert min(dealings(df)) > 50 and len(dealings(df)) >= 6
    assert tuple(df.first()) == (0, 0)


def test_region_vertices_is_dealt_by_rows(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["region_vertices"](spark, DIR).collect()))
    monkeypatch.setattr(topology, "TASK_ROWS", 100)
    df = QUERIES["region_vertices"](spark, DIR)
    assert dealings(df) and min(dealings(df)) > 50
    assert sorted(map(tuple, df.collect())) == want
