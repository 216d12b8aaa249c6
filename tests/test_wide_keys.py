"""Keys of tables far larger than the test data's."""

import duckdb

from geoloom.plans.oracles import ORACLES
from geoloom.plans.queries import QUERIES


def test_varint_length_past_a_long(spark, tmp_path):
    """The query's own SQL gives the lengths once the keys are of a type that holds the product; on longs it overflows too."""
    keys = [0, 1, 11, 3_036_999, 3_037_000, 2_000_000, 9_000_000, 54_000_000, 10**12, 10**15, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    every = QUERIES["varint_length"](spark, str(tmp_path))
    assert every.where("o_orderkey is null").first().n is None and every.count() == len(keys)
    got = sorted(every.where("o_orderkey is not null").collect())
    con = duckdb.connect()
    values = ", ".join(f"({k})" for k in keys if k is not None)
    con.sql(f"create view orders as select k::hugeint as o_orderkey from (values {values}) t(k)")
    want = con.sql("select o_orderkey, n, n_negative from (" + "select o_orderkey, " + ORACLES["varint_length"].rsplit("select o_orderkey, ", 1)[1] + ")").fetchall()
    assert [tuple(r) for r in got] == sorted(want)
    assert {r.n for r in got} >= {1, 4, 9, 10, 11, 15}
