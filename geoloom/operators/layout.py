"""Storage layouts: spatial order, and pages of delta-coded nodes with a sparse index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.sources.wire import varints

PAGE = 4096


def spatially_sorted(nodes: DataFrame) -> DataFrame:
    """nodes with zpos, range-partitioned and sorted by it: written as Parquet, a box prunes row groups by zpos."""
    z = geo.zorder(*geo.from_node(F.col("lat_code"), F.col("lon_code")))
    out = nodes.withColumn("zpos", z)
    return out.repartitionByRange("zpos", "id").sortWithinPartitions("zpos", "id")


def zigzag_bytes(v: np.ndarray) -> np.ndarray:
    """Length of each value's zigzag varint."""
    u = (v.astype(np.int64) << 1 ^ v.astype(np.int64) >> 63).view(np.uint64)
    n = np.ones(len(u), np.int64)
    for k in range(1, 10):
        n += u >= np.uint64(1 << 7 * k)
    return n


def node_pages(nodes: DataFrame) -> DataFrame:
    """part, page, first_id, n, data: (id, zpos) steps as zigzag varints in pages of PAGE bytes, padded with zeros.

    Nodes are range-partitioned by id; each partition begins a page, and deltas restart there.
    """
    z = geo.zorder(*geo.from_node(F.col("lat_code"), F.col("lon_code")))
    dealt = nodes.select("id", z.alias("zpos")).repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def pages(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        ids, zs, part = (held[c].to_numpy() for c in ("id", "zpos", "part"))
        at, page = 0, 0
        while at < len(ids):
            upto = min(len(ids), at + PAGE // 2)
            step = np.stack([np.diff(ids[at:upto], prepend=0), np.diff(zs[at:upto], prepend=0)], 1)
            size = np.cumsum(zigzag_bytes(step.reshape(-1)).reshape(-1, 2).sum(1))
            n = max(1, int(np.searchsorted(size, PAGE, "right")))
            data = varints.zigzag_encode(step[:n].reshape(-1))
            yield pa.RecordBatch.from_pydict({"part": [int(part[0])], "page": [page], "first_id": [int(ids[at])], "n": [n], "data": [data + bytes(max(0, PAGE - len(data)))]}, schema=pa.schema([("part", pa.int32()), ("page", pa.int32()), ("first_id", pa.int64()), ("n", pa.int32()), ("data", pa.binary())]))
            at, page = at + n, page + 1

    return dealt.mapInArrow(pages, "part int, page int, first_id long, n int, data binary")


def read_pages(pages: DataFrame) -> DataFrame:
    """id, zpos of node_pages()."""

    def rows(batches):
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                step = varints.zigzag_decode(np.frombuffer(data, np.uint8), 2 * n).reshape(-1, 2).cumsum(0)
                yield pa.RecordBatch.from_arrays([pa.array(step[:, 0]), pa.array(step[:, 1])], ["id", "zpos"])

    return pages.mapInArrow(rows, "id long, zpos long")
