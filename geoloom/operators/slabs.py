"""Points in the polygons of few paths with very many segments, slab by slab in arrays.

A slab is a run of points in the order of y.  In a slab a segment spans few columns: points to its left don't count
it, points to its right do if y is between its ends, and only those between are tested.  What lies to the left of a
point is summed up over all of a path's segments at once, so that nothing but the tests is done for each point and
segment.  All is exact: floating-point columns are widened by MARGIN, and what lies that near is tested in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Points and segments of a group, which one task holds.
GROUP_POINTS, GROUP_SEGMENTS = 1_000_000, 2_500_000
#: Segments that are looked at together, for the processor's cache.
RUN = 1 << 16
#: Units by which a crossing in floating point may be off; coordinates are below LARGEST.
MARGIN, LARGEST = 2.0, 1 << 40


def _crossing(y, x1, y1, x2, y2) -> np.ndarray:
    """geo.crossing() in arrays; numbers of any size where the product is beyond 64 bits."""
    step, dx, dy = 2 * (y - y1) - 1, x2 - x1, 2 * (y2 - y1)
    if len(step) and float(step.max()) * float(np.abs(dx).max()) > 2**62:
        step, dx, dy = step.astype(object), dx.astype(object), dy.astype(object)
    return np.where(dx < 0, -1, 1) * (step * abs(dx) // dy) + x1


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n places from low on: the number of the range, and the place, of each place in them."""
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(n)), n), np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(low - ends + n, n)


class Segments:
    """Segments (y1 < y2) in the order of their paths' numbers."""

    def __init__(self, path, x1, y1, x2, y2):
        order = np.argsort(path, kind="stable")
        self.path, self.x1, self.y1, self.x2, self.y2 = (c[order].astype(np.int64) for c in (path, x1, y1, x2, y2))
        self.slope = (self.x2 - self.x1) / (self.y2 - self.y1)
        self.paths = int(self.path[-1]) + 1 if len(path) else 0

    def inside(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path and place of the points of a slab, in the order of x, whose number of crossings is odd."""
        n, low, high = len(x), int(y.min()), int(y.max())
        columns = 4 * n
        scale = columns / (float(x[-1]) - float(x[0]) + 1)
        before = np.concatenate([[0], np.cumsum(np.bincount(((x - x[0]) * scale).astype(np.int64), minlength=columns))])
        count, beyond, turns = np.zeros(self.paths * n, np.int64), np.zeros(self.paths * (n + 1), np.int64), []

        def add(to: np.ndarray, at: np.ndarray) -> None:
            if len(at):
                base = int(at.min())
                found = np.bincount(at - base)
                to[base : base + len(found)] += found

        live = np.flatnonzero((self.y1 < high) & (self.y2 >= low))
        for run in (live[i : i + RUN] for i in range(0, len(live), RUN)):
            path, y1, slope = self.path[run], self.y1[run], self.slope[run]
            first, last = np.maximum(y1 + 1, low), np.minimum(self.y2[run], high)
            a = self.x1[run] + slope * (first - y1 - 0.5)
            b = a + slope * (last - first)
            place = lambda v: before[np.clip(((v - x[0]) * scale), -1, columns + 1).astype(np.int64).clip(0, columns)]
            left = place(np.minimum(a, b) - MARGIN)
            # all of the column of the right end are tested
            right = before[np.clip(np.floor((np.maximum(a, b) + MARGIN - x[0]) * scale) + 1, 0, columns).astype(np.int64)]
            of, at = _spread(left, right - left)
            own_y = y[at]
            off = a[of] + slope[of] * (own_y - first[of]) - x[at]
            hit, near = off <= -MARGIN, np.abs(off) < MARGIN
            near = np.flatnonzero(near)
            if len(near):
                s, k = run[of[near]], at[near]
                spans = (y[k] > self.y1[s]) & (y[k] <= self.y2[s])
                s, k, near = s[spans], k[spans], near[spans]
                hit[near] = _crossing(y[k], self.x1[s], self.y1[s], self.x2[s], self.y2[s]) <= x[k]
            hit = np.flatnonzero(hit)
            partial = (first > low) | (last < high)
            if partial.any():
                cut = hit[partial[of[hit]]]
                wrong = (own_y[cut] < first[of[cut]]) | (own_y[cut] > last[of[cut]])
                hit = np.setdiff1d(hit, cut[wrong], assume_unique=True)
            add(count, path[of[hit]] * n + at[hit])
            begins, ends = first > low, last < high
            add(beyond, path[~begins] * (n + 1) + right[~begins])
            turns += [(path[m], (first if m is begins else last + 1)[m], right[m]) for m in (begins, ends)]
        odd = count.reshape(self.paths, n) + np.cumsum(beyond.reshape(self.paths, n + 1), axis=1)[:, :n]
        if turns:
            self._turn(odd, y, *(np.concatenate(c) for c in zip(*turns, strict=True)))
        return np.nonzero(odd & 1)

    @staticmethod
    def _turn(odd: np.ndarray, y: np.ndarray, path: np.ndarray, since: np.ndarray, right: np.ndarray) -> None:
        """Count the points right of a place whose y is since or more.  Two such of one path and y, as where its segments
        meet, leave only the places between them."""
        order = np.lexsort((right, since, path))
        path, since, right = path[order], since[order], right[order]
        new = np.append(True, (path[1:] != path[:-1]) | (since[1:] != since[:-1]))
        rank = np.arange(len(path)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        start = np.flatnonzero(rank % 2 == 0)
        paired = np.append(rank[1:] % 2 == 1, False)[start]
        end = np.where(paired, np.append(right[1:], 0)[start], len(y))
        of, at = _spread(right[start], end - right[start])
        own = start[of]
        keep = y[at] >= since[own]
        np.add.at(odd, (path[own[keep]], at[keep]), 1)


def pairs(points: pa.Table, segments: pa.Table, key: str, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """path_id and key of the points in a path's polygon; a slab has so many points."""
    paths = segments["path_id"].combine_chunks().dictionary_encode()
    if isinstance(paths, pa.ChunkedArray):
        paths = paths.chunk(0)
    column = lambda t, c: t[c].to_numpy()
    seg = Segments(np.asarray(paths.indices), *(column(segments, c) for c in ("x1", "y1", "x2", "y2")))
    x, y, keys = column(points, "pos_x"), column(points, "pos_y"), points[key].combine_chunks()
    order = np.argsort(y, kind="stable")
    for at in range(0, len(order), size):
        slab = order[at : at + size]
        slab = slab[np.argsort(x[slab], kind="stable")]
        path, place = seg.inside(x[slab], y[slab])
        if len(path):
            yield pa.RecordBatch.from_arrays([paths.dictionary.take(pa.array(path)), keys.take(pa.array(slab[place]))], schema=schema)


def points_in_polygons(points: DataFrame, seg: DataFrame, key: str, n_points: int) -> DataFrame:
    """path_id and key, as region.points_in_polygons() has them.  seg is read several times and should be stored.

    Points go to bands of y that hold about as many each, and bands of very many points are dealt over several groups;
    a segment goes to the bands that it crosses, the paths being dealt where a band has very many segments.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = points.sparkSession
    out = StructType([StructField("path_id", seg.schema["path_id"].dataType), StructField(key, points.schema[key].dataType)])
    points = points.where("pos_x is not null and pos_y is not null")
    n_bands = max(1, min(n_points // 256, max(3 * spark.sparkContext.defaultParallelism, -(-n_points // GROUP_POINTS))))
    at = points.select(F.col("pos_y").cast("double").alias("y")).approxQuantile("y", [i / n_bands for i in range(1, n_bands)], 0.2 / n_bands) if n_bands > 1 else []
    edges = F.array(*(F.lit(int(e)).cast("long") for e in sorted(set(at)))) if at else F.array().cast("array<bigint>")
    band = lambda y: F.size(F.filter(edges, lambda e: e < y))
    per_band = {r.band: r["count"] for r in points.groupBy(band(F.col("pos_y")).alias("band")).count().collect()}
    copies = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for b, n in per_band.items() for v in (b, -(-n // GROUP_POINTS)))), F.col("band")), F.lit(0)) if per_band else F.lit(0)
    whole = lambda df, *names: df.withColumns({c: F.col(c).cast("long") for c in names})
    within = whole(seg, "x1", "y1", "x2", "y2").withColumn("band", F.explode(F.sequence(band(F.col("y1") + 1), band(F.col("y2")))))
    most = within.groupBy("band").count().agg(F.max("count")).first()[0] or 0
    of_path = seg.groupBy("path_id").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-most // GROUP_SEGMENTS))
    parted = of_path > GROUP_SEGMENTS
    chunk = lambda *by: F.pmod(F.xxhash64(*by), F.lit(chunks)).alias("chunk")
    dealt = whole(points.select(key, "pos_x", "pos_y"), "pos_x", "pos_y").withColumn("band", band(F.col("pos_y")))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("pos_x", "pos_y"), copies)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    within = within.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1L)")))
    within = within.select("path_id", "x1", "y1", "x2", "y2", "band", "copy", chunk(*(("path_id", "pos") if parted else ("path_id",))))
    # few large groups: more partitions than groups, so that few share one
    tasks = 3 * chunks * max(1, sum(-(-n // GROUP_POINTS) for n in per_band.values()))
    by, schema, size = ("band", "copy", "chunk"), to_arrow_schema(out), max(16, math.isqrt(n_points))

    def cross(points: pa.Table, segments: pa.Table) -> pa.Table:
        if not len(points) or not len(segments):
            return schema.empty_table()
        return pa.Table.from_batches(pairs(points, segments, key, size, schema), schema)

    found = dealt.repartition(tasks, *by).groupBy(*by).cogroup(within.repartition(tasks, *by).groupBy(*by)).applyInArrow(cross, out)
    # a pair is found once, unless a path's segments lie in several groups or points share a key
    if parted or points.groupBy(key).count().where("count > 1").head(1):
        found = found.groupBy("path_id", key).agg(F.count("*").alias("n")).where("n % 2 = 1").select("path_id", key)
    return found
