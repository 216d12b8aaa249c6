"""Relations, ways and nodes put together: complete objects, hierarchies, walks, stitched paths."""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.scratch import drop_scratch, materialize

#: Digits of a member's position in a path: as many as an int has.
PLACE_DIGITS = 10


#: Rows that a task holds in memory where rows are told apart or joined: tasks grow in number with the input, not in size.
TASK_ROWS = 200_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks that rows are dealt over; the plan then keeps that number, whatever few bytes the rows pack into."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def explode_refs(ways: DataFrame) -> DataFrame:
    """way_id, pos (from 1), node_id."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("node_ids").alias("p", "node_id")).select("way_id", (F.col("p") + 1).alias("pos"), "node_id")


def complete_ways(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id and its distinct nodes."""
    n = tasks_for(refs)
    return refs.select("way_id", F.col("node_id").alias("id")).repartition(n, "way_id").distinct().repartition(n, "id").join(nodes, "id")


def relation_ways(members: DataFrame) -> DataFrame:
    """rel_id and its distinct ways."""
    return members.where("type = 1").select("rel_id", F.col("ref").alias("way_id")).distinct()


def relation_nodes(members: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """rel_id and its distinct nodes: those of its ways, and its node members."""
    n = tasks_for(refs)
    by_way = relation_ways(members).join(refs.repartition(n, "way_id"), "way_id").select("rel_id", F.col("node_id").alias("id"))
    own = members.where("type = 0").select("rel_id", F.col("ref").alias("id"))
    return by_way.unionByName(own).repartition(n, "rel_id", "id").distinct().repartition(n, "id").join(nodes, "id")


def expand_once(known: DataFrame, members: DataFrame) -> DataFrame:
    """id of the child relations of known (id) that aren't known."""
    children = members.where("type = 2").join(known.select(F.col("id").alias("rel_id")), "rel_id", "left_semi")
    return children.select(F.col("ref").alias("id")).distinct().join(known, "id", "left_anti")


def closure(roots: DataFrame, members: DataFrame) -> DataFrame:
    """root, id, depth of every relation under each root (id), itself included at depth 0, however deep; cycles end.

    Each level holds every pair at its smallest depth only and is written to the shared folder, so that no level is
    computed twice; the walk ends with the level that is empty.
    """
    edges = materialize(members.where("type = 2").select(F.col("rel_id").alias("id"), F.col("ref").alias("child")).distinct(), "child-relations")
    level = materialize(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct(), "closure-0")
    out, depth = level, 0
    while level.head(1):
        depth += 1
        found = level.join(edges, "id").select("root", F.col("child").alias("id")).distinct()
        new = found.join(out.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(depth).alias("depth"))
        level = materialize(new, f"closure-{depth}")
        out = out.unionByName(level)
    drop_scratch(edges)
    return out


def region_vertices(roots: DataFrame, members: DataFrame, refs: DataFrame) -> DataFrame:
    """root, role, node_id, place: vertices met by walking relations, ways and nodes in order, each once, however deep.

    A path of zero-padded member positions sorts like the depth-first walk.  Way roles are outer and inner; a
    node is kept at its first place, and an inner one only if no outer way of the root has it.  A relation within
    itself is not entered again.  Each level of relations is written to the shared folder; the walk ends with the
    level that is empty.
    """
    pad = lambda c: F.concat(F.lpad(F.col(c).cast("string"), PLACE_DIGITS, "0"), F.lit("/"))
    members = materialize(members.where("type in (1, 2)").select("rel_id", "pos", "type", "ref", "role"), "region-members")
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("rel_id"), F.lit("").alias("path"), F.array("id").alias("within")).distinct()
    level = materialize(level, "region-0")
    ways, depth = None, 0
    while ways is None or level.head(1):
        depth += 1
        step = level.join(members, "rel_id").withColumn("path", F.concat("path", pad("pos")))
        found = step.where("type = 1").select("root", "role", F.col("ref").alias("way_id"), "path")
        ways = found if ways is None else ways.unionByName(found)
        below = step.where("type = 2 and not array_contains(within, ref)").select("root", F.col("ref").alias("rel_id"), "path", F.concat("within", F.array("ref")).alias("within"))
        level = materialize(below, f"region-{depth}")
    at = ways.join(refs, "way_id").select("root", "role", "node_id", F.concat("path", pad("pos")).alias("place"))
    # the smallest place is found by sorting rows: many small tasks sort them, once for what follows too
    dealt = at.where("role in ('outer', 'inner')").repartition(tasks_for(refs), "root", "node_id")
    first = dealt.groupBy("root", "role", "node_id").agg(F.min("place").alias("place"))
    has_outer = F.max(F.when(F.col("role") == "outer", True).otherwise(False)).over(Window.partitionBy("root", "node_id"))
    return first.withColumn("outer_too", has_outer).where("role = 'outer' or not outer_too").drop("outer_too")


def stitch(ways: DataFrame) -> DataFrame:
    """rel_id, place, node_id, joined: the ways of each relation put head to tail in member order.

    ways: rel_id, pos, node_ids.  The first way begins; a later way whose first node is the open end follows it,
    one whose last node is the open end follows reversed; others wait.  joined is false where no way fits: the
    path then goes on with the next waiting way.  Sequential within a relation, so one group is one task's work:
    a group is one relation's ways, and its work grows in proportion to their nodes.
    """

    def fold(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        waiting = [x for x in rows["node_ids"].to_pylist() if x]
        ends = defaultdict(deque)  # ways that begin or end at a node, in member order
        for i, way in enumerate(waiting):
            for node in {way[0], way[-1]}:
                ends[node].append(i)
        used, upto, path, flags = [False] * len(waiting), 0, [], []
        for _ in waiting:
            fitting = ends[path[-1]] if path else ()
            while fitting and used[fitting[0]]:
                fitting.popleft()
            while used[upto]:
                upto += 1
            hit = bool(fitting)
            i = fitting[0] if hit else upto
            used[i], way = True, waiting[i]
            if hit and way[0] != path[-1]:
                way = way[::-1]
            fresh = way[1:] if hit else way
            flags += [hit or not path or k > 0 for k in range(len(fresh))]
            path += fresh
        rel = rows["rel_id"][0].as_py()
        return pa.table({"rel_id": pa.array([rel] * len(path), pa.int64()), "place": pa.array(range(len(path)), pa.int32()), "node_id": pa.array(path, pa.int64()), "joined": pa.array(flags, pa.bool_())})

    return ways.groupBy("rel_id").applyInArrow(fold, "rel_id long, place int, node_id long, joined boolean")


def same_rows(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """n_left, n_right: rows that only a, and only b, has, as often as it has them more; each is read once.  tasks: the number of them."""
    n = "rows_more_in_a"
    every = a.withColumn(n, F.lit(1).cast("long")).unionByName(b.withColumn(n, F.lit(-1).cast("long")))
    dealt = every.repartition(tasks, *a.columns) if tasks else every
    more = dealt.groupBy(*a.columns).agg(F.sum(n).alias(n))
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return more.agg(total(F.col(n)).alias("n_left"), total(-F.col(n)).alias("n_right"))
