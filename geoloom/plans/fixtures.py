"""A map dataset derived from the driver's tables: whole numbers only, so that SQL engines agree on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import geo, tags
from geoloom.scratch import scratch_path
from geoloom.sources import osmpbf

NATION, REGION = 1_000_000_000, 2_000_000_000
#: Entities of a block.
BLOCK = 100


class MapData:
    """nodes, ways, relations and what follows from them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """id, lat_code, lon_code, tags; a third of the nodes has none."""
        key, tagged = F.col("p_partkey"), F.col("p_size") % 3 != 0
        lat = 470_000_000 + key * 2_654_435_761 % 80_000_000
        lon = 60_000_000 + key * 1_640_531_513 % 90_000_000
        own = {k: F.when(tagged, F.col(c)) for k, c in (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type"))}
        return self.table("part").select((key + 1).alias("id"), lat.cast("int").alias("lat_code"), lon.cast("int").alias("lon_code"), tags.bag(**own).alias("tags"))

    def way_refs(self) -> DataFrame:
        """way_id, pos (from 1), node_id."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.table("lineitem").select((F.col("l_orderkey") + 1).alias("way_id"), F.row_number().over(w).alias("pos"), (F.col("l_partkey") + 1).alias("node_id"))

    def way_heads(self) -> DataFrame:
        own = tags.bag(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
        return self.table("orders").select((F.col("o_orderkey") + 1).alias("id"), own.alias("tags"))

    def ways(self) -> DataFrame:
        """id, tags, node_ids; some ways have no nodes."""
        refs = self.way_refs().groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda r: r["node_id"]).alias("node_ids"))
        out = self.way_heads().join(refs, F.col("id") == F.col("way_id"), "left")
        return out.select("id", "tags", F.coalesce("node_ids", F.array().cast("array<bigint>")).alias("node_ids"))

    def relations(self) -> DataFrame:
        """id, tags of customers, nations and regions."""
        c = self.table("customer").select((F.col("c_custkey") + 1).alias("id"), tags.bag(name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("tags"))
        n = self.table("nation").select((F.col("n_nationkey") + F.lit(NATION).cast("long")).alias("id"), tags.bag(name=F.col("n_name")).alias("tags"))
        r = self.table("region").select((F.col("r_regionkey") + F.lit(REGION).cast("long")).alias("id"), tags.bag(name=F.col("r_name")).alias("tags"))
        return c.unionByName(n).unionByName(r)

    def members(self) -> DataFrame:
        """rel_id, pos, type (0 node, 1 way, 2 relation), ref, role."""
        named = lambda rel, pos, kind, ref, role: [rel.cast("long").alias("rel_id"), pos.cast("int").alias("pos"), F.lit(kind).cast("tinyint").alias("type"), ref.cast("long").alias("ref"), role.alias("role")]
        parts = self.table("part").agg(F.count("*").alias("parts"))
        rank = lambda by, order: F.row_number().over(Window.partitionBy(by).orderBy(order))
        role = F.when(F.col("o_orderstatus") == "F", "inner").otherwise("outer")
        ways = self.table("orders").select(*named(F.col("o_custkey") + 1, rank("o_custkey", "o_orderkey"), 1, F.col("o_orderkey") + 1, role))
        centres = self.table("customer").join(F.broadcast(parts)).select(*named(F.col("c_custkey") + 1, F.lit(0), 0, F.col("c_custkey") % F.col("parts") + 1, F.lit("admin_centre")))
        customers = self.table("customer").select(*named(F.col("c_nationkey") + F.lit(NATION).cast("long"), rank("c_nationkey", "c_custkey"), 2, F.col("c_custkey") + 1, F.lit("subarea")))
        nations = self.table("nation").select(*named(F.col("n_regionkey") + F.lit(REGION).cast("long"), rank("n_regionkey", "n_nationkey"), 2, F.col("n_nationkey") + F.lit(NATION).cast("long"), F.lit("subarea")))
        return ways.unionByName(centres).unionByName(customers).unionByName(nations)

    def relation_members(self) -> DataFrame:
        """id, tags, members in order."""
        m = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type", "ref", "role"))), lambda x: F.struct(x["ref"].alias("id"), x["type"].alias("type"), x["role"].alias("role")))
        rows = self.members().groupBy("rel_id").agg(m.alias("members"))
        out = self.relations().join(rows, F.col("id") == F.col("rel_id"), "left")
        return out.select("id", "tags", F.coalesce("members", F.array().cast("array<struct<id:bigint,type:tinyint,role:string>>")).alias("members"))

    def file(self, *kinds: str) -> str:
        """A folder of map files with all nodes, ways or relations, in blocks of BLOCK ids, written now."""
        rows = {"nodes": self.nodes, "ways": self.ways, "relations": self.relation_members}
        return osmpbf.write(self.spark, scratch_path(self.spark, "map"), **{k: rows[k]() for k in kinds}, block=BLOCK)

    def points(self) -> DataFrame:
        """event_id, pos_x, pos_y."""
        e = F.col("event_id")
        y = geo.Y_ZERO - (470_000_000 + e * 2_246_822_519 % 80_000_000)
        x = geo.X_ZERO + 60_000_000 + e * 3_266_489_917 % 90_000_000
        return self.table("events").select("event_id", x.alias("pos_x"), y.alias("pos_y"))

    def rings(self) -> DataFrame:
        """path_id, pos, id: for each nation a closed path over the centres of its customers."""
        c = self.members().where("type = 0").select(F.col("rel_id").alias("ref"), F.col("ref").alias("id"))
        m = self.members().where(f"type = 2 and rel_id < {REGION}").select("rel_id", "pos", "ref").join(c, "ref")
        m = m.select(F.col("rel_id").alias("path_id"), "pos", "id")
        last = m.groupBy("path_id").agg((F.max("pos") + 1).alias("pos"), F.min_by("id", "pos").alias("id"))
        return m.unionByName(last.select("path_id", F.col("pos").cast("int"), "id"))

    def series(self) -> DataFrame:
        """grp, pos, v."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("grp"), F.row_number().over(w).alias("pos"), F.round(F.col("value") * 100).cast("long").alias("v"))

    def blobs(self) -> DataFrame:
        """One row a block of BLOCK entities of one kind: places and sizes in a file, and the id range of each kind."""
        kinds = [("node", self.nodes().select("id")), ("way", self.way_heads().select("id")), ("relation", self.relations().where(f"id < {NATION}").select("id"))]
        out = None
        for k, (kind, ids) in enumerate(kinds):
            per = ids.groupBy(F.floor((F.col("id") - 1) / BLOCK).alias("b")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
            columns = [(F.lit(k * 1_000_000_000).cast("long") + F.col("b") * 1000 + 1000).alias("pbf_ofs"), (100 + F.col("n") * 7).alias("blob_len"), F.lit(50).cast("long").alias("zlib_ofs"), (50 + F.col("n") * 7).alias("zlib_len"), (150 + F.col("n") * 21).alias("raw_size"), F.lit(True).alias("scanned")]
            for name, _ in kinds:
                own = name == kind
                columns += [(F.col("n") if own else F.lit(0).cast("long")).alias(f"{name}_count"), (F.col("lo") if own else F.lit(None).cast("long")).alias(f"min_{name}_id"), (F.col("hi") if own else F.lit(None).cast("long")).alias(f"max_{name}_id")]
            out = per.select(*columns) if out is None else out.unionByName(per.select(*columns))
        return out


#: The same tables in DuckDB; every oracle begins with this.
SQL = """
with nodes as (
  select p_partkey + 1 as id, (470000000 + (p_partkey * 2654435761) % 80000000)::int as lat_code, (60000000 + (p_partkey * 1640531513) % 90000000)::int as lon_code,
    case when p_size % 3 <> 0 then p_name end as name, case when p_size % 3 <> 0 then p_brand end as brand, case when p_size % 3 <> 0 then p_type end as type from part
), way_refs as (
  select l_orderkey + 1 as way_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::int as pos, l_partkey + 1 as node_id from lineitem
), ways as (select o_orderkey + 1 as id, o_orderstatus as status, o_orderpriority as priority from orders
), relations as (
  select c_custkey + 1 as id, c_name as name, c_mktsegment as segment from customer
  union all select 1000000000 + n_nationkey::bigint, n_name, null from nation union all select 2000000000 + r_regionkey::bigint, r_name, null from region
), members as (
  select o_custkey + 1 as rel_id, (row_number() over (partition by o_custkey order by o_orderkey))::int as pos, 1::tinyint as type, o_orderkey + 1 as ref, case when o_orderstatus = 'F' then 'inner' else 'outer' end as role from orders
  union all select c_custkey + 1, 0, 0, c_custkey % (select count(*) from part) + 1, 'admin_centre' from customer
  union all select 1000000000 + c_nationkey::bigint, (row_number() over (partition by c_nationkey order by c_custkey))::int, 2, c_custkey + 1, 'subarea' from customer
  union all select 2000000000 + n_regionkey::bigint, (row_number() over (partition by n_regionkey order by n_nationkey))::int, 2, 1000000000 + n_nationkey::bigint, 'subarea' from nation
), points as (
  select event_id, 1800000000 + 60000000 + (event_id * 3266489917) % 90000000 as pos_x, 900000000 - (470000000 + (event_id * 2246822519) % 80000000) as pos_y from events
), ring0 as (
  select m.rel_id as path_id, m.pos, c.ref as id from members m join members c on c.rel_id = m.ref and c.type = 0 where m.type = 2 and m.rel_id < 2000000000
), rings as (select * from ring0 union all select path_id, (max(pos) + 1)::int, arg_min(id, pos) from ring0 group by path_id
), series as (select user_id as grp, (row_number() over (partition by user_id order by ts, event_id))::int as pos, round(value * 100)::bigint as v from events
), blocks as (
  select 0 as k, (id - 1) // 100 as b, count(*) as n, min(id) as lo, max(id) as hi from nodes group by all
  union all select 1, (id - 1) // 100, count(*), min(id), max(id) from ways group by all
  union all select 2, (id - 1) // 100, count(*), min(id), max(id) from relations where id < 1000000000 group by all
), blobs as (
  select k * 1000000000 + b * 1000 + 1000 as pbf_ofs, 100 + n * 7 as blob_len, 50::bigint as zlib_ofs, 50 + n * 7 as zlib_len, 150 + n * 21 as raw_size, true as scanned,
    case when k = 0 then n else 0 end as node_count, case when k = 0 then lo end as min_node_id, case when k = 0 then hi end as max_node_id,
    case when k = 1 then n else 0 end as way_count, case when k = 1 then lo end as min_way_id, case when k = 1 then hi end as max_way_id,
    case when k = 2 then n else 0 end as relation_count, case when k = 2 then lo end as min_relation_id, case when k = 2 then hi end as max_relation_id from blocks
), pos as (select id, 1800000000 + lon_code::bigint as pos_x, 900000000 - lat_code::bigint as pos_y from nodes
), located as (select path_id, pos, r.id, p.pos_x, p.pos_y from rings r join pos p on p.id = r.id
), steps as (
  select path_id, pos, pos_x, pos_y, lag(pos_x) over (partition by path_id order by pos) as px, lag(pos_y) over (partition by path_id order by pos) as py from located
), segments as (
  select path_id, pos, case when py <= pos_y then px else pos_x end as x1, least(py, pos_y) as y1, case when py <= pos_y then pos_x else px end as x2, greatest(py, pos_y) as y2 from steps where px is not null
)"""
