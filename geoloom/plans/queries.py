"""Every operator as a query over the derived map dataset; thin, so that the operators do the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.functions import codec, geo, tags
from geoloom.operators import layout, lookup, region, stats, topology
from geoloom.plans.fixtures import NATION, REGION, MapData
from geoloom.scratch import materialize, scratch_path
from geoloom.sources import osmpbf, text
from geoloom.sources.osmpbf import BLOB_FIELDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Ids that lookups ask for: unsorted, one twice, one beyond every block.
ASKED = [77, 3, 500, 77, 999_999_999]
#: Image height and padding of projections; raster width and height; grid size.
HEIGHT, PADDING, RASTER, GRID = 800, 10, (40, 40), 8


def query(f: Callable[[MapData], DataFrame]) -> Callable[[MapData], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(MapData(spark, sf_dir))
    return f


def _node_tags(df: DataFrame) -> list:
    return [tags.first(F.col("tags"), k).alias(k) for k in ("name", "brand", "type")]


# scans


@query
def scan_nodes(d):
    n = d.nodes()
    return n.select("id", "lat_code", "lon_code", *_node_tags(n))


@query
def scan_ways(d):
    return d.ways().select("id", tags.first(F.col("tags"), "status").alias("status"), F.size("node_ids").alias("n_refs"))


@query
def scan_relations(d):
    return d.relations().select("id", tags.first(F.col("tags"), "name").alias("name"), F.size("tags").alias("n_tags"))


@query
def explode_way_refs(d):
    return topology.explode_refs(d.ways())


@query
def blob_index_by_entity(d):
    return stats.by_entity(d.blobs())


@query
def blob_stats(d):
    out = None
    for k, ids in (("node", d.nodes()), ("way", d.way_heads()), ("relation", d.relations().where(f"id < {NATION}"))):
        own = stats.block_stats(ids.select("id"), 100).withColumn("entity", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


@query
def entity_totals(d):
    return stats.totals(d.blobs())


@query
def byte_totals(d):
    return stats.byte_totals(d.blobs())


@query
def blob_tsv_roundtrip(d):
    path = scratch_path(d.spark, "blobs-tsv")
    text.write_tsv(d.blobs(), path, list(BLOB_FIELDS), "gzip")
    return text.read_tsv(d.spark, path, [(c, "boolean" if c == "scanned" else "long") for c in BLOB_FIELDS])


@query
def point_text_parse(d):
    e = F.col("event_id")
    between = F.element_at(F.array(F.lit(","), F.lit("  "), F.lit("\t")), (e % 3 + 1).cast("int"))
    line = F.concat((F.col("pos_x") - geo.X_ZERO).cast("string"), between, (geo.Y_ZERO - F.col("pos_y")).cast("string"))
    x, y = text.parse_point(line)
    return d.points().select("event_id", x.alias("x"), y.alias("y"))


# the same through the source: the dataset is written as map files and read back


@query
def dense_decode(d):
    return osmpbf.read(d.spark, d.file("nodes"), tags="false").select("id", "lat_code", "lon_code")


@query
def source_nodes(d):
    n = osmpbf.read(d.spark, d.file("nodes"))
    return n.select("id", "lat_code", "lon_code", *_node_tags(n))


@query
def source_ways(d):
    return osmpbf.read(d.spark, d.file("ways"), "way").select("id", tags.first(F.col("tags"), "status").alias("status"), F.size("node_ids").alias("n_refs"))


@query
def source_way_refs(d):
    return topology.explode_refs(osmpbf.read(d.spark, d.file("ways"), "way", tags="false"))


@query
def source_relations(d):
    return osmpbf.read(d.spark, d.file("relations"), "relation").select("id", tags.first(F.col("tags"), "name").alias("name"), F.size("tags").alias("n_tags"))


@query
def source_members(d):
    r = osmpbf.read(d.spark, d.file("relations"), "relation", tags="false")
    return r.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("place", "m")).select("rel_id", "place", "m.type", F.col("m.id").alias("ref"), "m.role")


@query
def source_blob_stats(d):
    b = osmpbf.read(d.spark, d.file("nodes", "ways", "relations"), "blob")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), *(F.col(c).alias(n) for c, n in ((f"{k}_count", "n"), (f"min_{k}_id", "min_id"), (f"max_{k}_id", "max_id")))) for k in stats.KINDS)))
    e = b.select(rows.alias("e")).select("e.*").where(f"n > 0 and not (entity = 'relation' and min_id >= {NATION})")
    return e.withColumn("block", F.floor((F.col("min_id") - 1) / 100))


def _indexed(d, kinds: str, entity: str) -> DataFrame:
    """An entity, its blocks pruned by an index made now."""
    path, index = d.file(kinds), scratch_path(d.spark, "map-index")
    osmpbf.write_index(d.spark, path, index)
    return osmpbf.read(d.spark, path, entity, index=index)


@query
def source_lookup_nodes(d):
    n = _indexed(d, "nodes", "node")
    return lookup.lookup(n.select("id", "lat_code", "lon_code", *_node_tags(n)), ASKED)


@query
def source_lookup_ways(d):
    w = _indexed(d, "ways", "way")
    return lookup.lookup(w.select("id", tags.first(F.col("tags"), "status").alias("status"), F.size("node_ids").cast("long").alias("n_refs")), ASKED)


@query
def source_lookup_relations(d):
    r = _indexed(d, "relations", "relation")
    return lookup.lookup(r.select("id", tags.first(F.col("tags"), "name").alias("name")), [*ASKED[:4], REGION + 1, ASKED[4]])


@query
def source_prune_blobs(d):
    path, index = d.file("nodes"), scratch_path(d.spark, "map-index")
    osmpbf.write_index(d.spark, path, index)
    return lookup.prune_blocks(d.spark.read.parquet(index), ASKED, "node").select("min_node_id", "max_node_id")


@query
def blob_to_string(d):
    b = d.blobs()
    return b.select("pbf_ofs", stats.blob_text({c: F.col(c) for c in b.columns}).alias("text"))


@query
def member_to_string(d):
    return d.members().select("rel_id", "pos", "type", stats.member_text(F.col("type"), F.col("ref"), F.col("role")).alias("text"))


@query
def block_file_order(d):
    name = F.concat(F.lit("../tmp/node_block_"), (F.col("pbf_ofs") * 7919 % 10007).cast("string"), F.lit("_"), F.col("node_count").cast("string"), F.lit(".dat"))
    files = d.blobs().where("node_count > 0").select("pbf_ofs", name.alias("name")).withColumn("number", text.file_number(F.col("name")))
    return files.orderBy("number", "pbf_ofs")


# filters and tags


@query
def node_degrees(d):
    return d.nodes().select("id", (F.col("lat_code") / F.lit(1e7)).alias("lat"), (F.col("lon_code") / F.lit(1e7)).alias("lon"))


@query
def search_relations_by_tag(d):
    return d.relations().where(tags.has(F.col("tags"), "segment", "BUILDING")).select("id", tags.first(F.col("tags"), "name").alias("name"))


@query
def tag_value_default(d):
    return d.relations().select("id", tags.first(F.col("tags"), "segment", "xx").alias("segment"))


@query
def members_by_type(d):
    rows = d.members().groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "ref", "role"))).alias("members"))
    return rows.select("rel_id", F.explode(tags.members_of(F.col("members"), 1)).alias("m")).select("rel_id", "m.pos", "m.ref")


@query
def members_by_role(d):
    return d.members().where("role = 'outer'").select("rel_id", "pos", "ref")


@query
def tagged_nodes(d):
    return d.nodes().where(F.size("tags") > 0).select("id", F.size("tags").alias("n_tags"))


# lookups and joins


@query
def lookup_nodes(d):
    n = d.nodes()
    return lookup.lookup(n.select("id", "lat_code", "lon_code", *_node_tags(n)), ASKED)


@query
def lookup_ways(d):
    refs = d.way_refs().where(F.col("way_id").isin(ASKED)).groupBy("way_id").agg(F.count("*").alias("n_refs"))
    heads = d.way_heads().join(refs, F.col("id") == F.col("way_id"), "left")
    return lookup.lookup(heads.select("id", tags.first(F.col("tags"), "status").alias("status"), F.coalesce("n_refs", F.lit(0)).alias("n_refs")), ASKED)


@query
def lookup_relations(d):
    return lookup.lookup(d.relations().select("id", tags.first(F.col("tags"), "name").alias("name")), [*ASKED[:4], REGION + 1, ASKED[4]])


@query
def prune_blobs(d):
    return lookup.prune_blocks(d.blobs(), ASKED, "node").select("pbf_ofs", "min_node_id", "max_node_id")


@query
def position_lookup(d):
    return d.ways().select("id", lookup.position_in(F.col("node_ids"), F.array_min("node_ids")).alias("place"), lookup.position_in(F.col("node_ids"), F.lit(77).cast("long")).alias("place_77"))


@query
def complete_way(d):
    return topology.complete_ways(d.way_refs(), d.nodes()).select("way_id", "id", "lat_code", "lon_code")


@query
def complete_relation_ways(d):
    return topology.relation_ways(d.members()).join(d.way_heads(), F.col("way_id") == F.col("id")).select("rel_id", "way_id", tags.first(F.col("tags"), "status").alias("status"))


@query
def complete_relation_nodes(d):
    return topology.relation_nodes(d.members(), d.way_refs(), d.nodes()).select("rel_id", "id", "lat_code", "lon_code")


@query
def cache_misses(d):
    cached = d.members().where("type = 1 and role = 'inner'").select(F.col("rel_id").alias("id")).distinct()
    return lookup.misses(d.relations(), cached).select("id")


@query
def bundle_equality(d):
    m, refs, n = d.members(), d.way_refs(), d.nodes().select("id", "lat_code")
    direct = topology.relation_nodes(m, refs, n).select("rel_id", "id", "lat_code")
    tasks = topology.tasks_for(refs)
    in_way = topology.complete_ways(refs, n).repartition(tasks, "way_id").join(topology.relation_ways(m), "way_id").select("rel_id", "id", "lat_code")
    own = m.where("type = 0").select("rel_id", F.col("ref").alias("id")).join(n, "id").select("rel_id", "id", "lat_code")
    return topology.same_rows(direct, in_way.unionByName(own).repartition(tasks, "rel_id", "id", "lat_code").distinct(), tasks)


@query
def expand_relations_once(d):
    return topology.expand_once(d.relations().where(f"id >= {REGION}").select("id"), d.members())


@query
def relation_closure(d):
    return topology.closure(d.relations().where(f"id >= {REGION}").select("id"), d.members())


@query
def region_vertices(d):
    return topology.region_vertices(d.relations().where(f"id >= {REGION}").select("id"), d.members(), d.way_refs())


@query
def stitch_path(d):
    ways = d.members().where("type = 1").select("rel_id", "pos", "ref").join(d.ways(), F.col("ref") == F.col("id"))
    return topology.stitch(ways.select("rel_id", "pos", "node_ids"))


@query
def assert_cardinality(d):
    n = d.way_refs().groupBy("way_id").agg(F.count("*").alias("n"))
    rows = d.ways().join(n, F.col("id") == F.col("way_id"))
    return rows.where(F.assert_true(F.size("node_ids") == F.col("n")).isNull()).select("id", F.col("n").alias("n_refs"))


@query
def distinct_sorted_ids(d):
    return d.way_refs().select(F.col("node_id").alias("id")).distinct().orderBy("id")


@query
def way_endpoints(d):
    return d.ways().where(F.size("node_ids") > 0).select("id", F.element_at("node_ids", 1).alias("first_node"), F.element_at("node_ids", -1).alias("last_node"), F.element_at(F.reverse("node_ids"), 1).alias("first_reversed"))


# positions


def _degrees(d):
    """Nodes in degrees; each 50th lies on the equator."""
    lat = F.when(F.col("id") % 50 == 0, 0.0).otherwise(F.col("lat_code") / F.lit(1e7))
    return d.nodes().select("id", lat.alias("lat"), (F.col("lon_code") / F.lit(1e7)).alias("lon"))


def _positions(d):
    x, y = geo.from_node(F.col("lat_code"), F.col("lon_code"))
    return d.nodes().select("id", x.alias("pos_x"), y.alias("pos_y"))


@query
def gps_from_degrees(d):
    x, y = geo.from_degrees(F.col("lat"), F.col("lon"))
    return _degrees(d).select("id", x.alias("pos_x"), y.alias("pos_y"))


@query
def gps_from_node(d):
    return _positions(d)


@query
def gps_to_degrees(d):
    lat, lon = geo.to_degrees(F.col("pos_x"), F.col("pos_y"))
    return d.points().select("event_id", lat.alias("lat"), lon.alias("lon"))


@query
def gps_rounded(d):
    lat, lon = geo.to_degrees(F.col("pos_x"), F.col("pos_y"))
    return d.points().select("event_id", geo.rounded(lat / 3).alias("lat"), geo.rounded(lon / 3).alias("lon"))


@query
def gps_to_int64(d):
    lat, lon = F.col("lat"), F.col("lon")
    return _degrees(d).select("id", geo.to_int64(lat, lon).alias("code"), geo.to_int64(lat, lon, legacy=True).alias("legacy_code"))


@query
def gps_to_string(d):
    return _degrees(d).select("id", geo.text(F.col("lat"), F.col("lon")).alias("text"))


@query
def zorder_encode(d):
    return d.points().select("event_id", geo.zorder(F.col("pos_x"), F.col("pos_y")).alias("z"))


@query
def zorder_decode(d):
    """Codes that no encoder made."""
    z = (F.col("event_id") + 1) * 2_654_435_761 * 97
    x, y = geo.from_zorder(z)
    return d.points().select("event_id", x.alias("pos_x"), y.alias("pos_y"))


def _next(df: DataFrame, *columns: str) -> DataFrame:
    """df beside the row of the next id."""
    return df.join(df.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"{c}2") for c in columns)), "id")


@query
def gps_distance(d):
    n = node_degrees(d)
    return _next(n, "lat", "lon").select("id", F.round(geo.distance(*(F.col(c) for c in ("lat", "lon", "lat2", "lon2"))), 3).alias("metres"))


@query
def gps_distance_pos(d):
    return _next(_positions(d), "pos_x", "pos_y").select("id", F.round(geo.distance_pos(*(F.col(c) for c in ("pos_x", "pos_y", "pos_x2", "pos_y2"))), 3).alias("metres"))


@query
def gps_distance_z(d):
    z = _positions(d).select("id", geo.zorder(F.col("pos_x"), F.col("pos_y")).alias("z"))
    return _next(z, "z").select("id", F.round(geo.distance_zorder(F.col("z"), F.col("z2")), 3).alias("metres"))


@query
def bounding_box(d):
    return region.bounding_box(region.located(d.rings(), d.nodes()), "path_id")


# regions


def _segments(d):
    return region.segments(region.located(d.rings(), d.nodes()))


def _way_segments(d):
    refs = d.way_refs().select(F.col("way_id").alias("path_id"), "pos", F.col("node_id").alias("id"))
    return region.segments(region.located(refs, d.nodes()))


@query
def way_segments(d):
    return _way_segments(d)


@query
def segments_sorted(d):
    w = Window.partitionBy("path_id").orderBy("y1", "pos")
    return _segments(d).select("path_id", F.row_number().over(w).alias("place"), "y1", "x1")


@query
def segment_bands(d):
    return region.bands(_segments(d)).select("path_id", "pos", "band")


@query
def max_lines_per_latitude(d):
    return _way_segments(d).groupBy("y1").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total"))


@query
def point_in_polygon(d):
    return region.points_in_polygons(d.points(), _segments(d), "event_id")


@query
def raster_fill(d):
    places = materialize(region.located(d.rings(), d.nodes()), "places")  # for the box, the grid's count and the segments
    grid = region.raster(d.spark, region.bounding_box(places), *RASTER)
    return region.points_in_polygons(grid, region.segments(places), "pixel").groupBy("path_id").agg(F.count("*").alias("filled"))


@query
def pixel_project(d):
    """East and north codes of the points, to pixels and back."""
    codes = d.points().select("event_id", (F.col("pos_x") - geo.X_ZERO).alias("pos_x"), (F.lit(geo.Y_ZERO) - F.col("pos_y")).alias("pos_y"))
    box = region.bounding_box(codes).select(F.struct("*").alias("box"))
    at = codes.join(F.broadcast(box))
    c, r = region.to_pixel(F.col("pos_x"), F.col("pos_y"), "box", HEIGHT, PADDING)
    at = at.withColumns({"c": c, "r": r})
    x, y = region.from_pixel(F.col("c"), F.col("r"), "box", HEIGHT, PADDING)
    return at.select("event_id", "c", "r", x.alias("back_x"), y.alias("back_y"))


@query
def zigzag_grid(d):
    return region.zigzag_grid(d.spark, GRID)


# coding and layout


@query
def varint_length(d):
    v = F.col("o_orderkey")
    return d.table("orders").select("o_orderkey", codec.varint_length_product(v, v, F.lit(1_000_003)).alias("n"), codec.varint_length(-v - 1).alias("n_negative"))


@query
def zigzag_encode(d):
    return d.series().select("grp", "pos", codec.zigzag(F.col("v") - 5000).alias("u"))


@query
def zigzag_decode(d):
    """Numbers of either parity that no encoder made."""
    return d.table("orders").select("o_orderkey", codec.unzigzag(F.col("o_orderkey") * 3 + F.col("o_custkey")).alias("v"))


@query
def delta_encode(d):
    return codec.delta(d.series(), ["grp"], ["pos"], "v", "step").select("grp", "pos", "step")


@query
def delta_decode(d):
    """The series itself taken as steps."""
    return codec.undelta(d.series(), ["grp"], ["pos"], "v", "sum").select("grp", "pos", "sum")


@query
def delta_varint_bytes(d):
    u = codec.zigzag(F.col("step"))
    return delta_encode(d).groupBy("grp").agg(F.sum(codec.varint_length(u)).alias("n_bytes"), (F.count("*") * 2).alias("raw_bytes"))


@query
def packed_sizes(d):
    return codec.packed_sizes(d.series().where("v < 32768"), "grp", "pos", "v")


@query
def utf8_length(d):
    t = F.coalesce("text", F.lit(""))
    return d.table("documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), codec.utf8_length(t).alias("stored"))


@query
def crc32_text(d):
    return d.table("documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))


@query
def tag_dictionary(d):
    n = d.nodes()
    return stats.dictionary(n.select("id", *_node_tags(n)), "brand", "id")


@query
def zorder_sorted_nodes(d):
    return layout.spatially_sorted(d.nodes()).select("zpos", "id", "lat_code", "lon_code")


@query
def node_page_index(d):
    return layout.node_pages(d.nodes()).select("part", "page", "first_id", "n", F.crc32("data").alias("crc"))


@query
def value_histogram(d):
    return codec.histogram(d.series(), "v")


@query
def delta_histogram(d):
    return codec.histogram(delta_encode(d), "step")
