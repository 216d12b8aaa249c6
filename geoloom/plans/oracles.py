"""DuckDB equivalents of the queries; rows without one here are tested on their own."""

from __future__ import annotations

from geoloom.plans.fixtures import SQL


def _zorder(x: str, y: str) -> str:
    """x at even bits, y at odd ones, bit by bit."""
    bits = [f"((({x} >> {i}) & 1) << {2 * i}) + ((({y} >> {i}) & 1) << {2 * i + 1})" for i in range(31)]
    return "(" + " + ".join(bits) + f" + ((({x} >> 31) & 1) << 62))"


def _arc(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    cosine = f"sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2}) - radians({lon1}))"
    return f"acos(greatest(-1.0::double, least(1.0::double, {cosine}))) * 6378000.0::double"


def _metres(*places: str) -> str:
    return f"round({_arc(*places)}, 3)"


_VARINT = "case when {0} < 0 then 10 when {0} = 0 then 1 else (length(bin({0})) + 6) // 7 end::int"
_CROSSES = "p.pos_y > s.y1 and p.pos_y <= s.y2 and not (s.x1 > p.pos_x and s.x2 > p.pos_x) and ((2 * p.pos_y - 2 * s.y1 - 1) * (s.x2 - s.x1)) // (2 * s.y2 - 2 * s.y1) + s.x1 <= p.pos_x"
_DEGREES = ", deg as (select id, case when id % 50 = 0 then 0.0::double else lat_code / 1e7::double end as lat, lon_code / 1e7::double as lon from nodes)"
_FROM_DEGREES = _DEGREES + ", dp as (select id, lat, lon, case when lat * lon = 0 then 0 else trunc(lon * 1e7::double)::bigint + 1800000000 end as x, case when lat * lon = 0 then 0 else 900000000 - trunc(lat * 1e7::double)::bigint end as y from deg)"
_BLOB_COLUMNS = "pbf_ofs, blob_len, zlib_ofs, zlib_len, raw_size, scanned, node_count, min_node_id, max_node_id, way_count, min_way_id, max_way_id, relation_count, min_relation_id, max_relation_id"
_REQUESTS = ", asked(pos, req_id) as (values (0, 77::bigint), (1, 3), (2, 500), (3, 77), (4, 999999999))"
_REL_NODES = "select distinct m.rel_id, r.node_id as id from members m join way_refs r on r.way_id = m.ref where m.type = 1 union select rel_id, ref from members where type = 0"
_WAY_SEGMENTS = """, wsteps as (
  select r.way_id as path_id, r.pos, p.pos_x, p.pos_y, lag(p.pos_x) over w as px, lag(p.pos_y) over w as py from way_refs r join pos p on p.id = r.node_id window w as (partition by r.way_id order by r.pos)
), wsegments as (
  select path_id, pos, case when py <= pos_y then px else pos_x end as x1, least(py, pos_y) as y1, case when py <= pos_y then pos_x else px end as x2, greatest(py, pos_y) as y2 from wsteps where px is not null
)"""
_STEPS = ", d as (select grp, pos, v, v - lag(v, 1, 0::bigint) over (partition by grp order by pos) as step from series)"

_SELECTS = {
    "scan_nodes": "select id, lat_code, lon_code, name, brand, type from nodes",
    "scan_ways": "select w.id, w.status, count(r.node_id)::int as n_refs from ways w left join way_refs r on r.way_id = w.id group by all",
    "scan_relations": "select id, name, case when segment is null then 1 else 2 end::int as n_tags from relations",
    "explode_way_refs": "select way_id, pos, node_id from way_refs",
    "blob_index_by_entity": "select 'node' as entity, pbf_ofs, node_count as n from blobs where node_count > 0 union all select 'way', pbf_ofs, way_count from blobs where way_count > 0 union all select 'relation', pbf_ofs, relation_count from blobs where relation_count > 0",
    "blob_stats": "select b as block, n, lo as min_id, hi as max_id, case k when 0 then 'node' when 1 then 'way' else 'relation' end as entity from blocks",
    "entity_totals": "select sum(node_count)::bigint as nodes, sum(way_count)::bigint as ways, sum(relation_count)::bigint as relations from blobs",
    "byte_totals": "select sum(blob_len)::bigint as stored, sum(blob_len - zlib_len + raw_size)::bigint as inflated from blobs",
    "blob_tsv_roundtrip": f"select {_BLOB_COLUMNS} from blobs",
    "point_text_parse": "select event_id, (pos_x - 1800000000)::int as x, (900000000 - pos_y)::int as y from points",
    "dense_decode": "select id, lat_code, lon_code from nodes",
    "node_degrees": "select id, lat_code / 1e7::double as lat, lon_code / 1e7::double as lon from nodes",
    "search_relations_by_tag": "select id, name from relations where segment = 'BUILDING'",
    "tag_value_default": "select id, coalesce(segment, 'xx') as segment from relations",
    "members_by_type": "select rel_id, pos, ref from members where type = 1",
    "members_by_role": "select rel_id, pos, ref from members where role = 'outer'",
    "tagged_nodes": "select id, 3::int as n_tags from nodes where name is not null",
    "lookup_nodes": _REQUESTS + " select pos, req_id, id, lat_code, lon_code, name, brand, type from asked left join nodes on id = req_id",
    "lookup_ways": _REQUESTS + ", n as (select way_id, count(*) as n from way_refs group by way_id) select pos, req_id, id, status, case when id is not null then coalesce(n.n, 0) end as n_refs from asked left join ways on id = req_id left join n on n.way_id = id",
    "lookup_relations": ", asked(pos, req_id) as (values (0, 77::bigint), (1, 3), (2, 500), (3, 77), (4, 2000000001), (5, 999999999)) select pos, req_id, id, name from asked left join relations on id = req_id",
    "prune_blobs": _REQUESTS + " select distinct pbf_ofs, min_node_id, max_node_id from blobs join asked on req_id between min_node_id and max_node_id",
    "position_lookup": ", a as (select way_id, list(node_id order by pos) as ids from way_refs group by way_id) select w.id, case when ids is not null then list_position(ids, list_min(ids)) - 1 end::bigint as place, coalesce(list_position(ids, 77) - 1, -1)::bigint as place_77 from ways w left join a on a.way_id = w.id",
    "complete_way": "select distinct r.way_id, n.id, n.lat_code, n.lon_code from way_refs r join nodes n on n.id = r.node_id",
    "complete_relation_ways": "select distinct m.rel_id, w.id as way_id, w.status from members m join ways w on w.id = m.ref where m.type = 1",
    "complete_relation_nodes": f", x as ({_REL_NODES}) select x.rel_id, n.id, n.lat_code, n.lon_code from x join nodes n on n.id = x.id",
    "cache_misses": "select id from relations where id not in (select rel_id from members where type = 1 and role = 'inner')",
    "bundle_equality": f", x as ({_REL_NODES}), direct as (select x.rel_id, n.id, n.lat_code from x join nodes n on n.id = x.id), cw as (select distinct r.way_id, n.id, n.lat_code from way_refs r join nodes n on n.id = r.node_id), cached as (select distinct m.rel_id, cw.id, cw.lat_code from cw join members m on m.ref = cw.way_id and m.type = 1 union select m.rel_id, n.id, n.lat_code from members m join nodes n on n.id = m.ref where m.type = 0) select (select count(*) from (from direct except all from cached)) as n_left, (select count(*) from (from cached except all from direct)) as n_right",
    "expand_relations_once": "select distinct ref as id from members where type = 2 and rel_id >= 2000000000 and ref not in (select id from relations where id >= 2000000000)",
    "relation_closure": "select id as root, id, 0::int as depth from relations where id >= 2000000000 union all select rel_id, ref, 1 from members where type = 2 and rel_id >= 2000000000 union all select a.rel_id, b.ref, 2 from members a join members b on b.rel_id = a.ref and b.type = 2 where a.type = 2 and a.rel_id >= 2000000000",
    "region_vertices": """, walk as (
  select a.rel_id as root, c.role, r.node_id, lpad(a.pos::varchar, 10, '0') || '/' || lpad(b.pos::varchar, 10, '0') || '/' || lpad(c.pos::varchar, 10, '0') || '/' || lpad(r.pos::varchar, 10, '0') || '/' as place
  from members a join members b on b.rel_id = a.ref and b.type = 2 join members c on c.rel_id = b.ref and c.type = 1 join way_refs r on r.way_id = c.ref where a.type = 2 and a.rel_id >= 2000000000
), f as (select root, role, node_id, min(place) as place from walk group by all)
select * from f where role = 'outer' or (root, node_id) not in (select (root, node_id) from f where role = 'outer')""",
    "assert_cardinality": "select way_id as id, count(*) as n_refs from way_refs group by way_id",
    "distinct_sorted_ids": "select distinct node_id as id from way_refs",
    "way_endpoints": "select way_id as id, arg_min(node_id, pos) as first_node, arg_max(node_id, pos) as last_node, arg_max(node_id, pos) as first_reversed from way_refs group by way_id",
    "gps_from_degrees": _FROM_DEGREES + " select id, x as pos_x, y as pos_y from dp",
    "gps_from_node": "select id, pos_x, pos_y from pos",
    "gps_to_degrees": "select event_id, (900000000 - pos_y) / 1e7::double as lat, (pos_x - 1800000000) / 1e7::double as lon from points",
    "gps_rounded": "select event_id, round_even((900000000 - pos_y) / 1e7::double / 3, 7) as lat, round_even((pos_x - 1800000000) / 1e7::double / 3, 7) as lon from points",
    "gps_to_int64": _FROM_DEGREES + f" select id, {_zorder('x', 'y')}::bigint as code, case when lat * lon <> 0 then 0 else {_zorder('x', 'y')} end::bigint as legacy_code from dp",
    "zorder_encode": f"select event_id, {_zorder('pos_x', 'pos_y')}::bigint as z from points",
    "zorder_decode": ", z as (select event_id, (event_id + 1) * 2654435761 * 97 as z from points) select event_id, (" + " + ".join(f"(((z >> {2 * i}) & 1) << {i})" for i in range(32)) + ")::bigint as pos_x, (" + " + ".join(f"(((z >> {2 * i + 1}) & 1) << {i})" for i in range(31)) + ")::bigint as pos_y from z",
    "gps_distance": ", g as (select id, lat_code / 1e7::double as lat, lon_code / 1e7::double as lon from nodes) select a.id, " + _metres("a.lat", "a.lon", "b.lat", "b.lon") + " as metres from g a join g b on b.id = a.id + 1",
    "bounding_box": "select path_id, min(pos_x) as min_x, max(pos_x) as max_x, min(pos_y) as min_y, max(pos_y) as max_y from located group by path_id",
    "way_segments": _WAY_SEGMENTS + " select path_id, pos, x1, y1, x2, y2 from wsegments",
    "segments_sorted": "select path_id, (row_number() over (partition by path_id order by y1, pos))::int as place, y1, x1 from segments",
    "segment_bands": "select path_id, pos, unnest(range((y1 + 1) >> 22, (y2 >> 22) + 1)) as band from segments where y1 < y2",
    "max_lines_per_latitude": _WAY_SEGMENTS + ", c as (select y1, count(*) as n from wsegments group by y1) select max(n) as most, sum(n)::bigint as total from c",
    "point_in_polygon": f"select s.path_id, p.event_id from points p join segments s on {_CROSSES} group by s.path_id, p.event_id having count(*) % 2 = 1",
    "raster_fill": f""", box as (select min(pos_x) as x0, max(pos_x) as x9, min(pos_y) as y0, max(pos_y) as y9 from located
), p as (select i as pixel, x0 + floor((x9 - x0) * (i % 40)::double / 40)::bigint as pos_x, y0 + floor((y9 - y0) * (i // 40)::double / 40)::bigint as pos_y from range(1600) t(i), box
), f as (select s.path_id, p.pixel from p join segments s on {_CROSSES} group by all having count(*) % 2 = 1) select path_id, count(*) as filled from f group by path_id""",
    "pixel_project": f""", codes as (select event_id, pos_x - 1800000000 as x, 900000000 - pos_y as y from points
), box as (select min(x) as x0, max(x) as x9, min(y) as y0, max(y) as y9 from codes
), size as (select *, (y0 + (y9 - y0) // 2) / 1e7::double as m from box
), dist as (select *, {_arc("m", "x0 / 1e7::double", "m", "x9 / 1e7::double")} as across, {_arc("y0 / 1e7::double", "0.0::double", "y9 / 1e7::double", "0.0::double")} as upright from size
), scale as (select *, (trunc(780.0::double / upright * across)::bigint) / (x9 - x0)::double as sx, 780.0::double / (y9 - y0)::double as sy from dist
), g as (select event_id, x0, y0, sx, sy, trunc((x - x0) * sx)::bigint + 10 as c, 800 - trunc((y - y0) * sy)::bigint - 10 as r from codes, scale)
select event_id, c, r, trunc((c - 10) / sx)::bigint + x0 as back_x, trunc((800 - r - 10) / sy)::bigint + y0 as back_y from g""",
    "zigzag_grid": ", g as (select i % 8 as x, i // 8 as y from range(64) t(i)) select row_number() over (order by x + y, case when (x + y) % 2 = 0 then x else -x end) - 1 as place, x, y from g",
    "varint_length": "select o_orderkey, " + _VARINT.format("(o_orderkey * o_orderkey * 1000003)") + " as n, 10::int as n_negative from orders",
    "zigzag_encode": "select grp, pos, case when v < 5000 then -(v - 5000) * 2 - 1 else (v - 5000) * 2 end as u from series",
    "zigzag_decode": ", n as (select o_orderkey, o_orderkey * 3 + o_custkey as u from orders) select o_orderkey, case when u % 2 = 0 then u // 2 else -(u + 1) // 2 end as v from n",
    "delta_encode": _STEPS + " select grp, pos, step from d",
    "delta_decode": "select grp, pos, (sum(v) over (partition by grp order by pos))::bigint as sum from series",
    "delta_varint_bytes": _STEPS + ", z as (select grp, case when step < 0 then -step * 2 - 1 else step * 2 end as u from d) select grp, sum(" + _VARINT.format("u") + ")::bigint as n_bytes, count(*) * 2 as raw_bytes from z group by grp",
    "utf8_length": ", t as (select doc_id, strlen(coalesce(text, '')) as n from documents) select doc_id, n as n_bytes, n + " + _VARINT.format("n") + " as stored from t",
    "tag_dictionary": ", f as (select brand, min(id) as a from nodes where brand is not null group by brand) select brand, (row_number() over (order by a, brand) - 1)::int as code from f",
    "zorder_sorted_nodes": f"select {_zorder('pos_x', 'pos_y')}::bigint as zpos, id, lat_code, lon_code from pos join nodes using (id)",
    "value_histogram": "select v, count(*) as n from series group by v",
    "delta_histogram": _STEPS + " select step, count(*) as n from d group by step",
}
# through the source the same rows come out
for _name, _same in {"source_nodes": "scan_nodes", "source_ways": "scan_ways", "source_way_refs": "explode_way_refs", "source_relations": "scan_relations", "source_blob_stats": "blob_stats", "source_lookup_nodes": "lookup_nodes", "source_lookup_ways": "lookup_ways", "source_lookup_relations": "lookup_relations"}.items():
    _SELECTS[_name] = _SELECTS[_same]
_COUNTS = "'{ pbfOfs = ' || pbf_ofs || ', blobLen = ' || blob_len || ', rawSize = ' || raw_size || ', zlibOfs = ' || zlib_ofs || ', zlibLen = ' || zlib_len || ', nodeCount = ' || node_count || ', wayCount = ' || way_count || ', relationCount = ' || relation_count"
_SELECTS |= {
    "source_prune_blobs": _REQUESTS + " select distinct min_node_id, max_node_id from blobs join asked on req_id between min_node_id and max_node_id",
    "source_members": "select rel_id, (row_number() over (partition by rel_id order by pos) - 1)::int as place, type, ref, role from members",
    "blob_to_string": f"select pbf_ofs, {_COUNTS} || case when node_count > 0 then ', minNodeId = ' || min_node_id || ', maxNodeId = ' || max_node_id when way_count > 0 then ', minWayId = ' || min_way_id || ', maxWayId = ' || max_way_id else ', minRelationId = ' || min_relation_id || ', maxRelationId = ' || max_relation_id end || ' }}' as text from blobs",
    "member_to_string": "select rel_id, pos, type, case type when 0 then '{ type = Node, nodeId = ' when 1 then '{ type = Way, wayId = ' else '{ type = Relation, relationId = ' end || ref || ', role = ' || role || ' }' as text from members",
    "block_file_order": "select pbf_ofs, '../tmp/node_block_' || (pbf_ofs * 7919 % 10007) || '_' || node_count || '.dat' as name, pbf_ofs * 7919 % 10007 as number from blobs where node_count > 0",
    # each byte through the table of the reflected polynomial, which is itself worked out bit by bit
    "crc32_text": """, tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t from range(256) r(i)
), b as (select doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint) as v from documents)
select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, v), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint)::bigint as crc from b, tab""",
    "gps_to_string": _DEGREES + " select id, lat || ', ' || lon as text from deg",
}
for _name in ("gps_distance_pos", "gps_distance_z"):
    _SELECTS[_name] = ", g as (select id, (900000000 - pos_y) / 1e7::double as lat, (pos_x - 1800000000) / 1e7::double as lon from pos) select a.id, " + _metres("a.lat", "a.lon", "b.lat", "b.lon") + " as metres from g a join g b on b.id = a.id + 1"

ORACLES: dict[str, str] = {name: SQL + ("" if sql.lstrip().startswith(",") else "\n") + sql for name, sql in _SELECTS.items()}
