from geoloom.sources import cache


def test_ways_relations_and_members_round_trip():
    tags = [{"key": "k", "value": "ü"}, {"key": "", "value": ""}]
    for ids in ([], [5], [2**40, -3, 7, 7]):
        way = {"id": -9, "node_ids": ids, "tags": tags}
        assert cache.decode_way(cache.encode_way(way)) == way
    members = [{"type": 0, "id": 2**50, "role": ""}, {"type": 2, "id": -1, "role": "outer ö"}]
    assert [cache.decode_member(cache.encode_member(m)) for m in members] == members
    for some in (members, []):
        relation = {"id": 300, "members": some, "tags": tags[:1]}
        assert cache.decode_relation(cache.encode_relation(relation)) == relation
