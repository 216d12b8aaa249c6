"""Blobs and blocks: headers, inflating, statistics, and decoding into Arrow.

Message and field numbers follow the public OSM PBF format.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geoloom.sources.wire import varints
from geoloom.sources.wire.varints import fields, signed, unzigzag_one


class PbfParseError(ValueError):
    """A file that can't be read; offset is the blob's place."""

    def __init__(self, what: str, offset: int | None = None):
        super().__init__(what if offset is None else f"{what} (blob at {offset})")
        self.offset = offset


@dataclass(frozen=True)
class Blob:
    """Where a blob is: its header at pbf_ofs, blob_len bytes in all; data_ofs is the Blob message's place in it, None
    where only the header knows it."""

    pbf_ofs: int
    blob_len: int
    kind: str
    data_ofs: int | None


def blob_at(stream, at: int) -> Blob | None:
    """The blob whose header is at a place of a seekable stream; None at the end."""
    stream.seek(at)
    head = stream.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise PbfParseError("the file ends within a length", at)
    n = struct.unpack(">I", head)[0]
    if n > 64 << 10:
        raise PbfParseError(f"a blob header of {n} bytes", at)
    kind, size = "", 0
    for number, value in fields(stream.read(n)):
        if number == 1:
            kind = bytes(value).decode()
        elif number == 3:
            size = value
    if kind not in ("OSMHeader", "OSMData"):
        raise PbfParseError(f"a blob of type {kind!r}", at)
    return Blob(at, 4 + n + size, kind, 4 + n)


def walk(stream, at: int = 0) -> Iterator[Blob]:
    """The blobs of a seekable stream from a place on, by their headers alone."""
    while blob := blob_at(stream, at):
        yield blob
        at += blob.blob_len


def inflate(blob: bytes, offset: int | None = None) -> bytes:
    """The content of a Blob message: raw or zlib."""
    size, raw, packed = None, None, None
    try:
        for number, value in fields(blob):
            if number == 1:
                raw = bytes(value)
            elif number == 2:
                size = value
            elif number == 3:
                packed = bytes(value)
            elif number in (4, 5, 6, 7):
                raise PbfParseError(f"{ {4: 'lzma', 5: 'bzip2', 6: 'lz4', 7: 'zstd'}[number]} blobs are not supported", offset)
        if raw is None and packed is None:
            raise PbfParseError("a blob without data", offset)
        out = raw if raw is not None else zlib.decompress(packed)
    except (zlib.error, IndexError, ValueError) as e:
        raise e if isinstance(e, PbfParseError) else PbfParseError(str(e), offset) from e
    if raw is None and size is not None and len(out) != size:
        raise PbfParseError(f"{len(out)} bytes where {size} were announced", offset)
    return out


@dataclass
class Block:
    """A decoded PrimitiveBlock's frame; groups stay undecoded."""

    strings: list[str] = field(default_factory=list)
    granularity: int = 100
    date_granularity: int = 1000
    lat_offset: int = 0
    lon_offset: int = 0
    groups: list = field(default_factory=list)

    @classmethod
    def of(cls, data: bytes, strings: bool = True) -> Block:
        b = cls()
        for number, value in fields(data):
            if number == 1 and strings:
                b.strings = [bytes(s).decode() for n, s in fields(value) if n == 1]
            elif number == 2:
                b.groups.append(value)
            elif number == 17:
                b.granularity = value
            elif number == 18:
                b.date_granularity = value
            elif number == 19:
                b.lat_offset = signed(value)
            elif number == 20:
                b.lon_offset = signed(value)
        return b

    def codes(self, raw: np.ndarray, offset: int) -> np.ndarray:
        """Units of 1e-7 degrees from raw coordinates."""
        return ((offset + self.granularity * raw) // 100).astype(np.int32)


def _packed(value) -> np.ndarray:
    return np.frombuffer(value, np.uint8)


TAGS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
NODES = pa.schema([("id", pa.int64()), ("lat_code", pa.int32()), ("lon_code", pa.int32()), ("tags", TAGS)])
WAYS = pa.schema([("id", pa.int64()), ("tags", TAGS), ("node_ids", pa.list_(pa.int64()))])
RELATIONS = pa.schema([("id", pa.int64()), ("tags", TAGS), ("members", pa.list_(pa.struct([("id", pa.int64()), ("type", pa.int8()), ("role", pa.string())])))])

#: Metadata of an entity, in the order of the message's fields from 1 on; null where a file hasn't it.
INFO = pa.schema([("version", pa.int32()), ("timestamp_ms", pa.int64()), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string()), ("visible", pa.bool_())])


def _info(b: Block, n: int, columns: list) -> list[pa.Array]:
    """INFO's columns from the message's: n numbers each, or none at all."""
    out = []
    for f, values in zip(INFO, columns, strict=True):
        if values is None or not len(values):
            out.append(pa.nulls(n, f.type))
        elif len(values) != n:
            raise PbfParseError(f"{f.name} of {len(values)} entities for {n}")
        elif f.name == "user":
            out.append(pa.array(b.strings, pa.string()).take(pa.array(values, pa.int64())))
        elif f.name == "timestamp_ms":
            out.append(pc.multiply(pa.array(values, pa.int64()), b.date_granularity))
        else:
            out.append(pa.array(values, pa.int64()).cast(f.type))
    return out


def _dense_info(b: Block, n: int, message) -> list[pa.Array]:
    """Columns of a message whose version and visible are plain and whose other fields are steps."""
    part = {} if message is None else {k: v for k, v in fields(message)}
    read = {1: lambda x: varints.decode(x).view(np.int64), 6: lambda x: varints.decode(x).view(np.int64)}
    return _info(b, n, [read.get(k, varints.delta_decode)(_packed(part[k])) if k in part else None for k in range(1, 7)])


class _Infos:
    """Collects the metadata of entities that have a message of their own each."""

    def __init__(self, b: Block, wanted: bool):
        self.b, self.wanted, self.rows = b, wanted, []

    def add(self, part: dict) -> None:
        if self.wanted:
            self.rows.append({k: signed(v) for k, v in fields(part.get(4, b""))})

    def columns(self) -> list[pa.Array] | None:
        return _info(self.b, len(self.rows), [[r.get(k) for r in self.rows] for k in range(1, 7)]) if self.wanted else None


def _batch(schema: pa.Schema, columns: list, info: list | None) -> pa.RecordBatch:
    if info is None:
        return pa.RecordBatch.from_arrays(columns, schema=schema)
    return pa.RecordBatch.from_arrays([*columns, *info], schema=pa.schema([*schema, *INFO]))


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32))


def _joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _taken(strings: pa.Array, at: np.ndarray) -> pa.Array:
    """The strings with those numbers."""
    if len(at) and (at.min() < 0 or at.max() >= len(strings)):
        raise IndexError("a string that the block doesn't have")
    return strings.take(pa.array(at))


def _tag_lists(b: Block, keys: np.ndarray, values: np.ndarray, sizes) -> pa.Array:
    """A list of tags for each size, from the numbers of their keys and values one after another."""
    strings = pa.array(b.strings, pa.string())
    tags = pa.StructArray.from_arrays([_taken(strings, keys), _taken(strings, values)], fields=list(TAGS.value_type))
    return pa.ListArray.from_arrays(_offsets(sizes), tags, type=TAGS)


def _dense_tags(b: Block, n: int, flat: np.ndarray | None) -> pa.Array:
    """Keys and values in turn, each node's ended by a 0."""
    if flat is None or not len(flat):
        return _tag_lists(b, np.zeros(0, np.int64), np.zeros(0, np.int64), [0] * n)
    ends = np.flatnonzero(flat == 0)
    sizes = np.diff(ends, prepend=-1) - 1
    if not len(ends) or ends[-1] != len(flat) - 1 or (sizes % 2).any():  # a value may be string 0, which ends nothing
        ends, at = [], 0
        while at < len(flat):
            while flat[at]:
                at += 2
            ends.append(at)
            at += 1
        ends = np.array(ends)
        sizes = np.diff(ends, prepend=-1) - 1
    if len(sizes) != n:
        raise PbfParseError(f"tags of {len(sizes)} nodes for {n}")
    rest = np.delete(flat, ends)
    return _tag_lists(b, rest[0::2], rest[1::2], sizes // 2)


def _numbers_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varints at those places, and the places after them."""
    value, at, active = np.zeros(len(at), np.uint64), at.copy(), np.arange(len(at))
    for shift in range(0, 70, 7):
        byte = data[at[active]]
        value[active] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        at[active] += 1
        active = active[byte > 127]
        if not len(active):
            return value, at
    raise ValueError("a number of more than ten bytes")


def _places(group: bytes, number: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Where the messages of a group begin and end; None if they are not all of that number."""
    key, at, size, out = number << 3 | 2, 0, len(group), []
    while at < size:
        if group[at] != key or at + 1 >= size:
            return None
        n = group[at + 1]
        if n < 128:
            at += 2
        else:
            n, at = varints.one(group, at + 1)
        out += (at, at + n)
        at += n
    if at > size:
        return None
    out = np.array(out, np.int64)
    return out[0::2], out[1::2]


def _columns(group, number: int, packed: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]] | None:
    """Ids, and sizes and values of packed fields, of all messages of a group at once.

    None where the group holds anything out of the ordinary; it is then read a message at a time, which finds what
    is wrong with it, if anything is.
    """
    group = bytes(group)
    try:
        if (places := _places(group, number)) is None:
            return None
        start, end = places
        data = np.frombuffer(group + bytes(20), np.uint8)
        ids, seen = np.zeros(len(start), np.uint64), np.zeros(len(start), bool)
        found = {k: (np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)) for k in packed}
        at, active = start.copy(), np.flatnonzero(start < end)
        while len(active):
            key, after = _numbers_at(data, at[active])
            value, after = _numbers_at(data, after)
            kind, field_ = key & np.uint64(7), (key >> np.uint64(3))
            if ((kind != 0) & (kind != 2)).any() or (value[kind == 2] > len(group)).any():
                return None
            size = np.where(kind == 2, value, 0).astype(np.int64)
            if (after + size > end[active]).any() or ((field_ == 1) & (kind == 2)).any():
                return None
            own = field_ == 1
            ids[active[own]], seen[active[own]] = value[own], True
            for k, (ofs, length) in found.items():
                own = field_ == k
                if (kind[own] == 0).any():
                    return None
                ofs[active[own]], length[active[own]] = after[own], size[own]
            at[active] = after + size
            active = active[at[active] < end[active]]
    except (ValueError, IndexError):
        return None
    if not seen.all():
        return None
    out = {}
    for k, (ofs, length) in found.items():
        ends = np.cumsum(length)
        own = data[np.repeat(ofs - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], np.cumsum(own < 128)])
        if len(own) and (own[ends[length > 0] - 1] > 127).any():
            return None
        out[k] = stops[ends] - stops[ends - length], varints.decode(own)
    return ids.view(np.int64), out


def _summed(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Steps of lists of those sizes, summed up in each."""
    total = np.concatenate([[0], np.cumsum(varints.unzigzag(values))])
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def _tags_at_once(b: Block, n: int, keys: tuple, values: tuple, wanted: bool) -> pa.Array:
    if (keys[0] != values[0]).any():
        raise PbfParseError("keys and values of unlike length")
    none = np.zeros(0, np.uint64)
    return _tag_lists(b, keys[1], values[1], keys[0]) if wanted else _tag_lists(b, none, none, np.zeros(n, np.int64))


def nodes(b: Block, tags: bool = True, metadata: bool = False) -> Iterator[pa.RecordBatch]:
    for group in b.groups:
        single, pairs, infos = ([], [], []), _Pairs(b, tags), _Infos(b, metadata)
        for number, value in fields(group):
            if number == 2:
                part = {n: v for n, v in fields(value)}
                ids = varints.delta_decode(_packed(part.get(1, b"")))
                lat, lon = (varints.delta_decode(_packed(part.get(k, b""))) for k in (8, 9))
                if not len(ids) == len(lat) == len(lon):
                    raise PbfParseError("dense columns of unlike length")
                flat = varints.decode(_packed(part[10])).astype(np.int64) if tags and 10 in part else None
                info = _dense_info(b, len(ids), part.get(5)) if metadata else None
                yield _batch(NODES, [pa.array(ids), pa.array(b.codes(lat, b.lat_offset)), pa.array(b.codes(lon, b.lon_offset)), _dense_tags(b, len(ids), flat)], info)
            elif number == 1:
                part = {n: v for n, v in fields(value)}
                for column, k in zip(single, (1, 8, 9), strict=True):
                    column.append(unzigzag_one(part[k]))
                pairs.add(part)
                infos.add(part)
        if single[0]:
            lat, lon = (b.codes(np.array(x, np.int64), o) for x, o in ((single[1], b.lat_offset), (single[2], b.lon_offset)))
            yield _batch(NODES, [pa.array(single[0], pa.int64()), pa.array(lat), pa.array(lon), pairs.lists()], infos.columns())


class _Pairs:
    """Collects the numbers of the keys and values of entities."""

    def __init__(self, b: Block, wanted: bool):
        self.b, self.wanted, self.keys, self.values, self.sizes = b, wanted, [], [], []

    def add(self, part: dict) -> None:
        keys, values = (varints.decode(_packed(part.get(k, b""))) for k in (2, 3))
        if len(keys) != len(values):
            raise PbfParseError("keys and values of unlike length")
        if self.wanted:
            self.keys.append(keys)
            self.values.append(values)
        self.sizes.append(len(keys) if self.wanted else 0)

    def lists(self) -> pa.Array:
        return _tag_lists(self.b, _joined(self.keys), _joined(self.values), self.sizes)


def ways(b: Block, tags: bool = True, metadata: bool = False) -> Iterator[pa.RecordBatch]:
    for group in b.groups:
        if not metadata and (found := _columns(group, 3, (2, 3, 8))):
            own, part = found
            lists = pa.ListArray.from_arrays(_offsets(part[8][0]), pa.array(_summed(*part[8])))
            yield _batch(WAYS, [pa.array(own), _tags_at_once(b, len(own), part[2], part[3], tags), lists], None)
            continue
        ids, refs, pairs, infos = [], [], _Pairs(b, tags), _Infos(b, metadata)
        for number, value in fields(group):
            if number == 3:
                part = {n: v for n, v in fields(value)}
                ids.append(signed(part[1]))
                pairs.add(part)
                infos.add(part)
                refs.append(varints.delta_decode(_packed(part.get(8, b""))))
        if ids:
            lists = pa.ListArray.from_arrays(_offsets([len(r) for r in refs]), pa.array(_joined(refs)))
            yield _batch(WAYS, [pa.array(ids, pa.int64()), pairs.lists(), lists], infos.columns())


def relations(b: Block, tags: bool = True, metadata: bool = False) -> Iterator[pa.RecordBatch]:
    strings, kind = None, RELATIONS.field("members").type
    for group in b.groups:
        if not metadata and (found := _columns(group, 4, (2, 3, 8, 9, 10))):
            own, part = found
            sizes = part[8][0]
            if any((part[k][0] != sizes).any() for k in (9, 10)):
                raise PbfParseError("member columns of unlike length")
            strings = pa.array(b.strings, pa.string()) if strings is None else strings
            members = pa.StructArray.from_arrays([pa.array(_summed(*part[9])), pa.array(part[10][1].astype(np.int8)), _taken(strings, part[8][1].astype(np.int64))], fields=list(kind.value_type))
            yield _batch(RELATIONS, [pa.array(own), _tags_at_once(b, len(own), part[2], part[3], tags), pa.ListArray.from_arrays(_offsets(sizes), members, type=kind)], None)
            continue
        own, ids, kinds, roles, pairs, infos = [], [], [], [], _Pairs(b, tags), _Infos(b, metadata)
        for number, value in fields(group):
            if number == 4:
                part = {n: v for n, v in fields(value)}
                columns = [varints.decode(_packed(part.get(k, b""))) for k in (8, 10)] + [varints.delta_decode(_packed(part.get(9, b"")))]
                if len({len(c) for c in columns}) > 1:
                    raise PbfParseError("member columns of unlike length")
                own.append(signed(part[1]))
                pairs.add(part)
                infos.add(part)
                for held, c in zip((roles, kinds, ids), columns, strict=True):
                    held.append(c)
        if own:
            strings = pa.array(b.strings, pa.string()) if strings is None else strings
            members = pa.StructArray.from_arrays([pa.array(_joined(ids)), pa.array(_joined(kinds, np.int8)), _taken(strings, _joined(roles))], fields=list(kind.value_type))
            yield _batch(RELATIONS, [pa.array(own, pa.int64()), pairs.lists(), pa.ListArray.from_arrays(_offsets([len(r) for r in ids]), members, type=kind)], infos.columns())


def statistics(data: bytes) -> dict[str, tuple[int, int | None, int | None]]:
    """Count, smallest and largest id of nodes, ways and relations of a block; strings aren't read."""
    ids = {"node": [], "way": [], "relation": []}
    for group in Block.of(data, strings=False).groups:
        alike = {26: 3, 34: 4}.get(group[0]) if len(group) else None
        if alike and (found := _columns(group, alike)):
            ids["way" if alike == 3 else "relation"].append(found[0])
            continue
        for number, value in fields(group):
            if number == 2:
                packed = next((v for n, v in fields(value) if n == 1), b"")
                ids["node"].append(varints.delta_decode(_packed(packed)))
            elif number in (1, 3, 4):
                own = next(v for n, v in fields(value) if n == 1)
                ids[{1: "node", 3: "way", 4: "relation"}[number]].append(np.array([unzigzag_one(own) if number == 1 else signed(own)], np.int64))
    out = {}
    for kind, parts in ids.items():
        every = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        out[kind] = (len(every), int(every.min()), int(every.max())) if len(every) else (0, None, None)
    return out


def header(data: bytes) -> dict:
    out = {"left": None, "right": None, "top": None, "bottom": None, "required_features": [], "optional_features": [], "writingprogram": None, "source": None, "replication_timestamp": None, "replication_seq": None, "replication_url": None}
    names = {16: "writingprogram", 17: "source", 32: "replication_timestamp", 33: "replication_seq", 34: "replication_url"}
    for number, value in fields(data):
        if number == 1:
            out |= {{1: "left", 2: "right", 3: "top", 4: "bottom"}[n]: unzigzag_one(v) for n, v in fields(value)}
        elif number in (4, 5):
            out["required_features" if number == 4 else "optional_features"].append(bytes(value).decode())
        elif number in names:
            out[names[number]] = signed(value) if isinstance(value, int) else bytes(value).decode()
    return out
