"""Writes map files: entities one at a time, for tests and samples, and whole columns of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from geoloom.sources.wire import varints
from geoloom.sources.wire.varints import field


class Strings:
    def __init__(self):
        self.ids: dict[str, int] = {"": 0}

    def __call__(self, s: str) -> int:
        return self.ids.setdefault(s, len(self.ids))

    def message(self) -> bytes:
        return b"".join(field(1, s.encode()) for s in self.ids)


def _tags(s: Strings, tags) -> bytes:
    if not tags:
        return b""
    return field(2, varints.encode(s(k) for k, _ in tags)) + field(3, varints.encode(s(v) for _, v in tags))


def dense(s: Strings, nodes: list[tuple], tags: bool = True) -> bytes:
    """A group of dense nodes: (id, lat, lon, [(key, value)])."""
    flat: list[int] = []
    for _, _, _, t in nodes:
        for k, v in t:
            flat += [s(k), s(v)]
        flat.append(0)
    body = b"".join(field(n, varints.delta_encode([x[i] for x in nodes])) for n, i in ((1, 0), (8, 1), (9, 2)))
    return field(2, body + (field(10, varints.encode(flat)) if tags else b""))


def sparse(s: Strings, nodes: list[tuple]) -> bytes:
    zig = lambda n, v: varints.encode([n << 3, v << 1 ^ v >> 63])
    return b"".join(field(1, zig(1, i) + _tags(s, t) + zig(8, lat) + zig(9, lon)) for i, lat, lon, t in nodes)


def ways(s: Strings, rows: list[tuple]) -> bytes:
    """(id, tags, node ids); an empty list of nodes is written as an empty field."""
    return b"".join(field(3, varints.encode([1 << 3, i]) + _tags(s, t) + field(8, varints.delta_encode(refs))) for i, t, refs in rows)


def relations(s: Strings, rows: list[tuple]) -> bytes:
    """(id, tags, [(ref, type, role)])."""
    out = b""
    for i, t, members in rows:
        body = varints.encode([1 << 3, i]) + _tags(s, t)
        if members:
            body += field(8, varints.encode(s(r) for _, _, r in members)) + field(9, varints.delta_encode([m for m, _, _ in members])) + field(10, varints.encode(k for _, k, _ in members))
        out += field(4, body)
    return out


def block(s: Strings, groups: Iterable[bytes], extra: bytes = b"") -> bytes:
    groups = list(groups)
    return field(1, s.message()) + b"".join(field(2, g) for g in groups) + extra


def blob(kind: str, data: bytes, raw: bool = False, body: bytes | None = None) -> bytes:
    if body is None:
        body = field(1, data) if raw else field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind.encode()) + varints.encode([3 << 3, len(body)])
    return struct.pack(">I", len(head)) + head + body


def header(box=(60_000_000_00, 150_000_000_00, 550_000_000_00, 470_000_000_00), features=("OsmSchema-V0.6", "DenseNodes")) -> bytes:
    zig = lambda n, v: varints.encode([n << 3, v << 1 ^ v >> 63])
    body = field(1, b"".join(zig(n, v) for n, v in enumerate(box, 1))) + b"".join(field(4, f.encode()) for f in features) + field(16, b"geoloom")
    return blob("OSMHeader", body)


#: Numbers that a blob holds at most, unless one entity has more: a blob is far from the format's 32 MB then.
BLOB_NUMBERS = 1_000_000


def _messages(number: int, heads: np.ndarray | None, lists: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Messages of a field's number one after another, and where each ends.

    Each has its head (an id, field 1), if heads are given, and packed lists (number, sizes, values, whether an empty
    one is written too).  All that such messages are made of are varints, so that they are laid out and coded at once.
    """
    n = len(lists[0][1])
    coded, body, count = [], np.zeros(n, np.int64), np.full(n, 2 if heads is None else 4)
    if heads is not None:
        body += 1 + varints.lengths(heads)
    for key, sizes, values, empty in lists:
        own = np.concatenate([[0], np.cumsum(varints.lengths(values))])
        ends = np.cumsum(sizes)
        packed = own[ends] - own[ends - sizes]
        written = (sizes > 0) | empty
        coded.append((key, sizes, values, written, packed))
        body += np.where(written, 1 + varints.lengths(packed.astype(np.uint64)) + packed, 0)
        count += np.where(written, 2 + sizes, 0)
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    out[at], out[at + 1] = number << 3 | 2, body
    at += 2
    if heads is not None:
        out[at], out[at + 1] = 1 << 3, heads
        at += 2
    for key, sizes, values, written, packed in coded:
        out[at[written]], out[at[written] + 1] = key << 3 | 2, packed[written]
        at = at + 2 * written
        out[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))] = values
        at = at + sizes
    return varints.encode_all(out), np.cumsum(1 + varints.lengths(body.astype(np.uint64)) + body)


def _list(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes of a column's lists and their values; a null is an empty list."""
    return np.asarray(column.value_lengths().fill_null(0)).astype(np.int64), column.flatten()


def _whole(column: pa.Array, kind=np.int64) -> np.ndarray:
    return np.asarray(column).astype(kind)


class _Table:
    """The strings that many blocks use, each block's numbered on their own from 1 on; string 0 is the empty one."""

    def __init__(self, strings: list[pa.Array], blocks: list[np.ndarray]):
        every = pa.concat_arrays([s.cast(pa.string()) for s in strings]).dictionary_encode()
        self.framed = [field(1, s.encode()) for s in every.dictionary.to_pylist()]
        codes, width = _whole(every.indices), max(1, len(self.framed))
        used, inverse = np.unique(np.concatenate(blocks) * width + codes, return_inverse=True)
        self.block, self.code = used // width, used % width
        place = np.arange(len(used)) - np.searchsorted(self.block, self.block) + 1
        parts = np.cumsum([len(s) for s in strings])[:-1]
        self.numbers = np.split(place[inverse].astype(np.uint64), parts)

    def message(self, block: int) -> bytes:
        low, high = np.searchsorted(self.block, [block, block + 1])
        return field(1, b"") + b"".join(map(self.framed.__getitem__, self.code[low:high].tolist()))


def blobs(kind: int, rows: pa.Table, bounds: np.ndarray) -> Iterator[bytes]:
    """A blob of the rows between each bound and the next; kind is 0 for nodes, 1 for ways, 2 for relations."""
    rows = rows.combine_chunks()
    column = lambda c: rows[c].chunk(0) if rows[c].num_chunks else pa.array([], rows[c].type)
    n, ids = np.diff(bounds), _whole(column("id"))
    row_block = np.repeat(np.arange(len(n)), n)
    tag_sizes, tags = _list(column("tags"))
    tag_block = np.repeat(row_block, tag_sizes)
    keys, values = tags.field("key"), tags.field("value")
    if kind == 2:
        sizes, members = _list(column("members"))
        table = _Table([keys, values, members.field("role")], [tag_block, tag_block, np.repeat(row_block, sizes)])
    else:
        table = _Table([keys, values], [tag_block, tag_block])
    k, v = table.numbers[:2]
    if kind == 0:
        # keys and values in turn, each node's ended by a 0
        flat = np.zeros(2 * len(k) + len(ids), np.uint64)
        shift = 2 * np.arange(len(k)) + np.repeat(np.arange(len(ids)), tag_sizes)
        flat[shift], flat[shift + 1] = k, v
        per = np.add.reduceat(2 * tag_sizes + 1, bounds[:-1])
        lists = [(1, n, varints.steps(ids, n), True)] + [(c, n, varints.steps(_whole(column(name)), n), True) for c, name in ((8, "lat_code"), (9, "lon_code"))]
        data, ends = _messages(2, None, [*lists, (10, per, flat, True)])
        ends = ends[np.arange(len(n))]
    else:
        lists = [(2, tag_sizes, k, False), (3, tag_sizes, v, False)]
        if kind == 1:
            sizes, refs = _list(column("node_ids"))
            lists.append((8, sizes, varints.steps(_whole(refs), sizes), True))
        else:
            lists += [(8, sizes, table.numbers[2], False), (9, sizes, varints.steps(_whole(members.field("id")), sizes), False), (10, sizes, _whole(members.field("type"), np.uint64), False)]
        data, ends = _messages(kind + 2, ids.view(np.uint64), lists)
        ends = ends[bounds[1:] - 1]
    at = 0
    for i, end in enumerate(ends.tolist()):
        yield blob("OSMData", field(1, table.message(i)) + field(2, data[at:end].tobytes()))
        at = end
