"""Varints, many at a time."""

from __future__ import annotations

import numpy as np


def decode(data: np.ndarray, count: int | None = None) -> np.ndarray:
    """The base-128 numbers in data (uint8), as uint64; the first count of them if given."""
    ends = np.flatnonzero(data < 128)
    if count is not None:
        ends = ends[:count]
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    used = data[: ends[-1] + 1].astype(np.uint64)
    place = (np.arange(len(used)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64)
    return np.add.reduceat((used & np.uint64(127)) << (place * np.uint64(7)), starts)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return ((u >> np.uint64(1)) ^ (np.uint64(0) - (u & np.uint64(1)))).view(np.int64)


def zigzag_decode(data: np.ndarray, count: int | None = None) -> np.ndarray:
    return unzigzag(decode(data, count))


def delta_decode(data: np.ndarray) -> np.ndarray:
    """A packed list of zigzag steps, summed up; an empty list is an empty array."""
    return np.cumsum(zigzag_decode(data))


def encode(values) -> bytes:
    out = bytearray()
    for v in values:
        v = int(v) & (1 << 64) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def lengths(u: np.ndarray) -> np.ndarray:
    """Bytes of each of the numbers (uint64)."""
    return 1 + sum((u >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 10))


def encode_all(u: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The bytes (uint8) of numbers (uint64) one after another; sizes: their lengths(), where they are known."""
    sizes = lengths(u) if sizes is None else sizes
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left, last = ends - sizes, u, sizes - 1
    while len(at):
        out[at] = (left & np.uint64(127)).astype(np.uint8) | (last > 0).astype(np.uint8) << np.uint8(7)
        more = np.flatnonzero(last > 0)
        at, left, last = at[more] + 1, left[more] >> np.uint64(7), last[more] - 1
    return out


def zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def steps(v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Zigzag steps of lists of those sizes that lie one after another in v; each begins anew from 0."""
    out = np.diff(v, prepend=np.int64(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = v[first]
    return zigzag(out)


def zigzag_encode(values) -> bytes:
    return encode(int(v) << 1 ^ int(v) >> 63 for v in values)


def delta_encode(values) -> bytes:
    v = np.asarray(values, np.int64)
    return zigzag_encode(np.diff(v, prepend=0)) if len(v) else b""


def one(data, at: int) -> tuple[int, int]:
    """(value, next place) of the varint at a place."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data):
    """(number, value) of each field of a message: an int for varints, a memoryview for bytes, raw bytes for fixed sizes."""
    view, at = memoryview(data), 0
    while at < len(view):
        key, at = one(view, at)
        kind = key & 7
        if kind == 0:
            value, at = one(view, at)
        elif kind == 2:
            n, at = one(view, at)
            value, at = view[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = view[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(view):
            raise ValueError("a field runs past the end of its message")
        yield key >> 3, value


def signed(v: int) -> int:
    """A varint read as a 64-bit two's complement number."""
    return v - (1 << 64) if v >> 63 else v


def unzigzag_one(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def field(number: int, value: bytes | int) -> bytes:
    """One field: bytes with a length, or a varint."""
    if isinstance(value, int):
        return encode([number << 3, value])
    return encode([number << 3 | 2, len(value)]) + value
