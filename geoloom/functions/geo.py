"""Fixed-point positions, Morton codes and distances as Column expressions.

A position is pos_x = lon * 1e7 + 1.8e9 (0 to 3.6e9) and pos_y = 9e8 - lat * 1e7 (0 to 1.8e9), both long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offsets of the fixed-point grid, its units a degree, and the Earth's radius in metres.
X_ZERO, Y_ZERO, UNITS, RADIUS = 1_800_000_000, 900_000_000, 1e7, 6_378_000.0

_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def from_degrees(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(pos_x, pos_y); a point on the equator or the prime meridian becomes (0, 0)."""
    zero = lat * lon == 0
    x, y = (lon * UNITS).cast("long") + X_ZERO, Y_ZERO - (lat * UNITS).cast("long")
    return F.when(zero, F.lit(0).cast("long")).otherwise(x), F.when(zero, F.lit(0).cast("long")).otherwise(y)


def from_node(lat_code: Column, lon_code: Column) -> tuple[Column, Column]:
    return lon_code.cast("long") + X_ZERO, Y_ZERO - lat_code.cast("long")


def to_degrees(pos_x: Column, pos_y: Column) -> tuple[Column, Column]:
    """(lat, lon)."""
    return (Y_ZERO - pos_y) / F.lit(UNITS), (pos_x - X_ZERO) / F.lit(UNITS)


def _spread(v: Column) -> Column:
    """Bits 0 to 31 of v at the even places."""
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0xFFFFFFFF], strict=True):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
    return v


def zorder(pos_x: Column, pos_y: Column) -> Column:
    """Morton code: x at the even bits, y at the odd ones."""
    return _spread(pos_x).bitwiseOR(F.shiftleft(_spread(pos_y), 1))


def from_zorder(z: Column) -> tuple[Column, Column]:
    return _gather(z), _gather(F.shiftrightunsigned(z, 1))


def to_int64(lat: Column, lon: Column, legacy: bool = False) -> Column:
    """Morton code of degrees.  legacy: 0 for every point off the equator and the prime meridian, as once published."""
    code = zorder(*from_degrees(lat, lon))
    return F.when(lat * lon != 0, F.lit(0).cast("long")).otherwise(code) if legacy else code


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees, by the spherical law of cosines."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * RADIUS


def distance_pos(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return distance(*to_degrees(x1, y1), *to_degrees(x2, y2))


def distance_zorder(z1: Column, z2: Column) -> Column:
    return distance_pos(*from_zorder(z1), *from_zorder(z2))


def rounded(x: Column) -> Column:
    """Seven places, ties to even."""
    return F.bround(x, 7)


def text(lat: Column, lon: Column) -> Column:
    return F.concat_ws(", ", lat.cast("string"), lon.cast("string"))


def crossing(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where an edge with y1 < y <= y2 meets the row y; whole numbers, no rounding, between x1 and x2 and monotone in y.

    World-sized edges overflow a long, so the product is a decimal where it could.
    """
    wide = (F.lit(2) * y - F.lit(2) * y1 - 1).cast("decimal(19,0)") * (x2 - x1).cast("decimal(19,0)")
    small = (F.lit(2) * y - F.lit(2) * y1 - 1) * (x2 - x1)
    fits = F.abs(x2 - x1) < 1_000_000_000
    step = F.when(fits, F.call_function("div", F.when(fits, small).otherwise(F.lit(0).cast("long")), F.lit(2) * y2 - F.lit(2) * y1)).otherwise(
        F.call_function("div", wide, (F.lit(2) * y2 - F.lit(2) * y1).cast("decimal(19,0)"))
    )
    return step + x1


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the half line from (x, y) to the left crosses an edge with y1 <= y2."""
    inside = (y > y1) & (y <= y2)
    return F.when(~inside | ((x1 > x) & (x2 > x)), F.lit(False)).otherwise(crossing(y, x1, y1, x2, y2) <= x)
