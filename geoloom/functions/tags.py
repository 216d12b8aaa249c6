"""Tag bags: arrays of (key, value) in file order, in which a key can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bag(**columns: Column) -> Column:
    """A bag of the given keys, leaving out null values."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in columns.items()))
    return F.filter(pairs, lambda t: t["value"].isNotNull())


def has(tags: Column, key: str, value: str) -> Column:
    return F.exists(tags, lambda t: (t["key"] == key) & (t["value"] == value))


def first(tags: Column, key: str, default: str | None = None) -> Column:
    """The first value of key, else the default."""
    found = F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]
    return found if default is None else F.coalesce(found, F.lit(default))


def as_map(tags: Column) -> Column:
    """A map in which the first value of a key wins."""
    own = F.filter(tags, lambda t, i: F.array_position(F.transform(tags, lambda u: u["key"]), t["key"]) == i + 1)
    return F.map_from_entries(own)


def rendered(**columns: Column) -> Column:
    """{ name = value, ... }; null as an empty text."""
    parts = [F.concat(F.lit(f"{k} = "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items()]
    return F.concat(F.lit("{ "), F.concat_ws(", ", *parts), F.lit(" }"))


def members_of(members: Column, kind: int) -> Column:
    return F.filter(members, lambda m: m["type"] == kind)
