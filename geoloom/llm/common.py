"""What the operators of this subpackage share: skew-safe joins, words, seeded hashes, and the core's scratch tables.

Results are lazy and read scratch tables in the shared folder until they are written or read; geoloom.scratch.clear_scratch()
then removes all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.scratch import drop_path, drop_scratch, materialize, scratch_path  # noqa: F401

#: A key is hot when it has at least this share of all rows: no more than 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 1000
#: Keys with fewer rows than this are never hot.
HOT_LEAST = 1000
#: Texts are cut into blocks of about so many bytes before they become word lists.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left LEFT JOIN right on key; right has one row a key and, in weight, how many rows of left have it.

    Keys with at least HOT_SHARE of all rows are joined by broadcast (at most 1 / HOT_SHARE rows, whatever the
    size of the input), the others by shuffle, so that no task gets the rows of a hot key.  Both sides are read
    twice and should be stored tables.  Null keys match nothing.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = right.where(F.col(weight) >= least).drop(weight)
    cold = right.where(F.col(weight) < least).drop(weight)
    keys = hot.select(key).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(keys), key, "left")
    first = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, "left")
    rest = marked.where("_hot is null").drop("_hot").join(cold, key, "left")
    return first.unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left JOIN right on key; right has one row a key, of any width.

    The rows of a key with HOT_SHARE of all rows of left or more are dealt by a hash of the column `by` over as many
    parts as it has such shares, and its row of right is sent to each.  Only hot keys and their numbers of parts are
    broadcast: at most 1 / HOT_SHARE rows, whatever the size of the input.  left is read three times and should be a
    stored table.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    share = max(HOT_LEAST, int(left.count() * HOT_SHARE))
    hot = F.broadcast(counts.where(F.col("_n") >= share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of data, split at the six ASCII white-space characters, a block of about BLOCK_BYTES at a time."""
    if len(data) <= BLOCK_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + BLOCK_BYTES)
        to = cut.start() if cut else len(data)
        yield data[at:to].split()
        at = to


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of data."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in word_blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for x in column:
        yield b"" if (b := x.as_buffer() if hasattr(x, "as_buffer") else None) is None else b.to_pybytes()


def veiled(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but those used under names that no operator has, and the new name of every column.

    So no column of the caller's meets one of an operator's own.
    """
    names = {c: c if c.lower() in used else f"_of_the_input_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def unveiled(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns that veiled() renamed under their own names, but for those also in more, then the columns in more."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items() if c.lower() not in more), *more)


def scan_partitions(df: DataFrame) -> int:
    """How many tasks scan df: a measure of its size that needs no job."""
    return max(1, df.rdd.getNumPartitions())
