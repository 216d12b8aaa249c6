"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased; keys of `least` code points
or more count.  Documents are taken in batches of ascending doc_id.  Each batch merge-anti-joins the hashes of its
keys with the runs: a key that a run has belongs to an earlier document; of the others the smallest doc_id of the
batch becomes the owner, and they form a new run.  Runs are bucketed and sorted by hash, so that only the batch
is shuffled; FANOUT runs of one level are merged into one run of the next.  Hashes have 128 bits.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import drop_path, drop_scratch, join_unique, materialize, scan_partitions, scratch_path, texts_of, unveiled, veiled

#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Batches of documents at least, and line hashes of a batch at most.
BATCHES, BATCH_LINES = 4, 1_000_000_000
_STRIP = b" \t\n\x0b\x0c\r"
#: Bytes that continue a UTF-8 character: no code point begins with them.
_CONTINUES = bytes(range(0x80, 0xC0))


def keys_of(lines: list[bytes], least: int) -> Iterator[bytes | None]:
    """The hash of each line's key; None where the key is too short."""
    for line in lines:
        key = line.strip(_STRIP).lower()
        yield xxhash.xxh3_128_digest(key) if len(key) >= least and len(key.translate(None, _CONTINUES)) >= least else None


class Runs:
    """Levelled sorted runs of 16-byte hashes, kept in the shared folder.

    Only tables of a catalog can be bucketed, so runs are named in the session's own until drop().
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.levels = spark, buckets, []

    def _write(self, hashes: DataFrame, level: int) -> None:
        name, path = f"spark_catalog.default.line_run_{uuid.uuid4().hex}", scratch_path(self.spark, f"line-run-{level}")
        dealt = hashes.select("h").repartition(self.buckets, "h")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))  # first, so that drop() finds it whatever happens
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)

    def all(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, hashes: DataFrame) -> None:
        """hashes: distinct and in no run."""
        self._write(hashes, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= FANOUT:
            old = self.levels[level]
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._write(merged, level + 1)
            self.levels[level] = []
            self._drop(old)
            level += 1

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"drop table if exists {name}")
            drop_path(self.spark, path)

    def drop(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def repeated_lines(docs: DataFrame, least: int = 10, batches: int | None = None) -> DataFrame:
    """_key, gone: for each document that loses lines its doc_id and their hashes.

    batches: BATCHES, or as many as leave each BATCH_LINES hashes.
    """
    spark = docs.sparkSession

    def hashes(parts):
        for batch in parts:
            ids, found = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = set(keys_of(data.split(b"\n"), least)) - {None}
                ids += [doc_id] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["k", "h"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("k"), "text").mapInArrow(hashes, "k long, h binary")
    rows = materialize(rows, "line-hashes")
    batches = batches or max(BATCHES, math.ceil(rows.count() / BATCH_LINES))
    edges = rows.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    lows = [None, *sorted(set(edges))]
    runs = Runs(spark, max(4, min(20_000, 2 * scan_partitions(rows))))
    losses = []
    try:
        for i, low in enumerate(lows):
            batch = rows if low is None else rows.where(F.col("k") > low)
            batch = batch.where(F.col("k") <= lows[i + 1]) if i + 1 < len(lows) else batch
            own = batch.groupBy("h").agg(F.min("k").alias("owner"), F.count("*").alias("w")).withColumn("seen", F.lit(False))
            for run in runs.all():
                own = own.join(run.withColumn("_found", F.lit(True)), "h", "left").withColumn("seen", F.col("seen") | F.col("_found").isNotNull()).drop("_found")
            own = materialize(own, "line-owners")
            lost = join_unique(batch, own, "h", "w").where("seen or k > owner").select("k", "h")
            losses.append(materialize(lost, "line-lost"))
            if i + 1 < len(lows):
                runs.add(own.where("not seen"))
            drop_scratch(own)
    finally:
        runs.drop()
    drop_scratch(rows)
    gone = losses[0]
    for lost in losses[1:]:
        gone = gone.unionByName(lost)
    # a pair of a document and a line is found in the batch of the document alone
    gone = materialize(gone.distinct().groupBy(F.col("k").alias("_key")).agg(F.collect_list("h").alias("gone")), "lines-gone")
    drop_scratch(*losses)
    return gone


def dedup_lines(docs: DataFrame, least: int = 10, batches: int | None = None) -> DataFrame:
    """docs without the lines that a document of smaller doc_id has, with _n_lines and _n_dropped added.

    docs: doc_id, text and any other columns, all kept (`_n_lines` and `_n_dropped` are replaced).
    Texts are split at \\n; null and empty texts are one empty line and become empty.  Keys shorter than `least`
    code points stay.  Within its owner a key keeps all its lines.  Rows that repeat a doc_id count as one
    document; rows with a null doc_id own no line and lose none.
    """
    docs, names = veiled(docs.drop("_n_lines", "_n_dropped"), "doc_id", "text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    lost = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, batches)
    # rows without a doc_id match nothing; the salt spreads them over the tasks
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    keyed = docs.withColumns({"_key": F.col("doc_id").cast("long"), "_salt": salt})
    joined = keyed.join(lost.withColumn("_salt", F.lit(0).cast("long")), ["_key", "_salt"], "left").drop("_key", "_salt")
    fields = [f for f in joined.schema.fields if f.name != "gone"]
    schema = docs.select([f.name for f in fields]).schema.add("_n_lines", "long").add("_n_dropped", "long")

    def cut(parts):
        for batch in parts:
            texts, n, m = [], [], []
            for data, gone in zip(texts_of(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                lines = data.split(b"\n")
                n.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [x for x, h in zip(lines, keys_of(lines, least), strict=True) if h not in gone]
                m.append(n[-1] - len(lines))
                texts.append(b"\n".join(lines).decode())
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(m, pa.int64())], [*(f.name for f in fields), "_n_lines", "_n_dropped"])

    return unveiled(joined.mapInArrow(cut, schema), names, "_n_lines", "_n_dropped")
