"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import drop_scratch, join_salted, materialize, unveiled, veiled

#: A document's place in its source is a hash of 48 bits, read 12 bits a level.
LEVELS, LEVEL_BITS = 4, 12
#: Per-source tables of up to so many rows are broadcast and fit one task; with more sources the joins shuffle and targets
#: are found by ranges of sources.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """48 bits that depend on the document alone."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 12), 16, 10).cast("long")


def _running(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], small: bool, scratch: list[DataFrame]) -> DataFrame:
    """rows (in an order without ties) with, for each of sums, its total over all rows before.

    Few rows go through one window.  Many are dealt by ranges of the order, each range is summed, and a row takes the sums
    of the ranges before its own (a row a range) and of its range's rows before it, so that no task gets them all.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    if small:
        return rows.withColumns({n: upto(c, Window.orderBy(*order)) for n, c in sums.items()})
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    scratch.append(dealt)
    each = dealt.groupBy("_range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    base = each.select("_range", *(upto(F.col(n), Window.orderBy("_range")).alias(f"_before_{n}") for n in sums))
    within = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(base), "_range").withColumns({n: upto(c, within) + F.col(f"_before_{n}") for n, c in sums.items()})
    return out.drop("_range", *(f"_before_{n}" for n in sums))


def _total(rows: DataFrame, name: str, value: Column, small: bool) -> DataFrame:
    """rows with an aggregate over all of them."""
    return rows.withColumn(name, value.over(Window.partitionBy()) if small else F.lit(rows.agg(value).first()[0]))


def targets(per: DataFrame, weights: Sequence[float], most: int, small: bool, scratch: list[DataFrame]) -> DataFrame:
    """source, source_size, target of each source; per is a table of the first two.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; a target
    stops at `most` times its source's size, and what is over goes to the others by weight.  In order of that
    limit by weight, a source is capped as long as its share of what the capped ones before it leave is above it.
    Tables that the result reads are added to scratch.
    """
    name, ratio = F.col("source").asc_nulls_last(), F.col("cap") / F.col("w")
    per = _running(per, [name], {"turn": F.lit(1)}, small, scratch)
    given = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", given).withColumn("cap", F.col("source_size") * most)
    per = _running(per, [ratio, name], {"capped": F.col("cap"), "weighed": F.col("w")}, small, scratch)
    per = _total(_total(per, "all", F.sum("source_size"), small), "weight", F.sum("w"), small)
    per = per.withColumn("level", (F.col("all") - F.col("capped")) / (F.col("weight") - F.col("weighed")))
    per = per.withColumn("open", F.col("w") * F.col("level") <= F.col("cap"))
    per = _total(per, "first", F.max(F.when(F.col("open"), F.col("level"))), small)  # levels fall from the first open source on
    return per.select("source", "source_size", F.when(F.col("open"), F.col("w") * F.col("first")).otherwise(F.col("cap").cast("double")).alias("target"))


def _with(rows: DataFrame, per: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of per, which has one row a source; where sources are too many for a broadcast, the rows of
    hot ones are dealt by place over salted copies."""
    named = per.withColumnRenamed("source", "_source")
    if small:
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return join_salted(rows.withColumn("_key", key("source")), named.withColumn("_key", key("_source")), "_key", "_place").drop("_source", "_key")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies: how often the mix takes each document.

    docs has doc_id, text, source; other columns of it are kept, but for those named size, source_size, target,
    copies, which are replaced.  A null text has size 0; a null source is a source of its own.  Each document of
    a source is taken floor(target / source_size) times, and once more if its hash is below the source's
    threshold.  The threshold comes from histograms of size by hash bucket: cumulative sums find the bucket where
    the budget ends, only that bucket is split further, and at 48 bits the last bucket is taken if that brings
    the source nearer to its target.  Nothing is sorted and no row moves; equal rows stand or fall together.
    """
    docs, names = veiled(docs, "doc_id", "text", "source")
    sized = docs.withColumns({"size": n_words(F.col("text")), "_place": place(F.col("doc_id"), F.col("text"))})
    narrow = materialize(sized.select("source", "size", "_place"), "sizes")
    sources, state = _thresholds(narrow, weights, most)
    drop_scratch(narrow)
    out = _with(sized, state, sources <= BROADCAST_SOURCES)
    out = out.withColumn("copies", (F.col("_full") + (F.col("_place") < F.col("_below")).cast("long")))
    return unveiled(out, names, "size", "source_size", "target", "copies")


def mixed_sizes(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, copies of mix(), from one pass over the texts."""
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("_place"))
    narrow = materialize(narrow, "sizes")
    sources, state = _thresholds(narrow, weights, most)
    out = _with(narrow, state, sources <= BROADCAST_SOURCES)
    copies = F.col("_full") + (F.col("_place") < F.col("_below")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def _thresholds(narrow: DataFrame, weights: Sequence[float], most: int) -> tuple[int, DataFrame]:
    """How many sources there are; source, source_size, target, _full, _below of each."""
    per = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    sources, scratch = per.count(), [per]
    small = sources <= BROADCAST_SOURCES
    per = targets(per, weights, most, small, scratch)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = per.withColumn("_full", full.cast("long")).withColumn("left", F.col("target") - F.col("_full") * F.col("source_size")).withColumn("_below", F.lit(0).cast("long"))
    state = materialize(state, "mix-0")
    drop_scratch(*scratch)
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        last = level == LEVELS - 1
        edge = _with(narrow, state.select("source", "left", "_below"), small)
        if level:
            edge = edge.where(F.shiftright("_place", shift + LEVEL_BITS) == F.shiftright("_below", shift + LEVEL_BITS))
        sums = edge.groupBy("source", "left", F.shiftright("_place", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # 4096 rows a source at most
        ends = sums.withColumn("upto", upto).where("upto > left")
        first = F.min(F.struct("bucket", "upto", "n"))
        found = ends.groupBy("source").agg(first.alias("x")).select(F.col("source").alias("_source"), "x.*")
        state_ = state.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("_source")), "left")
        # no end: the budget covers all that is left, which happens only by rounding; the threshold then lies above it
        whole = F.when(F.lit(level == 0), F.lit(1 << LEVELS * LEVEL_BITS)).otherwise(F.shiftleft(F.shiftright("_below", shift + LEVEL_BITS) + 1, shift + LEVEL_BITS))
        rest = F.col("left") - (F.col("upto") - F.col("n"))
        bucket = F.col("bucket") + (F.col("upto") - F.col("left") < rest).cast("long") if last else F.col("bucket")
        state_ = state_.withColumn("_below", F.when(F.col("bucket").isNull(), whole).otherwise(F.shiftleft(bucket, shift)))
        state_ = state_.withColumn("left", F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(rest))
        old, state = state, materialize(state_.select(state.columns), f"mix-{level + 1}")
        drop_scratch(old)
    return sources, state.select("source", "source_size", "target", "_full", "_below")
