"""Labelled training rows, bounded and chosen by hash, that keep out a held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text, mod folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled rows outside the fold `held`: those with the smallest md5 of doc_id.

    Documents labelled more than once take the mean label; of rows that repeat a doc_id with other texts the least
    text counts, so that reruns learn alike.  The picked ids (at most `most`, so a broadcast of
    bounded size) meet the texts by broadcast, and no text is shuffled.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(folds) != held))
    named = named.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    picked = named.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
