"""A training corpus from documents: toxicity, line dedup, near duplicates, mixing, packing.

Stages keep every column of the documents as it is, whatever its name; line dedup changes text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from geoloom.llm.common import materialize, unveiled, veiled
from geoloom.llm.queries import TOKENIZER, table

#: Documents with at least this score are toxic and go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC."""
    plain, names = veiled(docs, "doc_id", "text")
    scored = toxicity.score_toxicity(plain, table(spark, sf_dir, "labels"))
    return unveiled(scored.where(F.col("score") < TOXIC), names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars follows the text."""
    plain, names = veiled(docs, "doc_id", "text", "n_chars")
    kept = line_dedup.dedup_lines(plain)
    return unveiled(kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group (five words, 0.8)."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    plain, names = veiled(docs, "doc_id", "text", "source")
    mixed = mixing.mix(plain).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unveiled(mixed, names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity stage is a trained model: SQL can't express run().
ORACLE_SQL = None
