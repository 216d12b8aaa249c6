"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic unless every sentence is harmless: P = 1 - prod(1 - p_s).  A sentence's p_s is a logistic
score of its words and their beginnings.  Only document labels are needed; the sentences with high p_s are then the offending ones.
"""

from __future__ import annotations

import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from geoloom.llm.common import drop_scratch, materialize, texts_of
from geoloom.llm.folds import remainder, training_rows

#: Labelled documents that the model is fitted on at most.
MOST_LABELLED = 12_000
#: A word is learned when so many training documents have it.
LEAST_DOCS = 4
#: Toxic training documents that a feature worth counting is in.
LEAST_BAD = 3
#: Standard errors by which the toxic share of a word's documents must exceed that of all.
LEAST_Z = 5.0
#: The noisy-or's leak: the chance that a document is labelled toxic for no sentence.  Scores leave it out.
LEAK = 0.05
#: Log odds of a sentence without any learned word, before learning.
BIAS = -7.0
#: A sentence without a stop ends after so many words.
LONGEST = 60
#: Code points of the beginnings that stand beside a longer word.
BEGINNINGS = (4, 6, 8)
#: Words whose weight a worker remembers at most; the memory starts anew when it is full.
REMEMBERED = 500_000
_STOP = re.compile(rb"[.!?\n\x0b\x0c\r]+")
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
_TRIM = b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*#$%&|-_"


def sentences(data: bytes):
    """(start, end, words) of each sentence with words; positions in bytes, words lower-cased and trimmed of marks."""
    at = 0
    for stop in [*_STOP.finditer(data), None]:
        to = stop.start() if stop else len(data)
        if words := data[at:to].lower().split():
            ends = [to]
            if len(words) > LONGEST:
                every = [w.end() for w in itertools.islice(_WORD.finditer(data, at, to), LONGEST - 1, None, LONGEST)]
                ends = every[:-1] + ends if len(words) % LONGEST == 0 else every + ends
            for i, end in enumerate(ends):
                yield at, end, [w.strip(_TRIM) for w in words[i * LONGEST : (i + 1) * LONGEST]]
                at = end
        at = stop.end() if stop else to


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings, each marked by a leading ^."""
    text = word.decode(errors="replace")
    return [word, *(b"^" + text[:k].encode() for k in BEGINNINGS if len(text) > k)]


@dataclass
class NoisyOr:
    weights: dict[int, float]  # by the hash of a feature
    bias: float

    def __post_init__(self):
        self.known: dict[bytes, dict[int, float]] = {}

    def parts(self, word: bytes) -> dict[int, float]:
        if (found := self.known.get(word)) is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            hashes = map(xxhash.xxh64_intdigest, features(word))
            found = self.known[word] = {h: x for h in hashes if (x := self.weights.get(h)) is not None}
        return found

    def sentence_scores(self, data: bytes) -> list[tuple[int, int, float]]:
        out = []
        for start, end, words in sentences(data):
            held = {}
            for w in words:
                if part := self.parts(w):
                    held |= part
            z = self.bias + sum(held.values())
            out.append((start, end, 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
        return out

    @staticmethod
    def combine(scores: list[float]) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(np.array(scores), 1 - 1e-12)).sum())) if scores else 0.0


def fit(bags: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, y: np.ndarray, vocabulary: np.ndarray, steps: int = 400, rate: float = 0.15, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights of the vocabulary (sorted feature hashes) and the bias, by Adam on all rows.

    bags: a document's features that the vocabulary has, and the sentence (from 0) of each; sizes: its sentences.
    """
    docs, first = np.repeat(np.arange(len(y)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    count = int(first[-1])
    pairs = [np.stack([s.astype(np.int64) + first[d], np.searchsorted(vocabulary, w)]) for d, (w, s) in enumerate(bags)]
    sents, ids = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    w, b = np.zeros(len(vocabulary)), BIAS
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(sents, w[ids], count), -30, 30)
        p = 1 / (1 + np.exp(-z))
        harmless = np.exp(np.bincount(docs, -np.logaddexp(0, z), len(y)))
        pull = np.where(y > 0.5, -(1 - LEAK) * harmless / (1 - (1 - LEAK) * harmless), 1.0) / len(y)
        dz = pull[docs] * p
        g = np.append(np.bincount(ids, dz[sents], len(w)) + decay * w / len(w) ** 0.5, dz.sum() + decay * (b - BIAS))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature hashes of a training document, the sentence of each, and how many sentences there are."""
    w, s, n = array("Q"), array("I"), 0
    for _, _, part in sentences(data):
        own = [f for x in part for f in features(x)]
        w.extend(map(xxhash.xxh64_intdigest, own))
        s.extend([n] * len(own))
        n += 1
    return np.array(w, np.uint64), np.array(s, np.uint32), n


def _counted(rows: DataFrame, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and in how many documents of rows they are: those in `only`, or without it those in LEAST_BAD or more."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        held = []
        for batch in batches:
            for data in texts_of(batch.column(0)):
                w = np.unique(_hashed(data)[0])
                held.append(w if shared.value is None else w[np.isin(w, shared.value, assume_unique=True)])
        if held:
            f, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n)], ["f", "n"])

    total = rows.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    got = (total.where(F.col("n") >= LEAST_BAD) if only is None else total).toArrow()  # of the bounded sample
    f, n = got["f"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(f)
    return f[order], n[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, most: int = MOST_LABELLED) -> NoisyOr:
    """A model from labelled documents outside the held-out fold; without labels of both kinds it finds nothing toxic.

    A feature is learned if LEAST_DOCS documents have it and the share of toxic ones among them is LEAST_Z standard
    errors above that of all.  Counting is left to the executors; the driver gets features that pass, and where they are.
    """
    rows = materialize(training_rows(docs, labels, label, folds, held, most), "toxic-sample")
    share, bad = rows.agg(F.avg("y"), F.sum((F.col("y") > 0.5).cast("int"))).first()
    if not bad or bad == rows.count():
        return NoisyOr({}, -30.0)
    share = min(max(share, 0.01), 0.99)
    words, toxic = _counted(rows.where("y > 0.5"), None)
    n = _counted(rows, words)[1]
    good = (n >= LEAST_DOCS) & (toxic / n - share >= LEAST_Z * np.sqrt(share * (1 - share) / n))
    vocabulary = words[good]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def hits(batches):
        for batch in batches:
            words, sents, sizes = [], [], []
            for data in texts_of(batch.column(1)):
                w, s, size = _hashed(data)
                ok = np.isin(w, shared.value)
                words.append(w[ok].tobytes())
                sents.append(s[ok].tobytes())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.binary()), pa.array(sents, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "y", "w", "s", "n"])

    got = rows.select("doc_id", "text", "y").mapInArrow(hits, "doc_id long, y double, w binary, s binary, n long").toArrow().sort_by("doc_id")
    drop_scratch(rows)
    bags = [(np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.uint32)) for w, s in zip(got["w"], got["s"], strict=True)]
    w, b = fit(bags, got["n"].to_numpy(), got["y"].to_numpy(), vocabulary)
    return NoisyOr({int(h): float(x) for h, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-3}, b)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, offending: float = 0.5) -> DataFrame:
    """All columns of docs (doc_id, text and others), and held_out, score, spans (start, end, score of offending sentences).

    score is the probability of label 1; a text without words scores 0.  Positions are bytes of the UTF-8 text.
    Columns of docs named held_out, score or spans are replaced.  Only the text is scored, each row alone.
    """
    docs = docs.drop("held_out", "score", "spans")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(plain, labels, label, folds, held))
    rows = docs.withColumn("held_out", remainder(folds) == held)
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("spans", ArrayType(span))])

    def score(batches):
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for data in texts_of(batch.column("text")):
                found = model.sentence_scores(data)
                scores.append(model.combine([p for _, _, p in found]))
                spans.append([{"start": s, "end": e, "score": float(p)} for s, e, p in found if p >= offending])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*batch.schema.names, "score", "spans"])

    return rows.mapInArrow(score, schema)
