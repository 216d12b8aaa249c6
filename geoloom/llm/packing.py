"""Vector best-fit packing of token sequences, planned on the histogram of piece lengths.

Pieces of one length are alike, so the plan works on counts: at most `capacity` lengths, whatever the number of
documents.  Lengths are placed in decreasing order.  Open bins are kept as types (residual tokens, documents and
attention cost, and how many bins are like that); of the types in which a piece fits under all three, the one
with the smallest residual norm after filling is chosen (or the largest weighted dot product of demand and
residual), filled with as many pieces as fit, and split where only some of its bins are filled.  Each step uses
up a length or a type, so the plan stays small.  Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import materialize

#: Words whose ids a worker remembers at most; the memory starts anew when it is full.
REMEMBERED = 600_000
#: Characters of texts that are encoded at once, but for a longer text.
GROUP_CHARS = 1_500_000
#: Rows that a plan can have at most; more would mean that lengths were not grouped.
MOST_SLOTS = 2_000_000


@dataclass
class Plan:
    """slot i holds the ranks from first[i] on (over all lengths, in the order of `start`)."""

    start: np.ndarray  # of each length: the first rank of its pieces
    first: np.ndarray
    sequence: np.ndarray  # of the slot's first bin
    each: np.ndarray  # pieces of this slot in one bin
    offset: np.ndarray
    length: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.start[length] + rank
        slot = np.searchsorted(self.first, at, "right") - 1
        within = at - self.first[slot]
        return self.sequence[slot] + within // self.each[slot], self.offset[slot] + within % self.each[slot] * self.length[slot]


def plan_bins(counts: dict[int, int], capacity: int, most_docs: int, most_cost: int, by: str = "norm", weights=(1.0, 0.05, 0.1)) -> Plan:
    """counts: pieces of each length.  A bin holds at most capacity tokens, most_docs pieces, most_cost summed squared lengths."""
    cap = np.array([capacity, most_docs, most_cost], np.float64)
    weights = np.array(weights)
    residual = np.zeros((64, 3))
    bins: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # how many, (length, pieces) in order

    def add(res, many, content):
        nonlocal residual
        if len(bins) == len(residual):
            residual = np.vstack([residual, np.zeros_like(residual)])
        residual[len(bins)] = res
        bins.append((many, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        need = np.array([length, 1, length * length], np.float64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits in no bin")
        while left:
            open_ = residual[: len(bins)]
            fits = np.flatnonzero((open_ >= need).all(1))
            if not len(fits):
                each = int((cap // need).min())
                full, rest = divmod(left, each)
                if full:
                    add(cap - need * each, full, ((length, each),))
                if rest:
                    add(cap - need * rest, 1, ((length, rest),))
                break
            each = np.minimum((open_[fits] // need).min(1), left)
            after = (open_[fits] - need * each[:, None]) / cap
            score = (weights * after**2).sum(1) if by == "norm" else -(weights * (need / cap) * (open_[fits] / cap)).sum(1)
            best = int(np.argmin(score))
            i, each = int(fits[best]), int(each[best])
            many, content = bins[i]
            used = min(many, left // each)
            res = open_[i].copy()
            if used < many:
                bins[i] = (many - used, content)
                add(res - need * each, used, (*content, (length, each)))
            else:
                bins[i] = (many, (*content, (length, each)))
                residual[i] = res - need * each
            left -= used * each
    lengths = sorted(counts)
    start = np.zeros(capacity + 1, np.int64)
    at = 0
    for length in lengths:
        start[length] = at
        at += counts[length]
    upto, rows, sequence = start.copy(), [], 0
    for many, content in bins:
        offset = 0
        for length, each in content:
            rows.append((upto[length], sequence, each, offset, length))
            upto[length] += many * each
            offset += length * each
        sequence += many
    if len(rows) > MOST_SLOTS:
        raise ValueError(f"the plan has {len(rows)} slots")
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(start, *columns, sequence)


#: Characters for which splitting here equals the tokenizer's own: ASCII and Latin letters and marks that lower-casing
#: and NFC map one to one, and white space that both sides agree on.  Other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00ff\u0152\u0153\u2010-\u2027\u2030-\u205e]*")
# The pattern by which this vocabulary parts words, over the characters of _PLAIN in lower case.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff\u01530-9]+")


class WordEncoder:
    """Ids of texts.  Each distinct word is encoded once and remembered; many new words go in one call, whose ids are
    parted at those that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids: list[int] = []
        for at in range(0, len(new), 2000):
            ids += self.tokenizer.encode_batch_fast([" ".join(new[at : at + 2000])], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("a word was not encoded by itself")
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_WORD.findall(t.lower()) for t in texts]
        words = list(itertools.chain.from_iterable(parts))
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(set(words))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        low = self.starts[at]
        size = self.starts[at + 1] - low
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(low - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum([0] + [len(p) for p in parts])]
        return [ids[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, then id 0; in order."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < GROUP_CHARS):
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            plain = [bool(_PLAIN.fullmatch(t)) for t in group]
            known = iter(self._plain([t for t, p in zip(group, plain, strict=True) if p]))
            others = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(group, plain, strict=True) if not p], add_special_tokens=False))
            for p in plain:
                ids = next(known) if p else np.array(next(others).ids, np.uint32)
                yield np.append(ids, np.uint32(0)).astype("<u4")


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool) -> DataFrame:
    def cut(batches):
        encoder, task = WordEncoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = [[] for _ in range(7)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    data = part.tobytes()
                    n = len(part)
                    for column, x in zip(rows, (doc_id, piece, start, n, zlib.crc32(data), seen[n], data if with_ids else None), strict=True):
                        column.append(x)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(rows[0]), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "seen", "ids", "task"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, seen long, ids binary, task int")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, most_docs: int | None = None, most_cost: int | None = None, by: str = "norm", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of the pieces of every row of docs (doc_id, text).

    A document is the tokenizer's ids and a final 0; a null text is empty and gives that 0 alone.  Documents
    longer than capacity are cut into pieces of capacity tokens, the last of which may be shorter.  most_docs and
    most_cost bound the pieces and the summed squared lengths of a sequence; by default they never bind.  Rows
    are packed alone, also repeated ones and those with a null doc_id.  Without rows the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(_pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = plan_bins(total, capacity, most_docs or capacity, most_cost or capacity * capacity, by)
    shared = spark.sparkContext.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seen")).alias("rank"), *(["ids"] if with_ids else []))

    def place(batches):
        for batch in batches:
            sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) for c in names] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            extra = ["ids"] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in extra], [*names, "sequence_id", "offset", *extra])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema + (", ids binary" if with_ids else ""))
