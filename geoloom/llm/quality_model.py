"""Quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages.  Every passage is encoded (style statistics and hashed byte trigrams through a learned
layer); gated attention, learned from document labels alone, weighs the passages; the weighted representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import drop_scratch, materialize, texts_of, word_blocks
from geoloom.llm.folds import remainder, training_rows

#: Labelled documents that the model is fitted on at most.
MOST_LABELLED = 4000
#: Passages of all these documents together at most: labelled rows are taken in md5 order, passing over those that the rest has no room for.
MOST_PASSAGES = 200_000
#: Bytes of a passage whose trigrams are counted at once.
CHUNK = 1 << 20
#: Words of a passage.
PASSAGE = 64
BUCKETS = 128
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = (_UPPER, b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"@/\\_=+~^{}[]()\"'`-", bytes(range(0x80, 0x100)))
N_STYLE = len(_CLASSES) + 8
N_FEATURES = N_STYLE + BUCKETS


def trigrams(flat: bytes) -> np.ndarray:
    """How many byte trigrams of flat fall into each bucket; one or two bytes count by themselves."""
    count = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(flat) - 2), CHUNK):
        b = np.frombuffer(flat[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        grams = (b[:-2] * 9967 + b[1:-1] * 619 + b[2:] * 31) >> 3 if len(flat) > 2 else b
        count += np.bincount(grams % BUCKETS, minlength=BUCKETS)
    return count


def passages(data: bytes) -> np.ndarray:
    """A row of N_FEATURES for each PASSAGE words of data; a text without words has one row of zeros."""
    rows, seen = [], set()
    for words in word_blocks(data):
        for at in range(0, len(words), PASSAGE):
            part = words[at : at + PASSAGE]
            flat = b" ".join(part)
            n, size, kinds = len(part), len(flat), set(part)
            style = [(size - len(flat.translate(None, c))) / size for c in _CLASSES]
            lengths = np.fromiter(map(len, part), np.float32, n)
            style += [
                n / PASSAGE, len(kinds) / n, len(kinds & seen) / len(kinds), min(float(lengths.mean()), 40) / 10, min(float(lengths.std()), 40) / 10,
                sum(w == v for w, v in zip(part, part[1:], strict=False)) / n, len({w[-1] for w in part}) / n, len({w[-3:] for w in part}) / n,
            ]
            seen |= kinds
            count = trigrams(flat)
            rows.append(np.concatenate([np.array(style, np.float32), np.sqrt(count / count.sum()).astype(np.float32)]))
    return np.stack(rows) if rows else np.zeros((1, N_FEATURES), np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
        """x: standardised passages; bag: the document of each, ascending."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a = a / np.bincount(bag, a, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"][0])}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.p, self.forward(x, bag, len(y))
        ds = (f["score"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, len(y))[bag])
        dv, du = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}
        return {k: v + decay * p[k] for k, v in g.items()}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 12, rate: float = 0.004, decay: float = 2e-4, seed: int = 7) -> AttentionModel:
    """Adam over mini-batches of 64 documents."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    del every
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    p = {"W": draw(N_FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.array([np.log(share / (1 - share))])}
    model = AttentionModel(mean, scale, p)
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    bags = [model.standard(b) for b in bags]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x = np.concatenate([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            step += 1
            for k, g in model.gradients(x, bag, y[pick], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: int = MOST_LABELLED, passages_held: int = MOST_PASSAGES) -> AttentionModel | float:
    """A model from labelled documents outside the held-out fold; with labels of one kind or none, that share alone (0.5 without labels).

    A text of more passages than are left of passages_held is passed over; the rows after it still count.
    """

    def features(batches):
        for batch in batches:
            sizes, out = [], []
            for data in texts_of(batch.column(1)):
                x = passages(data)
                sizes.append(len(x))
                out.append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "y", "n", "x"])

    rows = training_rows(docs, labels, label, folds, held, most)
    made = materialize(rows.mapInArrow(features, "doc_id long, y double, n long, x binary"), "quality-sample")
    fitting, room = [], passages_held
    for r in made.select("doc_id", "n").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").collect():  # `most` rows at most
        if r["n"] <= room:
            fitting.append((r["doc_id"],))
            room -= r["n"]
    kept = docs.sparkSession.createDataFrame(fitting, "doc_id long")
    got = made.join(F.broadcast(kept), "doc_id").select("doc_id", "y", "x").toArrow().sort_by("doc_id")
    drop_scratch(made)
    y = got["y"].to_numpy()
    if not len(y) or (y > 0.5).all() or (y <= 0.5).all():
        return float(y.mean()) if len(y) else 0.5
    return fit([np.frombuffer(x.as_buffer(), np.float32).reshape(-1, N_FEATURES) for x in got["x"]], y)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, n_passages, top_passage of every row of docs (doc_id, text).

    score is the probability of label 1; top_passage is the passage with the most attention.  Only the text is
    scored.  A null or empty text is one empty passage.  Rows are scored alone: equal texts score alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held))

    def score(batches):
        model = shared.value
        for batch in batches:
            scores, sizes, tops = [], [], []
            for data in texts_of(batch.column(1)):
                x = passages(data)
                sizes.append(len(x))
                if isinstance(model, float):
                    scores.append(model)
                    tops.append(0)
                    continue
                f = model.forward(model.standard(x), np.zeros(len(x), int), 1)
                scores.append(float(f["score"][0]))
                tops.append(int(f["a"].argmax()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), pa.array(tops, pa.int32())], ["doc_id", "held_out", "score", "n_passages", "top_passage"])

    rows = docs.select("doc_id", "text", (remainder(folds) == held).alias("held_out"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, n_passages int, top_passage int")
