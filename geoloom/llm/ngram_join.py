"""N-gram Jaccard self-join by token-combination prefixes, and the components of its links.

The tokens of a document are the 64-bit hashes of its distinct word shingles.  One global order puts rare tokens
first (by hash) and frequent ones last (by hash).  Two sets with 100 * |x & y| >= t * |x | y| that aren't equal
lose at most n - ceil(t n) tokens of either side, so a prefix that still shares a signature after so many losses
finds every link: rare tokens are signatures by themselves and count 1; frequent tokens are dealt by hash into
classes, every two tokens of one class are a signature, and a class of m tokens counts m - 1.  The prefix is
extended until its count reaches n - ceil(t n) + 1.  How fine the classes are depends on the set's size by powers
of two; a set whose partners may fall into the next power gives signatures for both.

Which tokens are frequent decides the cost, never the result: they are those that at least `frequent` prefixes
hold, and of these the MOST_FREQUENT commonest at most, a table of at most 2 MB that is broadcast.

Equal sets are one class and compared once.  Signature groups of up to SMALL classes give their pairs; larger ones
only a star around one member.  Links of the first round join most of a group.  The second round looks, in blocks,
only at members whose components still differ: an exact bound on the symmetric difference (parity bitmaps) ties
those that may link into families, as a forest; then each set goes to its family once, the family's overlaps are
counted as matrix products, and a forest of true links comes out.  So every two members of a group that may link
are compared, no link between different texts is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import drop_scratch, join_salted, join_unique, materialize, mixed, scan_partitions, texts_of, word_hashes
from geoloom.llm.components import connected_components

#: Signature groups of up to so many classes give all their pairs.
SMALL = 16
#: At most so many tokens are kept as frequent; a group of rarer tokens is still handled exactly.
MOST_FREQUENT = 1 << 18
#: A signature whose tokens have more postings than this is split into salted parts, each with its own star.
SALT_ABOVE = 20_000
#: Members of a block of signature groups, and of families, in the second round; columns of a block's matrix.
BLOCK, FAMILY_BLOCK, COLUMNS = 1024, 1024, 4096
#: Bytes of bitmaps or token sets that fill a block with fewer members.
BLOCK_BYTES = 16 << 20
#: Candidate documents up to this number (8 MB of ids) are picked by broadcast, beyond it by a shuffled join.
BROADCAST_IDS = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of data, A-Z lower-cased; fewer than k words are one shingle."""
    w = word_hashes(data.lower())
    n = len(w)
    if not n:
        return w
    if n < k:
        return mixed((w * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    h = w[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        h = h + w[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mixed(h))


def required(n: int, t: int) -> int:
    """Tokens that a set of n shares with any partner at least."""
    return -(-t * n // 100)


def class_id(u: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(u.tobytes()) - (1 << 63)


def bitmap(u: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of 2n to 4n bits, 256 at least."""
    bits = 1 << max(8, int(2 * len(u) - 1).bit_length())
    at, n = np.unique(u & np.uint64(bits - 1), return_counts=True)
    on = np.zeros(bits, np.uint8)
    on[at[n % 2 == 1].astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """bits (rows of bytes) as if made with size bytes."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def most_apart(n: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """The largest symmetric difference that linked sets of n and m tokens can have."""
    s = n.astype(np.int64) + m
    return s - 2 * -(-t * s // (100 + t))


def signatures(u: np.ndarray, t: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sorted set u, and how many prefixes hold each at most (0: few)."""
    n, none = len(u), np.zeros(0, np.uint64)
    if n * (100 - t) < t:  # no set that differs from this one can be close enough
        return none, none
    need = n - required(n, t) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
        common = frequent[at] == u
        rare, ft, fc = u[~common], u[common], counts[at[common]]
    else:
        rare, ft, fc = u, none, none
    parts, bound = [mixed(rare[:need])], [np.zeros(min(need, len(rare)), np.uint64)]
    if len(rare) < need:
        need -= len(rare)
        for level in sorted({n.bit_length(), (n * 100 // t).bit_length()}):
            kinds = max(1, (1 << level) // 8)
            kind = (ft >> np.uint64(7)) % np.uint64(kinds)
            first = np.zeros(len(ft), bool)
            first[np.unique(kind, return_index=True)[1]] = True
            upto = int(np.searchsorted(np.cumsum(~first), need)) + 1
            order = np.argsort(kind[:upto], kind="stable")
            k, x, c = kind[:upto][order], ft[:upto][order], fc[:upto][order]
            d = 1
            while len(same := np.flatnonzero(k[d:] == k[:-d])):
                parts.append(mixed(x[same] * _ODD[0] + x[same + d] * _ODD[1] + np.uint64(level)))
                bound.append(np.minimum(c[same], c[same + d]))
                d += 1
    return np.concatenate(parts), np.concatenate(bound)


def _packed(bucket: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(b), b"".join(c[ends[b] : ends[b + 1]].tobytes() for c in columns)


def _emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "packed"])


def _frequent_tokens(docs: DataFrame, k: int, t: int, frequent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that at least `frequent` prefixes hold (sorted), and their counts."""

    def prefixes(batches):
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return _emit(list(_packed(mixed(token) % np.uint64(buckets), [token, n.astype(np.uint32)], buckets)))

        for batch in batches:
            for data in texts_of(batch.column(0)):
                u = shingle_set(data, k)
                if len(u):
                    held.append(u[: len(u) - required(len(u), t) + 1])
                    size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        token, n = [], []
        for x in table.column("packed"):
            b = x.as_buffer()
            m = len(b) // 12
            token.append(np.frombuffer(b, np.uint64, m))
            n.append(np.frombuffer(b, np.uint32, m, 8 * m))
        token, inverse = np.unique(np.concatenate(token), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(n)).astype(np.int64)
        return pa.table({"token": token[n >= frequent].view(np.int64), "n": n[n >= frequent]})

    found = docs.select("text").mapInArrow(prefixes, "bucket int, packed binary").groupBy("bucket").applyInArrow(count, "token long, n long")
    found = materialize(found, "frequent")
    levels = found.groupBy(F.ceil(F.log2("n") * 4).alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred rows at most
    total, cut = 0, None
    for level, n in levels:
        if (total := total + n) > MOST_FREQUENT:
            break
        cut = level
    rows = found.where(F.ceil(F.log2("n") * 4) >= cut).toArrow() if cut is not None else found.limit(0).toArrow()
    drop_scratch(found)
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return token[order], n[order]


def _sets(docs: DataFrame, k: int, t: int, frequent) -> DataFrame:
    """doc_id, n, cls, bits, sigs, salts of each document."""

    def make(batches):
        ft, fc = frequent.value
        for batch in batches:
            n, cls, bits, sigs, bounds = [], [], [], [], []
            for data in texts_of(batch.column(1)):
                u = shingle_set(data, k)
                s, b = signatures(u, t, ft, fc) if len(u) else (u, u)
                n.append(len(u))
                cls.append(class_id(u) if len(u) else None)
                bits.append(bitmap(u) if len(s) else None)
                salts = b // np.uint64(SALT_ABOVE) + np.uint64(1)
                sigs.append(s.tobytes() if len(s) else None)
                bounds.append(salts.astype(np.uint32).tobytes() if len(s) and (salts > 1).any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bounds, pa.binary())], ["doc_id", "n", "cls", "bits", "sigs", "salts"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n long, cls long, bits binary, sigs binary, salts binary")


def _groups(sets: DataFrame, t: int, buckets: int) -> DataFrame:
    """kind 0: a candidate pair (a, b); kind 1: b is in the large group of signature a; kind 2: b is the pivot of a salted part of it."""

    def deal(batches):
        for batch in batches:
            sig, cls, n, salts = [], [], [], []
            for c, m, s, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(s, np.uint64)
                sig.append(x)
                cls.append(np.full(len(x), c, np.int64))
                n.append(np.full(len(x), m, np.uint32))
                salts.append(np.frombuffer(p, np.uint32) if p else np.ones(len(x), np.uint32))
            if sig:
                sig, cls, n, salts = (np.concatenate(x) for x in (sig, cls, n, salts))
                salt = (cls.view(np.uint64) >> np.uint64(9)) % salts
                yield _emit(list(_packed(mixed(sig + salt * _ODD[2]) % np.uint64(buckets), [sig, cls, n, (salt + (salts > 1)).astype(np.uint32)], buckets)))

    def group(table: pa.Table) -> pa.Table:
        parts = [[], [], [], []]
        for x in table.column("packed"):
            b = x.as_buffer()
            m = len(b) // 24
            for part, (kind, at) in zip(parts, ((np.uint64, 0), (np.int64, 8), (np.uint32, 16), (np.uint32, 20)), strict=True):
                part.append(np.frombuffer(b, kind, m, at * m))
        sig, cls, n, salt = (np.concatenate(p) for p in parts)
        order = np.lexsort((cls, salt, sig))
        sig, cls, n, salt = (x[order] for x in (sig, cls, n, salt))
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]) | (cls[1:] != cls[:-1])
        sig, cls, n, salt = (x[new] for x in (sig, cls, n, salt))
        start = np.ones(len(sig), bool)
        start[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(sig)))
        kinds, left, right = [], [], []
        for g in range(2, SMALL + 1):
            base = at[(size == g) & (salt[at] == 0)]
            for i in range(g - 1 if len(base) else 0):
                for j in range(i + 1, g):
                    x, y = base + i, base + j
                    small, big = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                    ok = small * 100 >= big * t
                    kinds.append(np.zeros(ok.sum(), np.int32))
                    left.append(cls[x[ok]])
                    right.append(cls[y[ok]])
        which = np.repeat(np.arange(len(at)), size)
        large = ((size > SMALL) | (salt[at] > 0))[which]
        members, pivot = np.flatnonzero(large), at[which[large]]
        star = members[members != pivot]
        kinds += [np.zeros(len(star), np.int32), np.ones(len(members), np.int32)]
        left += [cls[at[which[star]]], sig[members].view(np.int64)]
        right += [cls[star], cls[members]]
        heads = at[salt[at] > 0]
        kinds.append(np.full(len(heads), 2, np.int32))
        left.append(sig[heads].view(np.int64))
        right.append(cls[heads])
        kinds, left, right = (np.concatenate(x) for x in (kinds, left, right))
        if pairs := int((kinds == 0).sum()):
            first = np.flatnonzero(kinds == 0)
            one = np.unique(np.stack([left[first], right[first]], 1), axis=0)
            other = kinds > 0
            kinds = np.concatenate([np.zeros(len(one), np.int32), kinds[other]])
            left, right = np.concatenate([one[:, 0], left[other]]), np.concatenate([one[:, 1], right[other]])
            assert len(one) <= pairs
        return pa.table({"kind": kinds, "a": left, "b": right})

    dealt = sets.where("sigs is not null and doc_id is not null").select("cls", "n", "sigs", "salts").mapInArrow(deal, "bucket int, packed binary")
    return dealt.groupBy("bucket").applyInArrow(group, "kind int, a long, b long")


def _both(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """pairs (a, b; a stored table) with the columns of x by a and of y by b.  a can be the middle of very large stars."""
    return join_salted(pairs, x, "a", "b").join(y, "b")


def _close(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """The pairs that the bound on the symmetric difference leaves."""

    def bound(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append(100 * min(n, m) >= t * max(n, m) and apart <= (s := n + m) - 2 * -(-t * s // (100 + t)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    x = classes.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    y = classes.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return _both(pairs, x, y).select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a long, b long")


def _linked(pairs: DataFrame, tokens: DataFrame, t: int) -> DataFrame:
    """The pairs whose sets are close enough."""

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= t * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    x = tokens.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    y = tokens.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    return _both(pairs, x, y).select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _tokens(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """cls, tokens of the classes in pairs, made from the text of one document each."""
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    ids = materialize(classes.join(named, "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def make(batches):
        for batch in batches:
            sets = [shingle_set(data, k) for data in texts_of(batch.column(1))]
            sets = [u for u in sets if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], ["cls", "tokens"])

    out = materialize(picked.mapInArrow(make, "cls long, tokens binary").dropDuplicates(["cls"]), "tokens")
    drop_scratch(ids)
    return out


def _parts(size, size_of_all, block: int):
    """Into how many blocks a group of so many members and bytes is cut."""
    return F.greatest(F.ceil(size / block), F.ceil(size_of_all / BLOCK_BYTES)).cast("int")


def _blocks(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """members of each key cut by hash into `parts` blocks, once for every two blocks; side: 0 first, 2 second, 1 both."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2)
    return dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "cls", "component", *columns).groupBy(key, "i", "j")


class _Forest:
    """Joins rows that hit each other; keeps one edge for each two components joined."""

    def __init__(self, cls: np.ndarray, label: np.ndarray):
        self.cls, self.component = cls, np.unique(label, return_inverse=True)[1]
        self.edges: list[np.ndarray] = []

    def join(self, i: int, hit: np.ndarray) -> None:
        hit = hit[self.component[hit] != self.component[i]]
        if len(hit):
            other, first = np.unique(self.component[hit], return_index=True)
            self.edges.append(np.stack([np.full(len(first), self.cls[i]), self.cls[hit[first]]], 1))
            self.component[np.isin(self.component, other)] = self.component[i]

    def table(self) -> pa.Table:
        e = np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.int64)
        return pa.table({"a": e.min(1) if len(e) else e[:, 0], "b": e.max(1) if len(e) else e[:, 1]})


def _apart(members: DataFrame, t: int) -> DataFrame:
    """A forest over the members of a signature group whose components differ and whose bitmaps allow a link.

    Two members that are both high are left to the group of the next cell.
    """

    def compare(table: pa.Table) -> pa.Table:
        cls, label, n, side = (table.column(c).to_numpy() for c in ("cls", "component", "n", "side"))
        high = table.column("high").to_numpy().astype(bool)
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        forest = _Forest(cls, np.arange(len(cls)))  # of rows: every row that may link across components must be tied
        for size in sorted({len(r) for r in raw}):
            xs = [i for i in left if len(raw[i]) == size]
            ys = np.array([i for i in right if len(raw[i]) in (size, size * 2, size // 2)], np.int64)
            if not xs or not len(ys):
                continue
            low = min(size, *(len(raw[i]) for i in ys))
            wide = np.stack([folded(raw[i], low) for i in ys]).view(np.uint64)
            for i in xs:
                ok = np.flatnonzero((label[ys] != label[i]) & ~(high[ys] & high[i]) & (forest.component[ys] != forest.component[i]) & (np.minimum(n[ys], n[i]) * 100 >= np.maximum(n[ys], n[i]) * t))
                if len(ok):
                    apart = np.bitwise_count(wide[ok] ^ folded(raw[i], low).view(np.uint64)).sum(1)
                    forest.join(i, ys[ok[apart <= most_apart(n[ys[ok]], n[i], t)]])
        return forest.table()

    return _blocks(members, "cell", ["n", "high", "bits"]).applyInArrow(compare, "a long, b long")


def _resolved(members: DataFrame, t: int) -> DataFrame:
    """Links that join the components of a family: exact, by the sets themselves, as a forest in each two blocks."""

    def compare(table: pa.Table) -> pa.Table:
        cls, label, side = (table.column(c).to_numpy() for c in ("cls", "component", "side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        n = np.array([len(x) for x in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), n)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        held = count[at] > 1
        names, at = np.unique(at[held], return_inverse=True)
        row = row[held]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        same = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, len(names), COLUMNS):
            lo, hi = np.searchsorted(at, (low, low + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, len(names) - low)), np.float32)
            part[row[lo:hi], at[lo:hi] - low] = 1
            same += part @ part.T
        forest = _Forest(cls, label)
        right = side >= 1
        for i in np.flatnonzero(side <= 1):
            both = same[i].astype(np.int64)
            forest.join(i, np.flatnonzero(right & (100 * both >= t * (n + n[i] - both))))
        return forest.table()

    return _blocks(members, "family", ["tokens"]).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, t: int = 80, frequent: int = SMALL + 1) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; other columns are ignored).

    Documents link when 100 * |x & y| >= t * |x | y| for their sets of k-word shingles (fewer words: the whole
    sequence is one shingle).  component_id is the smallest doc_id reachable by links, the document included.
    A text without words, or null, has the empty set and links with nothing.  Rows with the same doc_id count as
    one document when links are followed, and each gives a row; a null doc_id links with nothing and gets a null
    component_id.  Any number of equal texts is handled as one class.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = 64 + 8 * scan_partitions(docs)  # grows with the input, so that a bucket doesn't
    ft = spark.sparkContext.broadcast(_frequent_tokens(docs, k, t, frequent, buckets))
    sets = materialize(_sets(docs, k, t, ft), "sets")
    groups = materialize(_groups(sets, t, buckets), "groups")
    named = sets.where("cls is not null and doc_id is not null")
    classes = materialize(named.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")

    pivots = groups.where("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("cls"))
    heads = pivots.groupBy("sig").agg(F.min("cls").alias("a")).join(pivots, "sig").where("a <> cls").select("a", F.col("cls").alias("b"))
    pairs = materialize(groups.where("kind = 0").select("a", "b").unionByName(heads).distinct(), "pairs")
    near = materialize(_close(pairs, classes, t), "near")
    tokens = _tokens(docs, classes, near, k)
    links = materialize(_linked(near, tokens, t), "links")
    drop_scratch(pairs, near, tokens)
    labels = materialize(_labels(links, classes), "labels")

    members = groups.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("cls"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("w"))
    known = sizes.join(labels, "cls", "left").join(classes.select("cls", "rep", "n", "bits"), "cls")
    known = materialize(known.select("cls", F.coalesce("component", "rep").alias("component"), "n", "bits", "w"), "known")
    marked = materialize(_cells(join_unique(members, known.select("cls", "component", "n", "w"), "cls", "w"), t), "marked")
    drop_scratch(groups)
    open_ = marked.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("w"), F.sum("n").alias("all"), F.min("high").alias("high")).where("lo < hi and not high")  # of a cell all high nothing is compared
    open_ = materialize(open_.select("cell", _parts(F.col("w"), F.col("all") / 2, BLOCK).alias("parts"), "w"), "open")
    left = materialize(join_unique(marked.select("cell", "high", "cls"), open_, "cell", "w").where("parts is not null"), "left")
    forest = materialize(_apart(join_salted(left, known.drop("w"), "cls", "cell"), t).distinct(), "forest")
    drop_scratch(marked, open_, left)
    if forest.head(1):
        family = connected_components(forest.select(F.col("a").alias("u"), F.col("b").alias("v")))
        family = materialize(family.select(F.col("vertex").alias("cls"), F.col("component").alias("family")).join(known.select("cls", "component", "n"), "cls"), "families")
        sizes = family.groupBy("family").agg(F.count("*").alias("w"), F.sum("n").alias("all"))
        sizes = materialize(sizes.select("family", _parts(F.col("w"), F.col("all") * 8, FAMILY_BLOCK).alias("parts"), "w"), "family-sizes")
        tokens = _tokens(docs, classes, forest, k)
        found = materialize(_resolved(join_unique(family, sizes, "family", "w").join(tokens, "cls"), t), "more-links")
        drop_scratch(family, sizes, tokens)
        if found.head(1):
            old, labels = labels, materialize(_labels(links.unionByName(found), classes), "all-labels")
            drop_scratch(old)
        drop_scratch(found)
    drop_scratch(forest, known, links)

    final = classes.join(labels, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component_id"), "weight")
    final = materialize(final, "classes-labelled")
    drop_scratch(classes, labels)
    out = join_unique(sets.select("doc_id", "n", "cls"), final, "cls", "weight")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def _cells(members: DataFrame, t: int) -> DataFrame:
    """cell, high, cls, component, n: each member (sig, cls, component, n) in the two cells of its signature for its size.

    Sizes are banded so finely that linked sets are in one band or in two next to each other.  A cell holds a
    signature's members of a band and, marked high, those of the next, so that sets of unlike size never meet.  Cells
    are named by a hash: where two names fall together, more is compared and nothing is lost.
    """
    width = max(1.001 * math.log(100 / t), 1e-9)
    band = F.floor(F.log("n") / width)
    at = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("high")), F.struct((band - 1).alias("band"), F.lit(True).alias("high")))).alias("at")
    return members.select("sig", "cls", "component", "n", at).select(F.xxhash64("sig", "at.band").alias("cell"), "at.high", "cls", "component", "n")


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, component (a doc_id) of the classes that have links."""
    rep = classes.select("cls", "rep")
    edges = links.join(rep.select(F.col("cls").alias("a"), F.col("rep").alias("u")), "a").join(rep.select(F.col("cls").alias("b"), F.col("rep").alias("v")), "b")
    components = connected_components(edges.select("u", "v"))
    return rep.join(components.withColumnRenamed("vertex", "rep"), "rep").select("cls", "component")


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """Rows of docs whose document has the smallest doc_id of its near-duplicate group; all columns are kept.

    Rows that repeat a doc_id stand or fall together; rows with a null doc_id stay.
    """
    found = near_duplicates(docs, k, t)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
