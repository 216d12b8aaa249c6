import random

from geoloom.llm import ngram_join
from geoloom.llm.components import connected_components


def brute(rows, k, t):
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(d, shingles(x)) for d, x in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= t * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {(d, len(x), root(d)) for d, x in sets}


def families(seed, n, words, edits, copies):
    """Texts that differ from one of a few by a few words, some with a common passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(words)] for _ in range(n)]
    rows = []
    for i, base in enumerate(bases):
        for _ in range(copies if i == 0 else 6):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w + passage if i % 2 else w))
    r.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, k, t):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {tuple(r) for r in ngram_join.near_duplicates(docs, k, t).collect()}


def test_families_and_passages(spark):
    rows = families(1, 30, 120, 6, 120)
    assert found(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_large_family_near_the_threshold(spark, monkeypatch):
    rows = families(2, 3, 200, 5, 200)
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    monkeypatch.setattr(ngram_join, "FAMILY_BLOCK", 40)
    monkeypatch.setattr(ngram_join, "SALT_ABOVE", 30)
    got, want = found(spark, rows, 5, 80), brute(rows, 5, 80)
    assert got == want and len({c for _, _, c in got}) < len(got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a b c"), (6, "x " * 50), (7, "x " * 70), (8, "  \t\n"), (9, "word " + "y" * 300_000)]
    rows += [(None, "a b"), (3, "A b")]
    got = sorted(found(spark, rows, 4, 85), key=str)
    assert (3, 1, 3) in got and (4, 1, 3) in got and (5, 1, 5) in got and (6, 1, 6) in got and (7, 1, 6) in got
    assert (1, 0, 1) in got and (2, 0, 2) in got and (8, 0, 8) in got and (None, 1, None) in got
    assert found(spark, [], 4, 85) == set()


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "z"), (None, "a b c d e f", "n")], "doc_id long, text string, cls string")
    assert {tuple(r) for r in ngram_join.one_of_each(docs).collect()} == {(1, "a b c d e f", "x"), (3, "q", "z"), (None, "a b c d e f", "n")}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {tuple(r) for r in connected_components(edges).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
