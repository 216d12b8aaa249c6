import random
import re
from collections import defaultdict

import pytest

from geoloom.llm import line_dedup, mixing, quality_rules

STRIP = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(STRIP))


def test_line_dedup(spark):
    r = random.Random(5)
    lines = ["a common line here", "  A Common Line Here\t", "short", "ÄÖÜäöüÄÖÜ", "ÄÖÜäöüÄÖÜß", "\x0bother line, quite long\x0c", "", "   "] + [f"line number {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 12)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "a common line here\n" * 3), (3, "line number 3"), (None, "a common line here\nunique to the nameless")]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, h string").repartition(4)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                owner[key(line)] = min(owner.get(key(line), i), i)
    want = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if i is None or owner.get(key(x), i) == i]
        want.append((str(i), "\n".join(left), len(every), len(every) - len(left), "kept"))
    got = [(str(x.doc_id), x.text, x._n_lines, x._n_dropped, x.h) for x in line_dedup.dedup_lines(docs, batches=7).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.Runs(spark, 4)
    for i in range(5):
        runs.add(spark.createDataFrame([(bytes([i, j]),) for j in range(3)], "h binary"))
    assert [len(x) for x in runs.levels] == [2, 1]
    assert sorted(bytes(r.h) for run in runs.all() for r in run.collect()) == sorted(bytes([i, j]) for i in range(5) for j in range(3))
    runs.drop()


def fill(sizes, weights, most):
    """Shares by weight; what is over a limit goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = ["a", "B", "z", "é", None, "tiny", "empty"]
    rows = [(i, "w " * r.randrange(1, 30), r.choices(names[:6], [90, 20, 20, 20, 10, 1])[0]) for i in range(3000)]
    rows += [(5000, None, "empty"), (5001, "", "empty"), (None, "x y z", "a"), (7, "again again", "B")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix(docs).collect()
    again = mixing.mixed_sizes(docs).collect()
    assert sorted((str(x.doc_id), x.size, x.copies) for x in got) == sorted((str(x.doc_id), x.size, x.copies) for x in again)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in got:
        assert x.size == len(WORD.findall(x.text or "")) and 0 <= x.copies <= 3
        sizes[x.source] += x.size
        taken[x.source] += x.size * x.copies
        target[x.source] = x.target
    want = fill(sizes, (5, 2, 1), 3)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 30
    assert mixing.mix(docs.limit(0)).count() == 0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(1, 9), r.choices(["hot", None, "", *map(str, range(40))], [3000, 50, 50] + [5] * 40)[0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = sorted(tuple(map(str, x)) for x in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(tuple(map(str, x)) for x in mixing.mix(docs).collect()) == want and len(want) == 4000


def test_targets_of_equal_sources(spark):
    for sizes in ({c: 100 for c in "abcdefg"}, {"a": 100, "b": 700, "c": 900, "d": 100, "e": 700}):
        per = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(per, (5, 2, 1), 3, True, []).collect()}
        assert got == {s: pytest.approx(t) for s, t in fill(sizes, (5, 2, 1), 3).items()}


def test_targets_by_ranges(spark):
    r = random.Random(8)
    sizes = {None: 70, "hot": 90_000, **{f"{chr(97 + i % 26)}{i}": r.choice([0, 1, 3, 50, 900]) for i in range(700)}}
    per = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    want, ranges = fill(sizes, (5, 2, 1), 3), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for small in (True, False):
            got = {x.source: x.target for x in mixing.targets(per, (5, 2, 1), 3, small, ranges).collect()}
            assert got == {s: pytest.approx(t) for s, t in want.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 2 and all(x.select("_range").distinct().count() > 1 for x in ranges)


def test_statistics(spark):
    r = random.Random(9)
    texts = [None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "l\nl\n \n \nl", "é ü #$% <a>|&*", "𝒳𝒴 word"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in quality_rules.statistics(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, at, covered, seen, dup = WORD.findall(t), defaultdict(list), set(), set(), 0
        for j in range(len(w) - 7):
            at[tuple(w[j : j + 8])].append(j)
        for places in at.values():
            if len(places) > 1:
                covered.update(k for j in places for k in range(j, j + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want


def test_decision_list():
    r = random.Random(1)
    rows = []
    for _ in range(3000):
        x = {c: r.random() for c in quality_rules.STATISTICS}
        bad = (x["symbol_share"] > 0.8 and x["n_words"] <= 0.5) or x["upper_share"] > 0.9
        rows.append((x, int(bad) if r.random() < 0.99 else int(not bad)))
    rules = quality_rules.learn(rows)
    wrong = sum(any(rule.holds(x) for rule in rules) != ((x["symbol_share"] > 0.8 and x["n_words"] <= 0.5) or x["upper_share"] > 0.9) for x, _ in rows)
    assert rules and wrong < 0.02 * len(rows)
    assert quality_rules.learn([]) == [] and quality_rules.learn([({c: 0.0 for c in quality_rules.STATISTICS}, 1)] * 50) == []


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, " ".join(map(str, range(30)))), (3, None), (None, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality_rules.apply_rules(docs, labels).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False), None: (True, False)}
