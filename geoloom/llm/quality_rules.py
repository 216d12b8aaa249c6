"""Quality rules: native document statistics and learned decision lists of threshold conjunctions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialize

#: Labelled rows that rules are learned from at most; those whose id has the smallest hash.
MOST_LABELLED = 20_000
#: Words of a window whose repeats count.
WINDOW = 8
_WORD = r"[^\x20\x09-\x0D]+"
STATISTICS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words")


def repeated_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that are in the text twice or more, from the hashes of its words."""
    n = F.size(hashes)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))
    return windows.otherwise(F.array().cast("array<long>"))


def _covered(windows: Column) -> Column:
    """Words under the windows that occur again: starts in order, each adding what the next leaves uncovered."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(o: Column) -> Column:
        here = lambda x, i: (F.coalesce(F.get(o, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(o, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(o, here), lambda x: x["i"]))

    add = lambda s: F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
    # each step is bound to a variable by a one-element transform, so that it is computed once
    starts = F.flatten(F.transform(F.array(ordered), again))
    added = F.flatten(F.transform(F.array(starts), add))
    return F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and STATISTICS.

    A null text counts as empty; shares of nothing are 0.  All built-in functions: no row leaves the JVM.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, text.alias("_t"))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(_WORD), F.lit(0)))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_win", repeated_words(F.col("_h")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(_WORD))
    d = d.withColumn("_lines", lines)
    less = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        less(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_win")) < F.size("_win"), _covered(F.col("_win"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        less(r"\p{Lu}+").alias("_upper"),
        less(r"[!?|=_~^+\\/{}\[\]]+").alias("_marks"),
        less(r"[0-9]+").alias("_digits"),
        F.size(F.array_distinct("_h")).alias("_distinct"),
        F.size("_lines").alias("_n_lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_marks", "n_words").alias("mark_share"),
        share("_digits", "word_chars").alias("digit_share"), share("_distinct", "n_words").alias("distinct_share"),
        share("n_words", "_n_lines").alias("line_words"),
    )


@dataclass(frozen=True)
class Rule:
    """Rejects a document when every condition (statistic, '<=' or '>', threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def holds(self, row) -> bool:
        return all(row[c] <= t if op == "<=" else row[c] > t for c, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for c, op, t in self.conditions:
            out = out & ((F.col(c) <= t) if op == "<=" else (F.col(c) > t))
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a condition that keeps p of p0 bad and n of n0 good rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list, names: tuple[str, ...], longest: int) -> list[tuple[str, str, float]]:
    conditions, here = [], rows
    while len(conditions) < longest:
        p0 = sum(y for _, y in here)
        n0 = len(here) - p0
        if not p0 or not n0:
            break
        best = (0.0, None)
        for c in names:
            ordered = sorted((x[c], y) for x, y in here)
            p = n = 0
            for i, (v, y) in enumerate(ordered[:-1]):
                p, n = p + y, n + 1 - y
                if v < (after := ordered[i + 1][0]):
                    middle = round((v + after) / 2, 6)
                    if not v <= middle < after:
                        middle = v
                    best = max(best, (_gain(p, n, p0, n0), (c, "<=", middle)), (_gain(p0 - p, n0 - n, p0, n0), (c, ">", middle)), key=lambda b: b[0])
        if best[1] is None:
            break
        conditions.append(best[1])
        here = [(x, y) for x, y in here if Rule((best[1],), 0).holds(x)]
    return conditions


def learn(rows: list, names: tuple[str, ...] = STATISTICS, longest: int = 4, most: int = 12, precision: float = 0.9, support: int = 8) -> list[Rule]:
    """Sequential covering: rows are (statistics, 1 if bad else 0).

    Two thirds of the rows grow a rule, one condition at a time by FOIL's gain; the rest prunes it, dropping last
    conditions while (p - n) / (p + n) doesn't fall.  A rule stays if its precision over all rows that earlier
    rules left is at least `precision` with `support` bad rows; the rows that it covers go, and the next is grown.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        conditions = _grow(grow, names, longest)

        def worth(n: int, conditions=conditions, prune=prune) -> float:
            held = [y for x, y in prune if Rule(tuple(conditions[:n]), 0).holds(x)]
            return (2 * sum(held) - len(held)) / len(held) if held else -1.0

        if not conditions:
            break
        best = max(range(1, len(conditions) + 1), key=lambda n: (worth(n), -n))
        rule = Rule(tuple(conditions[:best]), 0)
        held = [y for x, y in left if rule.holds(x)]
        if sum(held) < support or sum(held) < precision * len(held):
            break
        rules.append(Rule(rule.conditions, sum(held) / len(held)))
        left = [(x, y) for x, y in left if not rule.holds(x)]
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, label: str = "quality", **how) -> list[Rule]:
    """Rules for label = 0, from MOST_LABELLED labelled rows at most (the smallest hashes of doc_id)."""
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_y"))
    rows = stats.select("doc_id", *STATISTICS).join(named, "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), *STATISTICS).limit(MOST_LABELLED).collect()
    return learn([(r.asDict(), 1 - int(r["_y"])) for r in rows], **how)


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects a document; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """doc_id, the counts, base_failed, rule, kept of every row of docs (doc_id, text).

    base_failed: fewer than least_words words, or more than most_repeated % of them in repeated windows.  rule is
    the learned rule that rejects the document (0: none).  Without labels no rule is learned and only the base
    decides.  Rows are judged alone: nulls, ties and repeated rows each give their own row.
    """
    stats = materialize(statistics(docs), "statistics")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(learned_rules(stats, labels)))
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", kept.alias("kept"))
