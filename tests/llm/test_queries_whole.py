"""Each query of the subpackage and the pipeline over whole tables, against DuckDB or plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import line_dedup, mixing, ngram_join, quality_rules, toxicity
from geoloom.llm.queries import ORACLES, QUERIES
from geoloom.scratch import clear_scratch, materialize, shared_root

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, source from read_parquet('{DIR}/documents.parquet')").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    got = QUERIES[name](spark, DIR)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    a = sorted((tuple(r) for r in got.select(sorted(got.columns)).collect()), key=str)
    assert a == sorted(con.sql(f"select {columns} from ({ORACLES[name]})").fetchall(), key=str) and a


def test_license_columns(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, DIR).collect()}
    assert len(got) == len(docs)
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, text, _ in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places = [(at, label) for p, label in phrases.items() for at in range(len(w)) if tuple(w[at : at + len(p)]) == p]
        starts, labels = [at for at, _ in places], sorted({label for _, label in places})
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(x.labels.split(",")) | ({""} if not labels else set()) and 0 <= x.score <= 1


def test_packed_pieces(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = QUERIES["op4_packing"](spark, DIR).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert len(of) == len(docs)
    for i, text, _ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length) for r in of[i]) == want
        assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])) for r in of[i])
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("name, threshold", [("op5_quality_classifier", 0.3), ("op8_toxicity", 0.7)])
def test_scores(spark, docs, name, threshold):
    folds, held = (5, 0) if threshold == 0.3 else (3, 1)
    rows = QUERIES[name](spark, DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    again = QUERIES[name](spark, DIR).collect()
    assert {r.doc_id: round(r.score, 9) for r in rows} == {r.doc_id: round(r.score, 9) for r in again}


def test_scores_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert quality_rules.apply_rules(none, labels).count() == 0


def test_verdict_equals_holds(spark, docs):
    """The rules as a Spark expression, against the same rules row by row."""
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    stats = materialize(quality_rules.statistics(documents), "stats")
    rules = quality_rules.learned_rules(stats, spark.read.parquet(f"{DIR}/labels.parquet"))
    rules = rules + [quality_rules.Rule((("n_words", "<=", 40.0), ("distinct_share", ">", 0.5)), 1.0), quality_rules.Rule((("word_length", ">", 5.0),), 1.0)]
    rows = stats.withColumn("rule", quality_rules.verdict(rules)).collect()
    assert {r.rule for r in rows} - {0}
    for r in rows:
        assert r.rule == next((i for i, rule in enumerate(rules, 1) if rule.holds(r)), 0)
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, DIR).collect()}
    for r in rows:
        x = got[r.doc_id]
        assert x.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and x.kept == (not x.base_failed and x.rule == 0)


def plain_lines(rows):
    """rows (doc_id, text) without the lines that an earlier one has."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i)
    return [(i, "\n".join(x for x in (text or "").split("\n") if i is None or owner.get(key(x), i) == i)) for i, text in rows]


def plain_groups(rows, k=5, t=80):
    """The smallest doc_id of each row's near-duplicate group."""
    sets = {}
    for i, text in rows:
        w = text.translate(LOWER).split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def test_pipeline_stages_against_plain_python(spark, docs):
    """Every stage on what the stage before it kept."""
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), documents.columns
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]

    first = materialize(stages["toxicity"](spark, documents, DIR), "t")
    scores = {r.doc_id: r.score for r in QUERIES["op8_toxicity"](spark, DIR).collect()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, _, _ in docs if scores[i] < 0.7)

    second = materialize(stages["line_dedup"](spark, first, DIR), "l")
    rows = {r.doc_id: r for r in first.collect()}
    want = plain_lines([(r.doc_id, r.text) for r in rows.values()])
    assert sorted((r.doc_id, r.text, r.n_chars, r.lang, r.source) for r in second.collect()) == sorted((i, t, len(t), rows[i].lang, rows[i].source) for i, t in want)

    third = materialize(stages["ngram_join"](spark, second, DIR), "n")
    groups = plain_groups(want)
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, g in groups.items() if i == g)

    fourth = materialize(stages["mixing"](spark, third, DIR), "m")
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == {i: n for i, n in copies.items() if n}

    packed = stages["packing"](spark, fourth, DIR).collect()
    assert Counter((r.doc_id, r.piece) for r in packed if r.piece == 0) == {(i, 0): n for i, n in copies.items() if n}
    assert all(x.columns == columns for x in (first, second, third, fourth))
    whole = corpus_pipeline.run(spark, DIR)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


CLASHING = "gone _key _salt _place _full _below _source size source_size target copies score spans held_out _copy _n_lines _n_dropped cls component left w bucket row block h k y sig level".split()


def clashing(spark):
    texts = [(1, "one line that is long\nand another long line"), (2, "One line that is long\nnot the same at all"), (3, None), (4, ""), (None, "one line that is long"), (2, "again the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.concat(F.lit(c + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))


def kept_as_they_are(rows, *but):
    return all(getattr(r, c) == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING if c not in but)


def test_clashing_names(spark):
    docs, labels = clashing(spark), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == 6 and kept_as_they_are(rows, "_n_lines", "_n_dropped") and sum(r._n_dropped for r in rows) == 1
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6 and kept_as_they_are(rows, "size", "source_size", "target", "copies") and sum(r.size for r in rows) == rows[0].source_size
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 6 and kept_as_they_are(rows, "held_out", "score", "spans")
    rows = ngram_join.one_of_each(docs).collect()
    assert len(rows) == 6 and kept_as_they_are(rows)


def test_clashing_names_in_the_pipeline(spark, tmp_path):
    clashing(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and kept_as_they_are(docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = tmp_path / "empty"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_sets_of_unlike_size_share_a_passage(spark):
    """A passage in texts of 1 to 40 times its length, with close pairs at every size."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{j}" for j in range(10 + 25 * i))
        rows += [(2 * i, f"{passage} {own}"), (2 * i + 1, f"{passage} {own} tail{i}")]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_groups(rows)


def test_runs_go_when_a_batch_fails(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables("default")}
    monkeypatch.setattr(line_dedup, "join_unique", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        line_dedup.dedup_lines(spark.createDataFrame([(1, "a long enough line"), (2, "a long enough line")], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables("default")} == before


def test_scratch_is_cleared(spark):
    rows = materialize(spark.range(3), "three")
    files = spark._jvm.org.apache.hadoop.fs.Path(rows.scratch)
    store = files.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(files) and rows.scratch.startswith(shared_root(spark))
    clear_scratch(spark)
    assert not store.exists(files)
