"""The queries of this subpackage over the documents tables, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import license_scan, line_dedup, lm_scoring, media, mixing, ngram_join, packing, quality_model, quality_rules, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 4-word shingles, similarity 0.85."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, t=85)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and accepted notices of every document."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"), "score",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one has, as counts and a digest."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside fold 0 of 5."""
    scored = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents, mixed by source with weights 5, 2, 1."""
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in a tar shard, read back."""
    rows = media.with_metadata(media.with_contents(media.store(table(spark, sf_dir, "documents"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside fold 1 of 3."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is the documents labelled good."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and learned rules of every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_line_dedup, op4_packing, op5_quality_classifier, op6_mixing, op7_media, op8_toxicity, op9_lm_scoring, op10_quality_rules)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), p as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i, len(w) as n from w
), s as (
  select distinct doc_id, case when n < 4 then x1 else x || ' ' || x1 end as g from (
    select doc_id, n, i, x, case when n < 4 then string_agg(x, ' ') over (partition by doc_id order by i rows between unbounded preceding and unbounded following)
      else string_agg(x, ' ') over (partition by doc_id order by i rows between 1 following and 3 following) end as x1 from p)
  where n < 4 or i <= n - 3
), n as (select doc_id, count(*) as n from s group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), both_ways as (select a, b from links union all select b, a from links
), reach as (select doc_id as a, doc_id as b from w union select r.a, e.b from reach r join both_ways e on e.a = r.b
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id
from w left join n on n.doc_id = w.doc_id join reach r on r.a = w.doc_id group by w.doc_id, n.n""",
    "op3_line_dedup": f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), k as (
  select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l
), o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key
), d as (select k.*, coalesce(o.owner < k.doc_id, false) as gone from k left join o on o.key = k.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from d group by doc_id""",
    "op6_mixing": """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || coalesce(text, '')), 1, 12))::bigint as h from documents
), p as (
  select source, sum(size)::bigint as s, [5.0, 2.0, 1.0]::double[] as ws, row_number() over (order by source nulls last) - 1 as r from d group by source
), q as (select source, s, ws[r % 3 + 1] as w, s * 3 as cap from p
), v as (
  select *, (sum(s) over () - coalesce(sum(cap) over x, 0))::double / (sum(w) over () - coalesce(sum(w) over x, 0.0)) as level
  from q window x as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, s, case when w * level <= cap then w * first(level) over (order by case when w * level <= cap then 0 else 1 end, cap / w, source nulls last) else cap::double end as target from v
), e as (
  select d.*, t.s, t.target, case when t.s > 0 then floor(t.target / t.s)::bigint else 0 end as whole,
    sum(d.size) over (partition by d.source order by h) as upto, sum(d.size) over (partition by d.source, h) as n
  from d join t on t.source is not distinct from d.source
), f as (select *, target - whole * s as b from e)
select doc_id, size, s as source_size, target,
  (size * (whole + case when upto <= b or (upto - n <= b and upto - b < b - (upto - n)) then 1 else 0 end))::bigint as taken
from f""",
}
