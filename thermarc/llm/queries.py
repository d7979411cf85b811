"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermarc.llm import bpe, decontamination, license_scan, line_dedup, lm_scoring, merkle, mixing, near_dedup, quality_classifier, quality_rules, queries_sql, resampling, sharding, toxicity
from thermarc.llm.text import crc_mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _vocabulary()
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    return bpe.digests(coded, path, pattern)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return toxicity.score(docs, index).select("doc_id", held_out, "score", "predicted", "evidence", "evidence_words")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.lit(quality_rules.POLICIES["base"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(base) != 0).alias("base_failed"),
        quality_rules.kept().alias("kept"),
        "failure_bits",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the two labels: 0 bad, 1 good but toxic, 2 good. Kept: P(grade >= 1) of 0.5 or more."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    grades = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2).alias("grade"))
    model = quality_classifier.fit(docs, grades, crc_mod(F.col("doc_id"), 4) != 2, n_grades=3)
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return quality_classifier.grade(docs, model).select("doc_id", held_out, "expected_grade", "tail_probability", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 8)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark).drop("text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = lm_scoring.score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=2, percent=80)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.usage(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`seen` is what a reader finds: tampered rows have one character more than the manifest says."""
    docs = documents(spark, sf_dir)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    of = lambda n_chars: merkle.leaf(*[n_chars if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    leaves = docs.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), F.when(tampered, of(F.col("n_chars") + 1)).alias("seen"))
    found = merkle.manifest(leaves, "doc_id", "lang")
    fold = merkle.folded(F.coalesce("seen", "leaf"), F.col("path")).alias("folded_root")
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), fold)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir).select("doc_id", "text"), benchmark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_toxicity, op4_quality_rules, op5_quality_classifier, op6_sharding, op7_decontamination, op8_lm_scoring, op9_license_scan, op10_minhash_near_dedup, op11_source_mix, op12_merkle_manifest, op13_importance_resampling)
}

OP4_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (
  select doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) as ls
  from d),
m as (
  select doc_id, ws, len(ws)::bigint as n_words, len(ls)::bigint as n_lines,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::bigint as n_upper,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines
  from w),
win as (select doc_id, ws, unnest(range(1, n_words - 6)) as i from m where n_words > 8),
k as (select doc_id, i, array_to_string(ws[i:i + 7], chr(1)) as k from win),
r as (select doc_id, i from k qualify count(*) over (partition by doc_id, k) > 1),
c as (select doc_id, sum(n)::bigint as n_repeat_words from (
  select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from r) group by doc_id),
j as (select m.*, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words from m left join c using (doc_id)),
b as (
  select *,
    (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
     + case when 10 * n_symbols > n_words then 4 else 0 end + case when 100 * n_dup_lines > 40 * n_lines then 8 else 0 end
     + case when word_chars < 2 * n_words or word_chars > 25 * n_words then 16 else 0 end
     + case when 100 * n_upper > 50 * word_chars then 32 else 0 end)::bigint as failure_bits
  from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, failure_bits = 0 as kept, failure_bits
from b
"""

OP1_SQL = r"""
with d as (select doc_id, text, coalesce(text, '') as t from documents),
l as (select distinct doc_id, unnest(string_split(t, chr(10))) as line from d where doc_id is not null),
w as (select doc_id, line, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
        lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as ws from l),
p as (select doc_id, line, ws, len(ws) as n, len(ws) - 3 as m from w where len(ws) >= 3),
s as (select doc_id, line, n, ws[1:3] as s0,
        ws[4:3 + m // 4] as s1, ws[4 + m // 4:3 + 2 * m // 4] as s2, ws[4 + 2 * m // 4:3 + 3 * m // 4] as s3, ws[4 + 3 * m // 4:] as s4 from p),
k as (
  select doc_id, line, unnest([
    {'n': n, 'v': 0, 'a': s0, 'b': s1, 'c': s2, 'd': s3, 'e': s4},
    case when n >= 11 then {'n': n, 'v': 1, 'a': s0, 'b': []::varchar[], 'c': s2, 'd': s3, 'e': s4} end,
    case when n >= 11 then {'n': n, 'v': 2, 'a': s0, 'b': s1, 'c': []::varchar[], 'd': s3, 'e': s4} end,
    case when n >= 11 then {'n': n, 'v': 3, 'a': s0, 'b': s1, 'c': s2, 'd': []::varchar[], 'e': s4} end,
    case when n >= 11 then {'n': n, 'v': 4, 'a': s0, 'b': s1, 'c': s2, 'd': s3, 'e': []::varchar[]} end]) as k
  from s),
f as (select k, min(doc_id) as first_doc from k where k is not null group by k having min(doc_id) < max(doc_id)),
g as (select distinct doc_id, line from k join f using (k) where first_doc < doc_id),
x as (select doc_id, text, string_split(t, chr(10)) as ls, (select list(line) from g where g.doc_id = d.doc_id) as gone from d),
y as (select doc_id, text, ls, list_filter(ls, lambda z: gone is null or not list_contains(gone, z)) as st from x)
select doc_id, len(ls)::bigint as n_lines, (len(ls) - len(st))::bigint as n_dropped,
  len(ls) = len(st) or length(regexp_replace(array_to_string(st, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) > 0 as kept,
  case when text is not null then array_to_string(st, chr(10)) end as text
from y
"""

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_quality_rules": OP4_SQL, **queries_sql.ORACLES}
