"""Registered queries of this subpackage and their SQL; each reads its whole table and returns the operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.chat_quotes import link_replies
from millrace.llm.decontaminate import benchmark_hits
from millrace.llm.html_extract import extract_pages
from millrace.llm.license_scan import license_scan
from millrace.llm.mixing import mix_sources
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.quality import quality_rules
from millrace.llm.secret_scan import counted, named, secret_spans
from millrace.llm.substring_dedup import substring_dedup
from millrace.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
hits AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT a.doc_id, a.i FROM windows a JOIN firsts f ON a.win = f.win AND f.first_doc < a.doc_id), range(0, 13) t(j)
), gone AS (SELECT doc_id, list(p) AS ps FROM hits GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w
    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
"""

def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_deleted")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_replies(table(spark, sf_dir, "conversations"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [counted(F.col("base"), i).alias(name) for i, name in enumerate(("n_assign", "n_access", "n_hex"))]
    return out.select("doc_id", *counts, F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold")


#: Shares of the sample's tokens by language and by form; sources share by their tokens to the power of mixing.SMOOTHING.
MIX_TARGETS = {"lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}, "topic": {"prose": 0.9}}
MIX_SHARE = 0.3


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), MIX_SHARE, MIX_TARGETS)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "weight")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    known = table(spark, sf_dir, "labels").where(remainder != 1).select("doc_id", "toxic")
    out = toxicity(docs, docs, known)
    return out.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_secret_scans": op4_secret_scans,
    "op5_license_scans": op5_license_scans,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
}
