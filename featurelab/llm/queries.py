"""Registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, archive, cotraining, hmm, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, template_extraction, whitening
from .common import table, tokenizer_path


def op1_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted_languages(table(spark, sf_dir, "documents"))


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_shares(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(hmm.held_out(table(spark, sf_dir, "documents")))


def op9_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extraction.main_texts(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.document_components(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ivf_pq_search, op2_language_id, op3_cotraining_quality, op4_best_fit_packing, op5_source_mixing, op6_quality_rules, op7_warc_archive, op8_hmm_scoring, op9_template_extraction, op10_ngram_jaccard_join, op11_embedding_whitening, op12_tokenizer_alignment, op13_line_dedup)}

_DIGITS = "'0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(f"lpad(to_base(('0x' || substr(digest, {5 * k + 1}, 5))::BIGINT, 32), 4, '0')" for k in range(8))
ORACLE_SQL = {
    "op7_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  translate(lower({_BASE32}), {_DIGITS}) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d""",
    "op13_line_dedup": """
WITH l AS (
  SELECT row_id, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_id, doc_id""",
}
