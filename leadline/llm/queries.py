"""The queries of the training-data operators, over the whole tables of an input folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadline.llm import alignment, bpe, decontam, fingerprint, jaccard_join, license_scan, packing, phrases, ppm, quality, quotes, secret_scan, token_count
from leadline.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels"), learn="fold != 0"), threshold=0.3)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), RANKS).drop("redacted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"), learn="fold != 1")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reached r JOIN ends e ON r.y = e.x)
SELECT r.x AS doc_id, any_value(n) AS n_shingles, min(r.y) AS component_id FROM reached r JOIN sizes ON sizes.doc_id = r.x GROUP BY r.x
"""


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE, with_ids=False, with_text=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns, posed as replies by mail with nested quotations, are taken apart and linked again."""
    return quotes.link_quotes(quotes.as_mail(table(spark, sf_dir, "conversations")), stuffed=True).drop("n_quoted", "n_linked")


OP9_SQL = r"""
WITH RECURSIVE before AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(turn) OVER w AS t1, lag(turn, 2) OVER w AS t2, coalesce(lag(text) OVER w, '') AS x1, coalesce(lag(text, 2) OVER w, '') AS x2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
linked AS (SELECT conv_id, turn, role, text, CASE WHEN regexp_matches(x1, '\S') THEN t1 WHEN regexp_matches(x2, '\S') THEN t2 END AS parent_turn FROM before),
threads AS (
  SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM linked WHERE parent_turn IS NULL
  UNION ALL SELECT l.conv_id, l.turn, t.root_turn, t.depth + 1 FROM linked l JOIN threads t ON t.conv_id = l.conv_id AND t.turn = l.parent_turn)
SELECT conv_id, turn, role, parent_turn, root_turn, depth, row_number() OVER (PARTITION BY conv_id, root_turn ORDER BY turn) - 1 AS position, text
FROM linked JOIN threads USING (conv_id, turn)
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024, end_id=2, with_ids=False).drop("ids")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_secrets": op2_secrets,
        "op3_token_counts": op3_token_counts,
        "op4_licenses": op4_licenses,
        "op5_decontamination": op5_decontamination,
        "op6_ppm_scores": op6_ppm_scores,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_bpe_roundtrip": op8_bpe_roundtrip,
        "op9_quote_linking": op9_quote_linking,
        "op10_fingerprints": op10_fingerprints,
        "op11_packing": op11_packing,
        "op12_collocations": op12_collocations,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": license_scan.oracle(), "op7_ngram_jaccard": OP7_SQL, "op9_quote_linking": OP9_SQL, "op12_collocations": phrases.ORACLE}
