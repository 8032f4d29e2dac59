"""The registered queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(_table(spark, sf_dir, "documents")).drop("clean_text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import scored, train

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, train(docs, _table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored, train

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .threads import reply_ordered

    return reply_ordered(_table(spark, sf_dir, "conversations"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import with_neighbours

    return with_neighbours(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import deduplicated

    return deduplicated(_table(spark, sf_dir, "documents"), more=())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_chat_threads": op6_chat_threads,
    "op7_fingerprints": op7_fingerprints,
    "op8_html_extraction": op8_html_extraction,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
}
OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) AS p, ws FROM w WHERE doc_id IS NOT NULL),
h AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS seq FROM g),
m AS (SELECT seq, min(doc_id) AS low FROM h GROUP BY seq),
c AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.p, h.p + 13)) AS p FROM h JOIN m ON h.seq = m.seq WHERE m.low < h.doc_id),
r AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
         list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])) AS kept
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(kept, lambda x: x[1]), ' ')) AS kept_sha256
FROM k
"""


def _oracles() -> dict[str, str]:
    from . import mixing, ngram_join, quality_rules

    return {"op2_quality_rules": quality_rules.ORACLE_SQL, "op3_ngram_join": ngram_join.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op10_substring_dedup": OP10_SQL}


ORACLES: dict[str, str] = _oracles()
