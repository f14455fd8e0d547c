"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockcat.llm import exact_dedup, licenses, mixing, packing, quality, secrets, simhash, token_files, toxicity, vectors
from blockcat.llm.common import shared_folder, table

TOKENIZER = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex[:8]}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, path)


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_source_mixing, op4_simhash_near_dedup, op5_license_scan, op6_token_files, op7_vector_near_dedup, op8_toxicity, op9_exact_dedup, op10_secret_scan)}

ORACLE: dict[str, str] = {
    "op3_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, 2.0::DOUBLE * source_size AS most,
                   (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (
                        ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources),
        goals AS (
            SELECT source, source_size,
                   CASE WHEN most > w * level THEN w * first_value(CASE WHEN most > w * level THEN level END IGNORE NULLS) OVER (
                        ORDER BY most / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE most END AS target
            FROM levels),
        budgets AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END AS epochs FROM goals),
        placed AS (
            SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS rest,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
            FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken
        FROM placed""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
