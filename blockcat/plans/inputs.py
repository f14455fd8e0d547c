"""The driver's tables in the roles that the catalogue's operators expect, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: container (source), rel, size; extensions and case vary with the id."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".PNG", ".bin", ".dat", ".Json", ".prx")]), (F.col("doc_id") % 6 + 1).cast("int"))
    rel = F.concat(F.col("lang"), F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("Data")).otherwise(F.lit("data")), F.lit("/f"), F.col("doc_id").cast("string"), ends)
    return load(spark, sf_dir, "documents").select(F.col("source").alias("container"), rel.alias("rel"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "doc_id")


#: The same as a common table expression ``files``.
FILES_SQL = """files AS (
    SELECT source AS container,
           lang || '/' || CASE WHEN doc_id % 7 = 0 THEN 'Data' ELSE 'data' END || '/f' || doc_id ||
           ['.txt', '.PNG', '.bin', '.dat', '.Json', '.prx'][(doc_id % 6 + 1)::INT] AS rel,
           coalesce(strlen(text), 0)::BIGINT AS size, doc_id
    FROM documents)"""

RATIO_SQL = """CASE WHEN lower(rel) LIKE '%.png' THEN 950 WHEN lower(rel) LIKE '%.txt' OR lower(rel) LIKE '%.json' THEN 500
    WHEN lower(rel) LIKE '%.bin' OR lower(rel) LIKE '%.prx' THEN 850 ELSE 700 END"""
PREDICTED_SQL = f"(CASE WHEN size = 0 THEN 0 ELSE greatest(1, least(size, (size * ({RATIO_SQL}) + 999) // 1000)) END)::BIGINT"


def blocks(spark: SparkSession, sf_dir: str, size: int = 1024) -> DataFrame:
    """Documents cut into blocks: container (doc_id), idx, data."""
    from blockcat.operators.blocks import cut

    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("container"), F.coalesce("text", F.lit("")).alias("body"))
    return cut(docs, "container", "body", size)


BLOCKS_SQL = """blocks AS (
    SELECT container, idx::BIGINT AS idx, body[idx * 1024 + 1 : (idx + 1) * 1024] AS data
    FROM (SELECT doc_id AS container, encode(coalesce(text, '')) AS body,
                 unnest(range((strlen(coalesce(text, '')) + 1023) // 1024)) AS idx FROM documents))"""
