"""Registered queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.operators.blocks import cut, digest
from blockcat.plans import block_queries, catalog_queries, more_queries, scalar_queries


def block_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into blocks with SHA-256 digests: per language, blocks, bytes and distinct digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.coalesce("text", F.lit("")).alias("body"))
    blocks = cut(docs, "lang", "body", 1024, keep_empty=True)
    return blocks.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.sum(F.octet_length("data").cast("long")).alias("bytes"), F.countDistinct(digest(F.col("data"))).alias("n_distinct"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"block_catalog": block_catalog, **scalar_queries.QUERIES, **catalog_queries.QUERIES, **block_queries.QUERIES, **more_queries.QUERIES}

ORACLE: dict[str, str] = {
    "block_catalog": """
        WITH d AS (SELECT lang, encode(coalesce(text, '')) AS body FROM documents),
        b AS (SELECT lang, body, unnest(range(0, greatest(1, (octet_length(body) + 1023) // 1024))) AS idx FROM d),
        c AS (SELECT lang, body[idx * 1024 + 1 : (idx + 1) * 1024] AS block FROM b)
        SELECT lang, count(*) AS n_blocks, sum(octet_length(block))::BIGINT AS bytes, count(DISTINCT sha256(block)) AS n_distinct
        FROM c GROUP BY lang""",
    **scalar_queries.ORACLE,
    **catalog_queries.ORACLE,
    **block_queries.ORACLE,
    **more_queries.ORACLE,
}
