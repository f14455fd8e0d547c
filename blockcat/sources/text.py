"""Small text formats: append-only JSON lines, JSON markers, bad-block tables, settings and line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their order (file, then place in it); malformed lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = lines.withColumn("row", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    return rows.filter("row is not null and row._corrupt is null").select("row.*", "file", "n").drop("_corrupt")


def read_markers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_bad_blocks(spark: SparkSession, path: str, blocks: int) -> DataFrame:
    """Distinct block numbers of a table's first column; other lines are skipped, numbers out of range and empty lists fail."""
    first = F.regexp_extract("value", r"^[ ]*(\d+)(?:\t|\s*$)", 1)
    rows = spark.read.text(path).select(first.alias("n")).filter("n <> ''").select(F.col("n").cast("long").alias("block")).distinct()
    checked = rows.withColumn("block", F.when(F.col("block") < blocks, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("block out of range: "), F.col("block").cast("string"))).cast("long")))
    if checked.limit(1).count() == 0:
        raise ValueError("no bad blocks listed")
    return checked


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(n, key, value) of ``key = value`` lines; comments (# or ;) and other lines are skipped, quotes dropped."""
    line = F.trim(F.regexp_replace("value", r"\r$", ""))
    pattern = r"^([^=]*?)[ \t]*=[ \t]*(.*)$"
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), line.alias("line")).filter(~F.col("line").rlike("^[#;]") & F.col("line").rlike(pattern))
    return rows.select("n", F.regexp_extract("line", pattern, 1).alias("key"), F.regexp_replace(F.regexp_extract("line", pattern, 2), '^"(.*)"$', "$1").alias("value"))


def read_line_list(spark: SparkSession, path: str, end: str = "") -> DataFrame:
    """(n, path) of a list of paths, comments left out; only those with the given end, whatever its case."""
    line = F.trim(F.regexp_replace("value", r"\r$", ""))
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), line.alias("path"))
    return rows.filter((F.col("path") != "") & ~F.col("path").rlike("^[#;]") & F.lower("path").endswith(end.lower()))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, path, sha256, size, mtime) of files in folders named by version."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("version"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
