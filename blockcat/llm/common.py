"""What the text operators share: tables, words, and the core's stored frames and running totals (``operators.shared``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.operators.shared import Stored, fresh, partitions, running_totals, scratch, shared_folder, small, stored

__all__ = ["Stored", "WORD_BYTES", "first_of_each", "fresh", "partitions", "running_totals", "scratch", "shared_folder", "small", "stored", "table", "text_bytes", "words", "words_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_of_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of the keys, with these columns: the row that sorts first by the others, so that reruns agree
    (any row, if there are columns such as maps that have no order). Rows are combined before the shuffle."""
    named = [F.col(f"`{c}`") for c in columns]
    rest = [c for c in df.columns if c not in keys]
    if any("map<" in kind or kind == "variant" for _, kind in df.dtypes):
        return df.dropDuplicates(keys).select(*named)
    (row,) = fresh(df, "_first_row")
    first = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(row)) if rest else df.distinct()
    return first.select(*[F.col(f"`{c}`") if c in keys else F.col(f"{row}.`{c}`").alias(c) for c in columns])


def words_count(text: Column) -> Column:
    """Words of a text: runs of anything but space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column's values in UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of letters a-z, digits and whatever isn't ASCII."""
    return text.translate(WORD_BYTES).split()
