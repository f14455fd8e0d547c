"""Where things go: block starts, inode numbers, hash-sorted path tables, tail files, cluster runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators.shared import fresh, running_totals, sum_before


def path_order() -> list:
    """Case-insensitive (ASCII) order of paths, ties by bytes."""
    return [S.ascii_lower(F.col("rel")), F.col("rel")]


def by_path(files: DataFrame, container: str, value: str | None = None, first: Column | None = None) -> DataFrame:
    """``files`` with ``before``: the sum of ``value`` (or the number) of the container's files that precede in path order.

    ``first`` comes before the path in the order. One range shuffle over all containers and paths, so that a container of
    any size spreads over many tasks.
    """
    group, lead, low = fresh(files, "_container", "_first", "_low")
    rows = files.withColumn(group, F.col(container)).withColumn(lead, F.lit(0) if first is None else first).withColumn(low, S.ascii_lower(F.col("rel")))
    return running_totals(rows, [group, lead, low, "rel"], value, group, "path-order").drop(group, lead, low)


def block_starts(files: DataFrame, container: str, block: int, empty_takes_one: bool) -> DataFrame:
    """``blocks`` and ``block_start`` of each file in path order."""
    n = S.ceil_div(F.col("size"), F.lit(block))
    rows = files.withColumn("blocks", F.greatest(F.lit(1).cast("long"), n) if empty_takes_one else n)
    return by_path(rows, container, "blocks").withColumnRenamed("before", "block_start")


def inode_numbers(dirs: DataFrame, files: DataFrame, container: str, base: int) -> DataFrame:
    """Folders first, then files, each in path order, numbered from ``base``."""
    rows = dirs.select(container, "rel", F.lit(0).alias("_kind")).unionByName(files.select(container, "rel", F.lit(1).alias("_kind")))
    return by_path(rows, container, None, F.col("_kind")).select(container, "rel", (F.col("_kind") == 0).alias("is_dir"), (F.col("before") + base).alias("inode"))


def tail_order(files: DataFrame, container: str, order: str | None = None) -> DataFrame:
    """``place``: files that go to the tail after all others, each part in the order it has: by the distinct integers of
    ``order`` (such as a schedule's) within the container, or by path where none is given."""
    tail = S.goes_to_tail(F.col("rel"))
    if order is None:
        return by_path(files, container, None, tail).withColumnRenamed("before", "place")
    group, lead = fresh(files, "_container", "_first")
    rows = files.withColumn(group, F.col(container)).withColumn(lead, tail)
    return running_totals(rows, [group, lead, order], None, group, "tail-order").drop(group, lead).withColumnRenamed("before", "place")


def path_table(entries: DataFrame, container: str, collision: int = 0x80000000) -> DataFrame:
    """Hash-sorted path table: a lone hash has its value, a shared one a collision mark with the group's number."""
    groups = entries.groupBy(container, "hash").agg(F.min_by("value", "seq").alias("first"), F.count("*").alias("n"))
    numbered = sum_before(groups.withColumn("_shared", (F.col("n") > 1).cast("int")), container, "hash", "_shared", "_number", 1 << 20)
    return numbered.withColumn("value", F.when(F.col("n") > 1, F.lit(collision).cast("long") + F.col("_number")).otherwise(F.col("first"))).drop("first", "_shared", "_number")


def allocated(clusters: DataFrame) -> DataFrame:
    """(volume, used, free): how many clusters are taken and how many are not."""
    return clusters.groupBy("volume").agg(F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("free"))


def tail_run(clusters: DataFrame, needed: int, slack: int, cap: int = 4096) -> DataFrame:
    """(volume, first, count): the right-most start from which at least ``needed`` clusters in a row are free.

    ``clusters`` has (volume, cluster, used). Free runs are islands; the best start in one is its end less ``needed``. A run
    counts up to ``cap`` clusters, so more than that are never found.
    """
    free = clusters.filter(~F.col("used")).filter(F.lit(0 < needed <= cap))
    ranked = sum_before(free.withColumn("_one", F.lit(1)), "volume", "cluster", "_one", "_rank")
    islands = ranked.withColumn("_run", F.col("cluster") - F.col("_rank")).groupBy("volume", "_run").agg(F.max("cluster").alias("last"), F.count("*").alias("n"))
    fit = islands.filter(F.col("n") >= needed).groupBy("volume").agg(F.max("last").alias("last"))
    first = F.col("last") - needed + 1
    return fit.select("volume", first.alias("first"), F.least(F.lit(needed + slack), F.col("last") - first + 1).cast("long").alias("count"))


def without(entries: DataFrame, rel: str) -> DataFrame:
    """The entries but for those of one path, whatever its case."""
    return entries.filter(S.ascii_lower(F.col("rel")) != S.ascii_lower(F.lit(rel)))


def extract_order(entries: DataFrame) -> DataFrame:
    """An extraction plan as it is read: by place in the image, then size, then path bytes."""
    return entries.orderBy("image_offset", "size", "rel")


def extract_totals(entries: DataFrame, container: str, block: int) -> DataFrame:
    """Entries, bytes and blocks of an extraction plan."""
    return entries.groupBy(container).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.sum(S.ceil_div(F.col("size"), F.lit(block))).alias("blocks"))


def dedup_paths(entries: DataFrame, container: str, strict: bool = False) -> DataFrame:
    """One of the paths that differ in case only, the smallest by bytes; ``strict`` fails instead."""
    groups = entries.groupBy(container, S.ascii_lower(F.col("rel")).alias("folded")).agg(F.min("rel").alias("rel"), F.count("*").alias("n"))
    if strict:
        groups = groups.withColumn("rel", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("paths differ in case only: "), F.col("rel")))).otherwise(F.col("rel")))
    return groups


def next_needed(entries: DataFrame, at: int) -> DataFrame:
    """The first block from ``at`` on that an entry (first_block, blocks) still needs."""
    own = F.greatest(F.col("first_block"), F.lit(at).cast("long"))
    return entries.filter(F.col("first_block") + F.col("blocks") > at).filter("blocks > 0").agg(F.min(own).alias("next_block"))
