"""Append-only operation logs: the last line per key, bounded histories, queues, caches with tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockcat.operators.shared import value_before


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The last line of each key: an aggregation, combined before the shuffle."""
    top = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return log.groupBy(*keys).agg(top.alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in dict.fromkeys([*order, *rest])])


def bounded_history(log: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str], keep: int = 64) -> DataFrame:
    """The last lines of the ``keep`` keys updated last, newest first: what a table that evicts its oldest key holds."""
    return latest(log, keys, order, rest).orderBy(*[F.col(c).desc() for c in order], *keys).limit(keep)


def cache_state(log: DataFrame, key: str, order: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The last line of each key, those gone whose last line is a tombstone (valid = 0)."""
    return latest(log, [key], order, ["valid", *rest]).filter("valid <> 0").drop("valid")


def least_recent_out(entries: DataFrame, measured: str, key: str, keep: int = 256, busy: Column | None = None) -> DataFrame:
    """The ``keep`` entries measured last; those that are ``busy`` (waiting for or under measurement) are never put out for others."""
    order = [F.col(measured).desc(), F.col(key)]
    return entries.orderBy(*([] if busy is None else [busy.desc()]), *order).limit(keep)


def next_queued(operations: DataFrame) -> DataFrame:
    """The operation to start next: of those queued the one with the smallest seq, if none is running."""
    first = operations.agg(F.min(F.when(F.col("status") == "queued", F.col("seq"))).alias("seq"), F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("busy"))
    return first.filter("not busy and seq is not null").select("seq")


def slot_to_reuse(operations: DataFrame, slots: int = 64) -> DataFrame:
    """(seq) of the operation whose slot a new one takes: none while slots are free, else the oldest that is neither running nor queued."""
    done = F.min(F.when(~F.col("status").isin("running", "queued"), F.col("seq")))
    return operations.agg(F.count("*").alias("n"), done.alias("seq")).filter((F.col("n") >= slots) & F.col("seq").isNotNull()).select("seq")


def stale_reads(reads: DataFrame, container: str) -> DataFrame:
    """Blocks read through a mount (container, idx, sha, verified), with ``trusted``: only after a verified block of the
    container, and not where a block's digest is that of the one before it, as a stale read repeats what it gave before."""
    started = reads.filter("verified").groupBy(container).agg(F.min("idx").alias("_from"))
    numbered = reads.withColumn("_head", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))
    before = value_before(numbered, container, "idx", "_head", "_last")
    rows = before.join(started, container, "left")
    trusted = F.coalesce((F.col("idx") >= F.col("_from")) & ~F.coalesce(F.col("_last") == F.col("_head"), F.lit(False)), F.lit(False))
    return rows.withColumn("trusted", trusted).drop("_head", "_last", "_from")


def queue_order(events: DataFrame, keep: int = 128) -> DataFrame:
    """Distinct paths from (path, at, priority): prioritised ones first, the latest first; then in order of arrival."""
    rows = events.groupBy("path").agg(F.max(F.when(F.col("priority"), F.col("at"))).alias("first_at"), F.min("at").alias("at"))
    return rows.orderBy(F.col("first_at").desc_nulls_last(), "at", "path").limit(keep)


def changed_only(log: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Lines whose value differs from the key's line before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def savings(source: Column, stored: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), source - stored)


def known_prefix(states: DataFrame, container: str) -> DataFrame:
    """Blocks of known state before the first unknown (0) one, and the counts of each state."""
    first = F.min(F.when(F.col("state") == 0, F.col("idx")))
    return states.groupBy(container).agg(F.coalesce(first, F.max("idx") + 1).alias("known"), F.count_if(F.col("state") == 1).alias("matched"), F.count_if(F.col("state") == 2).alias("bad"), F.count_if(~F.col("state").isin(1, 2)).alias("unknown"))


def resumable(journal: DataFrame, now: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Journals whose identity is that of the container now and whose counters agree."""
    return journal.join(now, list(identity), "left_semi").filter("matched + bad = scanned")
