"""The block store: cutting content into fixed-size blocks, digests, offsets, comparison, repair and patches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators.shared import small, stored, sum_before, value_before

BLOCK = 65_536
LEVEL = 7


def cut(files: DataFrame, key: str, body: str, block: int = BLOCK, keep_empty: bool = False) -> DataFrame:
    """(key, idx, data): content cut into blocks, the last one as short as it is; an empty file has no block (or an empty one)."""
    n = F.floor((F.octet_length(body) + block - 1) / block).cast("int")
    n = F.greatest(F.lit(1), n) if keep_empty else n
    rows = files.select(key, F.col(body).cast("binary").alias("_b"), n.alias("_n")).filter("_n > 0")
    rows = rows.select(key, "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("idx"))
    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.substring("_b", F.col("idx") * block + 1, F.lit(block)).alias("data"))


def digest(data: Column) -> Column:
    """SHA-256 of a block's real bytes (a short last block isn't padded)."""
    return F.sha2(data, 256)


def offsets(blocks: DataFrame, container: str, length: str, start: int = 0) -> DataFrame:
    """``off``: where each block's stored bytes begin, containers apart; a container of any size spreads over many tasks."""
    return sum_before(blocks.drop("off"), container, "idx", length, "off").withColumn("off", F.lit(start).cast("long") + F.col("off"))


def not_monotone(blocks: DataFrame, container: str) -> DataFrame:
    """Blocks that begin before the one ahead of them."""
    return value_before(blocks, container, "idx", "off", "_before").filter("_before > off").drop("_before")


def overlaps(intervals: DataFrame, container: str, block: int = BLOCK) -> DataFrame:
    """(container, idx, lo, hi) of the part of each half-open interval [off, off + size) in each block it meets.

    The interval names its blocks, so joining with blocks is an equi-join on (container, idx).
    """
    rows = intervals.filter("size > 0").withColumn("idx", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))))
    return rows.withColumn("lo", F.greatest("off", F.col("idx") * block)).withColumn("hi", F.least(F.col("off") + F.col("size"), (F.col("idx") + 1) * block))


def forced_raw(blocks: DataFrame, raw: DataFrame, container: str, block: int = BLOCK) -> DataFrame:
    """``force_raw``: whether a block meets a raw interval."""
    met = overlaps(raw, container, block).select(container, "idx").distinct().withColumn("_met", F.lit(True))
    return blocks.join(met, [container, "idx"], "left").withColumn("force_raw", F.coalesce("_met", F.lit(False))).drop("_met")


def encode(blocks: DataFrame, block: int = BLOCK, level: int = LEVEL, percent: int = 5) -> DataFrame:
    """Adds ``stored`` and ``compressed``: deflate of the block padded with zeros if that saves enough, else the padded block.

    Rows with ``force_raw`` skip the codec. Deflate has no built-in; batches go through Arrow.
    """
    names = [c for c in blocks.columns if c != "data"]
    kinds = ", ".join(f"`{c}` {dict(blocks.dtypes)[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored, packed = [], []
            raw = b.column("force_raw").to_pylist() if "force_raw" in names else [False] * b.num_rows
            for data, keep in zip(b.column("data"), raw, strict=True):
                full = data.as_py().ljust(block, b"\0")
                out = full if keep else zlib.compress(full, level)
                small = not keep and (block - len(out)) * 100 >= block * percent
                stored.append(out if small else full)
                packed.append(small)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(stored, type=pa.binary()), pa.array(packed, type=pa.bool_())], names=[*names, "stored", "compressed"])

    return blocks.mapInArrow(run, f"{kinds}, stored binary, compressed boolean")


def inflate(stored: bytes | None, block: int = BLOCK) -> tuple[bytes | None, str | None]:
    """(data, error): of exactly a block's length it is raw, else it must inflate to that."""
    if not stored or len(stored) > block:
        return None, "bad stored length"
    if len(stored) == block:
        return stored, None
    try:
        out = zlib.decompress(stored)
    except zlib.error:
        return None, "bad stream"
    return (out, None) if len(out) == block else (None, "bad block length")


def decode(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``data`` (the whole block) and ``error`` from ``stored``."""
    names = [c for c in blocks.columns if c != "stored"]
    kinds = ", ".join(f"`{c}` {dict(blocks.dtypes)[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [inflate(x.as_py(), block) for x in b.column("stored")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([d for d, _ in got], type=pa.binary()), pa.array([e for _, e in got], type=pa.string())], names=[*names, "data", "error"])

    return blocks.mapInArrow(run, f"{kinds}, data binary, error string")


def hash_mode(stored: DataFrame, sidecar: DataFrame, container: str) -> DataFrame:
    """Per container: missing, stale (other size or block count) or used hashes."""
    side = sidecar.select(container, F.col("blocks").alias("_b"), F.col("size").alias("_s"))
    mode = F.when(F.col("_b").isNull(), "missing").when((F.col("_b") != F.col("blocks")) | (F.col("_s") != F.col("size")), "stale").otherwise("used")
    return stored.join(side, container, "left").withColumn("mode", mode).drop("_b", "_s")


def compare(expected: DataFrame, live: DataFrame, container: str) -> DataFrame:
    """(container, idx, state, first_diff): matched by hash, matched by bytes though hashes differ, or bad; missing blocks are bad.

    ``expected`` has the stored digest (sha) and the bytes (data), ``live`` the bytes that are there now. Digests are taken
    where the bytes lie and 32 bytes a block are joined. Bytes move only for blocks whose digests differ: their keys, few
    where little is damaged, are joined to either side (broadcast when a count shows that they are). ``first_diff`` is the
    first byte at which a bad block differs (null where it is missing).
    """
    want = expected.select(container, "idx", F.unhex("sha").alias("_want"), F.lit(True).alias("_known"))
    have = live.select(container, "idx", F.unhex(digest(F.col("data"))).alias("_have"))
    states = stored(want.join(have, [container, "idx"], "left").select(container, "idx", F.coalesce(F.col("_want") == F.col("_have"), F.lit(False)).alias("same"), F.col("_have").isNotNull().alias("there")), "digests")
    fine = states.filter("same").select(container, "idx", F.lit("matched").alias("state"), F.lit(None).cast("long").alias("first_diff"))
    gone = states.filter("not there").select(container, "idx", F.lit("bad").alias("state"), F.lit(None).cast("long").alias("first_diff"))
    doubt = small(states.filter("not same and there").select(container, "idx"))
    left = expected.select(container, "idx", F.col("data").alias("_a")).join(doubt, [container, "idx"], "left_semi")
    right = live.select(container, "idx", F.col("data").alias("_b")).join(doubt, [container, "idx"], "left_semi")
    both = left.join(right, [container, "idx"]).select(container, "idx", S.first_difference(F.col("_a"), F.col("_b")).alias("first_diff"))
    told = both.select(container, "idx", F.when(F.col("first_diff") < 0, "matched-by-bytes").otherwise("bad").alias("state"), F.when(F.col("first_diff") >= 0, F.col("first_diff")).alias("first_diff"))
    return fine.unionByName(gone).unionByName(told)


def outcome_counts(states: DataFrame, container: str) -> DataFrame:
    return states.groupBy(container).agg(F.count("*").alias("checked"), F.count_if(F.col("state") != "bad").alias("matched"), F.count_if(F.col("state") != "matched").alias("hash_mismatched"), F.count_if(F.col("state") == "bad").alias("bad"))


def first_differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``first_diff``: the first byte at which two whole blocks differ, a shorter one differing where it ends; -1 if equal (null counts as empty)."""
    return pairs.withColumn("first_diff", S.first_difference(F.col(a), F.col(b)))


def verify_set(bad: DataFrame, totals: DataFrame, container: str) -> DataFrame:
    """Bad blocks and their neighbours, within the container, each once."""
    near = bad.join(totals, container).select(container, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("idx") - 1), F.least(F.col("blocks") - 1, F.col("idx") + 1))).alias("idx"))
    return near.distinct()


def repaired_offsets(blocks: DataFrame, bad: DataFrame, container: str, block: int = BLOCK, start: int = 0) -> DataFrame:
    """Offsets after bad blocks are rewritten raw: ``new_len`` and ``new_off``."""
    mark = bad.select(container, "idx").distinct().withColumn("_bad", F.lit(True))
    rows = blocks.join(mark, [container, "idx"], "left").withColumn("new_len", F.when(F.col("_bad"), F.lit(block)).otherwise(F.col("stored_len")).cast("long")).drop("_bad")
    return sum_before(rows.withColumnRenamed("off", "old_off"), container, "idx", "new_len", "new_off").withColumn("new_off", F.lit(start).cast("long") + F.col("new_off"))


def copy_ranges(blocks: DataFrame, bad: DataFrame, container: str) -> DataFrame:
    """Runs of good blocks as single copies: (container, first, blocks, old_off, new_off, size)."""
    good = blocks.join(bad.select(container, "idx").distinct(), [container, "idx"], "left_anti")
    ranked = sum_before(good.withColumn("_one", F.lit(1)), container, "idx", "_one", "_rank")
    return ranked.withColumn("_run", F.col("idx") - F.col("_rank")).groupBy(container, "_run").agg(F.min("idx").alias("first"), F.count("*").alias("blocks"), F.min("old_off").alias("old_off"), F.min("new_off").alias("new_off"), F.sum("new_len").alias("size")).drop("_run")


def apply_strategy(blocks: DataFrame, container: str) -> DataFrame:
    """How unchanged blocks move: overwrite (none), left, right or mixed."""
    left, right = F.bool_or(F.col("new_off") < F.col("old_off")), F.bool_or(F.col("new_off") > F.col("old_off"))
    return blocks.groupBy(container).agg(F.when(left & right, "mixed").when(left, "left").when(right, "right").otherwise("overwrite").alias("strategy"))


def changed_blocks(patches: DataFrame, container: str, block: int = BLOCK) -> DataFrame:
    return overlaps(patches, container, block).select(container, "idx").distinct()


def patched(blocks: DataFrame, patches: DataFrame, container: str, block: int = BLOCK) -> DataFrame:
    """Blocks that patches (off, size, bytes, seq) change, with the new data; later patches win byte by byte. What lies beyond
    a block's own bytes is dropped: a patch never lengthens content."""
    part = overlaps(patches, container, block)
    part = part.select(container, "idx", "seq", (F.col("lo") - F.col("idx") * block).alias("at"), F.substring("bytes", (F.col("lo") - F.col("off") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("piece"))
    edits = part.groupBy(container, "idx").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "piece"))).alias("edits"))
    rows = blocks.join(edits, [container, "idx"])

    def edit(data: Column, e: Column) -> Column:
        at, n = e["at"].cast("int"), F.octet_length(e["piece"])
        new = F.concat(F.substring(data, F.lit(1), at), e["piece"], F.substring(data, at + n + 1, F.lit(block)))
        return F.when(at < F.octet_length(data), F.substring(new, F.lit(1), F.octet_length(data))).otherwise(data)

    return rows.withColumn("data", F.aggregate("edits", F.col("data"), edit)).drop("edits")


def virtual_blocks(segments: DataFrame, totals: DataFrame, container: str, block: int = BLOCK) -> DataFrame:
    """(container, idx, data): an image of ``totals.size`` bytes from segments (off, bytes); what none covers is zero."""
    sized = segments.withColumn("size", F.octet_length("bytes").cast("long"))
    part = overlaps(sized, container, block).select(container, "idx", (F.col("lo") - F.col("idx") * block).alias("at"), F.substring("bytes", (F.col("lo") - F.col("off") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("piece"))
    pieces = part.groupBy(container, "idx").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    every = totals.filter("size > 0").select(container, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("idx"))
    rows = every.join(pieces, [container, "idx"], "left")
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(block)))

    def paste(data: Column, p: Column) -> Column:
        at, n = p["at"].cast("int"), F.octet_length(p["piece"])
        return F.concat(F.substring(data, F.lit(1), at), p["piece"], F.substring(data, at + n + 1, F.lit(block)))

    whole = F.aggregate(F.coalesce("_p", F.array().cast("array<struct<at:bigint,piece:binary>>")), zeros, paste)
    return rows.select(container, "idx", F.substring(whole, F.lit(1), F.least(F.lit(block).cast("long"), F.col("size") - F.col("idx") * block).cast("int")).alias("data"))


def contiguous(chain: DataFrame, container: str) -> DataFrame:
    """Whether each file's clusters (place, cluster) follow one another."""
    linked = value_before(chain, container, "place", "cluster", "_before")
    return linked.groupBy(container).agg(F.bool_and(F.col("_before").isNull() | (F.col("_before") + 1 == F.col("cluster"))).alias("contiguous"))
