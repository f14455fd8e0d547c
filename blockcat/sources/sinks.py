"""Sinks: history appends, reports, hash sidecars, block containers."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators.blocks import inflate
from blockcat.operators.shared import partitions
from blockcat.sources import wrapper
from blockcat.sources.blockstore import header, header_span


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_bad_blocks(rows: DataFrame, path: str) -> None:
    """Tab-separated report with a header."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_sidecar(hashes: DataFrame, path: str, container: str = "container") -> None:
    """Block hashes as a table, laid out by container and block."""
    hashes.repartitionByRange(container, "idx").sortWithinPartitions(container, "idx").write.mode("overwrite").parquet(path)


def _streamed(folder: str, begin, write, finish):
    """Batches sorted by container and place, each container's rows streamed to a temporary file that is renamed when it is
    whole; a repeated task writes the same file anew. One block is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: str | None = None
        file, state = None, None

        def close() -> pa.RecordBatch:
            size = finish(file, state)
            file.close()
            os.replace(file.name, os.path.join(folder, own))
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([size], type=pa.int64())], names=["container", "bytes"])

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names = b.column("container").to_pylist()
            for k, name in enumerate(names):
                if name != own:
                    if own is not None:
                        yield close()
                    own = name
                    if "/" in own or own in ("", ".", ".."):
                        raise ValueError(f"not a file name: {own!r}")
                    file = open(os.path.join(folder, f".{own}.{uuid.uuid4().hex}.tmp"), "wb")
                    state = begin(file, b, k)
                write(file, state, b, k)
        if own is not None:
            yield close()

    return run


def write_containers(blocks: DataFrame, folder: str, block: int, wrapped: bool = False) -> DataFrame:
    """One container file for each ``container`` of (container, idx, stored, size), streamed block by block behind a header
    that is filled in at the end; ``wrapped`` puts it into an outer image. The folder must be visible to all executors.
    Returns (container, bytes)."""
    before = wrapper.BEFORE * block if wrapped else 0

    def begin(file, b: pa.RecordBatch, k: int) -> list[int]:
        size = b.column("size")[k].as_py()
        start = header_span(-(-size // block), block)
        file.seek(before + start)
        return [size, start]

    def write(file, state: list[int], b: pa.RecordBatch, k: int) -> None:
        data = b.column("stored")[k].as_py()
        if not 0 < len(data) <= block:
            raise ValueError("a stored block is empty or too long")
        file.write(data)
        state.append(state[-1] + len(data))

    def finish(file, state: list[int]) -> int:
        size, *offsets = state
        if wrapped:
            file.write(bytes(-offsets[-1] % block))
        file.seek(0)
        if wrapped:
            file.write(wrapper.head(offsets[-1], size, block=block))
        file.write(header(offsets, block, size))
        return before + (offsets[-1] + -offsets[-1] % block if wrapped else offsets[-1])

    rows = blocks.select(F.col("container").cast("string").alias("container"), "idx", "stored", F.col("size").cast("long").alias("size"))
    return rows.repartition(partitions(blocks.sparkSession), "container").sortWithinPartitions("container", "idx").mapInArrow(_streamed(folder, begin, write, finish), "container string, bytes long")


def write_bodies(blocks: DataFrame, folder: str, block: int) -> DataFrame:
    """Packed blocks (container, idx, len, stored) inflated into one file for each container, of any size. Returns (container, bytes)."""

    def write(file, state: list[int], b: pa.RecordBatch, k: int) -> None:
        data, error = inflate(b.column("stored")[k].as_py(), block)
        if error:
            raise ValueError(f"{b.column('container')[k].as_py()}, block {b.column('idx')[k].as_py()}: {error}")
        state[0] += file.write(data[: b.column("len")[k].as_py()])

    rows = blocks.select(F.col("container").cast("string").alias("container"), "idx", F.col("len").cast("long").alias("len"), "stored")
    return rows.repartition(partitions(blocks.sparkSession), "container").sortWithinPartitions("container", "idx").mapInArrow(_streamed(folder, lambda file, b, k: [0], write, lambda file, state: state[0]), "container string, bytes long")


# The binary form of the hash sidecar: its magic, version, bytes of its header, and the number of its digest (SHA-256).
SIDECAR_MAGIC, SIDECAR_VERSION, SIDECAR_HEAD, SIDECAR_SHA256 = b"PFSCVHS1", 1, 4096, 1
_SIDECAR = struct.Struct("<8sIIQQQQII")


def sidecar_bytes(digests: list[bytes], block: int, logical: int, nested: int, kind: int = 0) -> bytes:
    """The binary hash sidecar of one container: a header, then 32 bytes a block."""
    return _SIDECAR.pack(SIDECAR_MAGIC, SIDECAR_VERSION, SIDECAR_HEAD, block, logical, nested, len(digests), kind, SIDECAR_SHA256).ljust(SIDECAR_HEAD, b"\0") + b"".join(digests)


def read_sidecars(files: DataFrame, stored: DataFrame, block: int) -> DataFrame:
    """(container, mode, digests) of binary sidecars (container, content) for containers (container, blocks, logical, nested):
    missing, invalid (cut off, or not a sidecar of this form), stale (of other sizes) or used; digests only where they are used."""
    c = F.col("content")
    number = lambda at, width: S.little_endian(c, at, width).cast("long")
    form = (F.substring(c, 1, 8) == F.lit(SIDECAR_MAGIC)) & (number(8, 4) == SIDECAR_VERSION) & (number(12, 4) == SIDECAR_HEAD) & (number(16, 8) == block) & (number(52, 4) == SIDECAR_SHA256)
    side = files.select(F.col("container").alias("_c"), F.coalesce(form, F.lit(False)).alias("_form"), number(24, 8).alias("_logical"), number(32, 8).alias("_nested"), number(40, 8).alias("_blocks"), c.alias("_content"))
    rows = stored.join(side, F.col("container") == F.col("_c"), "left")
    cut = F.octet_length("_content") < F.col("blocks") * 32 + SIDECAR_HEAD
    stale = (F.col("_blocks") != F.col("blocks")) | (F.col("_logical") != F.col("logical")) | (F.col("_nested") != F.col("nested"))
    mode = F.when(F.col("_c").isNull(), "missing").when(cut | ~F.col("_form"), "invalid").when(stale, "stale").otherwise("used")
    at = F.when(F.col("blocks") > 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array().cast("array<bigint>"))
    digests = F.when(mode == "used", F.transform(at, lambda i: F.lower(F.hex(F.substring(F.col("_content"), (i * 32 + SIDECAR_HEAD + 1).cast("int"), F.lit(32))))))
    return rows.select("container", mode.alias("mode"), digests.alias("digests"))


def repair_summary(counts: DataFrame) -> DataFrame:
    """(container, summary): one JSON object a container from its counters (see ``plans.pipelines.outcome``)."""
    status = F.when(F.col("bad") > 0, "bad-blocks").otherwise("ok")
    fields = F.struct(status.alias("status"), F.col("container").cast("string").alias("path"), F.col("checked").alias("scannedBlocks"), F.col("matched").alias("matchedBlocks"), F.col("hash_mismatched").alias("hashMismatchedBlocks"), F.col("bad").alias("rawMismatches"), (F.col("bad") == 0).alias("noop"))
    return counts.select("container", F.to_json(fields).alias("summary"))


def patch_request(packed: DataFrame, bad: DataFrame, block: int) -> DataFrame:
    """(container, request): JSON of what a repair has to bring: sizes, and place and lengths of each bad block (container, idx)."""
    mark = bad.select("container", "idx").distinct().withColumn("_bad", F.lit(True))
    rows = packed.select("container", "idx", "off", "stored_len").join(mark, ["container", "idx"], "left")
    entry = F.struct(F.col("idx").alias("block"), F.col("off").alias("storedOffset"), F.col("stored_len").alias("storedLength"), F.lit(block).alias("rawLength"))
    sums = rows.groupBy("container").agg(F.count("*").alias("n"), F.sum("stored_len").alias("old"), F.sum(F.when(F.col("_bad"), F.lit(block)).otherwise(F.col("stored_len"))).alias("new"), F.array_sort(F.collect_list(F.when(F.col("_bad"), entry))).alias("bad"))
    fields = F.struct(F.col("container").cast("string").alias("path"), F.lit(block).alias("blockSize"), (F.col("n") * block).alias("nestedSize"), F.col("n").alias("blockCount"), F.col("old").alias("oldStoredSize"), F.col("new").alias("newStoredSize"), F.col("bad").alias("badBlocks"))
    return sums.filter(F.size("bad") > 0).select("container", F.to_json(fields).alias("request"))


def upsert_markers(old: DataFrame, new: DataFrame, key: list[str], carry: Sequence[str] = ()) -> DataFrame:
    """Old rows whose key isn't new, and the new ones; of those in ``carry``, what a new row doesn't say is taken from the old one."""
    before = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in carry])
    rows = new.join(before, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in carry else F.col(c) for c in new.columns])
    return old.join(new.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
