"""Token ids in binary files of patched frame-of-reference blocks.

A file holds up to ``SEGMENTS`` segments, each followed by a line feed. A segment, all integers little-endian:

    magic "BCTOK1\\0\\0" | u64 partition | u64 number in it | u64 documents | u64 ids | u64 blocks | u64 exceptions
    documents x (i64 doc_id, u64 its ids; bit 63 of the latter set for a null doc_id)
    blocks x (u64 where the block's payload starts, u32 minimum, u8 width, u8 exceptions, u16 zero)
    exceptions x u8 place in the block | exceptions x u32 value less the minimum
    payloads: BLOCK values of ``width`` bits each, lowest bit first

A block is ``BLOCK`` consecutive ids of the segment (the last one is filled up with its own minimum). Its minimum is
taken off; the width is that of the value at the given percentile; larger values go to the exception list and are
packed as zero. The block index gives random access: to read ids from place p on, start at block p // BLOCK.

Documents are range-partitioned by doc_id (boundaries from a quantile sketch of that column alone), so only ids cross
the shuffle, two bytes each where the vocabulary allows. Each task sorts its documents and cuts segments. Spark's text
writer writes them: it passes bytes through as they are (a cast from binary checks nothing) and ends each with a line feed; it
works in any store that Spark can write, and commits a task's files only once. No codec is applied, whatever the session says.
``binaryFile`` reads them, a file of some 32 MB at a time. File names ascend with doc_id, as do (partition, number) in the headers.

Defined cases: null and empty texts are the end id alone; a long text is encoded whole and never split over segments; a repeated
doc_id is written as often (in order of its ids' crc); null doc_ids come first; an empty table gives files without documents
or none; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockcat.llm.common import partitions, small, stored, text_bytes
from blockcat.llm.tokens import after_encoding, encoder, slices

MAGIC = b"BCTOK1\0\0"
BLOCK = 128
#: Ids in a segment before the next one begins (a longer document is a segment of its own).
SEGMENT_IDS = 2_000_000
#: Segments in a file.
SEGMENTS = 8
PERCENTILE = 90
_HEAD = struct.Struct("<8s6Q")
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u8")])
_INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("zero", "<u2")])
_NULL = np.uint64(1 << 63)
#: Blocks packed at once, which bounds the words in memory.
_AT_ONCE = 4096
#: Bytes that ``BLOCK`` values have for each bit of their width.
_UNIT = BLOCK // 8


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value: 0 for 0."""
    return np.where(x == 0, 0, np.frexp(x.astype(np.float64))[1]).astype(np.uint8)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(index, exception places, exception values, payloads) of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, _INDEX), np.zeros(0, np.uint8), np.zeros(0, "<u4"), b""
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    k = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = _bits(np.partition(rest, k, axis=1)[:, k])
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    rows, places = np.nonzero(over)
    index = np.zeros(n, _INDEX)
    index["low"], index["width"], index["exceptions"] = low, width, over.sum(axis=1)
    sizes = width.astype(np.int64) * _UNIT
    index["start"] = np.cumsum(sizes) - sizes
    values = rest[rows, places].astype("<u4")
    rest[over] = 0
    out = np.empty((int(sizes.sum()) // _UNIT, _UNIT // 8), dtype="<u8")
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for i in range(0, len(own), _AT_ONCE):
            some = own[i : i + _AT_ONCE]
            columns, words = np.ascontiguousarray(rest[some].T, dtype=np.uint64), np.zeros((w * BLOCK // 64, len(some)), dtype=np.uint64)
            for j, v in enumerate(columns):
                at, shift = divmod(j * w, 64)
                words[at] |= v << np.uint64(shift)
                if shift + w > 64:
                    words[at + 1] |= v >> np.uint64(64 - shift)
            out[(index["start"][some].astype(np.int64)[:, None] // _UNIT + np.arange(w)).reshape(-1)] = words.T.reshape(-1, _UNIT // 8)
    return index, places.astype(np.uint8), values, out.tobytes()


def decode_blocks(index: np.ndarray, places: np.ndarray, values: np.ndarray, payload: bytes) -> np.ndarray:
    n = len(index)
    full, data = np.zeros((n, BLOCK), dtype=np.uint32), np.frombuffer(payload, dtype="<u8").reshape(-1, _UNIT // 8)
    for w in np.unique(index["width"][index["width"] > 0]).tolist():
        own = np.flatnonzero(index["width"] == w)
        for i in range(0, len(own), _AT_ONCE):
            some = own[i : i + _AT_ONCE]
            words = np.ascontiguousarray(data[index["start"][some].astype(np.int64)[:, None] // _UNIT + np.arange(w)].reshape(len(some), -1).T)
            columns = np.empty((BLOCK, len(some)), dtype=np.uint32)
            for j in range(BLOCK):
                at, shift = divmod(j * w, 64)
                v = words[at] >> np.uint64(shift)
                if shift + w > 64:
                    v |= words[at + 1] << np.uint64(64 - shift)
                columns[j] = v & np.uint64((1 << w) - 1)
            full[some] = columns.T
    full[np.repeat(np.arange(n), index["exceptions"]), places] = values
    return (full + index["low"][:, None]).reshape(-1)


def encode_segment(part: int, number: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    docs = np.zeros(len(doc_ids), _DOC)
    docs["doc_id"] = [0 if d is None else d for d in doc_ids]
    docs["n"] = np.array(counts, dtype=np.uint64) | np.array([_NULL if d is None else 0 for d in doc_ids], dtype=np.uint64)
    index, places, values, payload = encode_blocks(ids)
    return b"".join([_HEAD.pack(MAGIC, part, number, len(docs), len(ids), len(index), len(places)), docs.tobytes(), index.tobytes(), places.tobytes(), values.tobytes(), payload])


def decode_segment(data: bytes, at: int = 0) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray, int]:
    """(partition, number, doc_ids, ids in each, all ids, where the segment ends) of the segment that begins at ``at``."""
    magic, part, number, n_docs, n_ids, n_blocks, n_ex = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at += _HEAD.size

    def take(kind: np.dtype, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    docs, index, places, values = take(_DOC, n_docs), take(_INDEX, n_blocks), take(np.dtype(np.uint8), n_ex), take(np.dtype("<u4"), n_ex)
    null = (docs["n"] & _NULL) != 0
    size = int(index["start"][-1]) + int(index["width"][-1]) * BLOCK // 8 if n_blocks else 0
    ids = decode_blocks(index, places, values, data[at : at + size])[:n_ids]
    return part, number, [None if z else d for d, z in zip(docs["doc_id"].tolist(), null.tolist(), strict=True)], (docs["n"] & ~_NULL).astype(np.int64), ids, at + size


def segments_of(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """The segments of a file."""
    at = 0
    while at < len(data):
        *segment, end = decode_segment(data, at)
        if bytes(data[end : end + 1]) != b"\n":
            raise ValueError("a segment is cut off or too long")
        yield tuple(segment)
        at = end + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408, segment_ids: int = SEGMENT_IDS) -> None:
    """The ids of all ``docs`` as files under ``path``, in ascending doc_id order."""
    parts, kind = partitions(docs.sparkSession), "<u2" if max(vocabulary, end_id + 1) <= 65_536 else "<u4"
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            known = b.column("doc_id")
            part = np.searchsorted(bounds, known.fill_null(-(2**63)).to_numpy(zero_copy_only=False))
            raw = [ids + end for ids in enc.encode(text_bytes(b.column("text")))]
            crc = [zlib.crc32(x) for x in raw]
            if kind == "<u2":
                raw = [np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() for x in raw]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), known, pa.array(crc, type=pa.int64()), pa.array(raw, type=pa.binary())], names=["part", "doc_id", "crc", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, n, number
            data = encode_segment(part, number, names, [len(x) for x in held], np.concatenate(held).astype(np.uint32))
            names, held, n, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([data], type=pa.binary())], names=["segment"])

        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype=kind)
                if held and n + len(ids) > segment_ids:
                    yield flush()
                names.append(doc)
                held.append(ids.copy())
                n += len(ids)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, "part int, doc_id long, crc long, ids binary")
    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "crc").select("doc_id", "ids")
    placed.mapInArrow(after_encoding(segments), "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS).option("compression", "none").option("lineSep", "\n").mode("overwrite").text(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the files under ``path``, decoded; start counts the ids of all documents before."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                for segment in segments_of(memoryview(data.as_buffer())):
                    yield rows_of(*segment)

    def rows_of(part: int, number: int, names: list[int | None], counts: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        raw = flat.astype("<u4").tobytes()
        ends = np.cumsum(counts)
        spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
        n = len(names)
        cols = [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(names, type=pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in spans], type=pa.int64())]
        fields = ["part", "number", "doc_id", "place", "n_tokens", "ids_crc32"]
        if ids:
            cols.append(pa.array([flat[a:z].astype(np.int32) for a, z in spans], type=pa.list_(pa.int32())))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=fields)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    kinds = "part long, number long, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = stored(files.select("content").mapInArrow(after_encoding(decode), kinds), "read-back")
    # offsets in two steps: of segments in their partition, of partitions
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    ahead = Window.orderBy("part").partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.groupBy("part").agg(F.sum("size").alias("size")).select("part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(whole, "part").select("part", "number", (F.col("first") + F.col("ahead")).alias("base"))
    out = rows.join(small(stored(base, "segment-starts")), ["part", "number"])
    return out.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
