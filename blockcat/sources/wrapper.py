"""The outer image around a block container: an inode image of one file, whose inode says that it is compressed.

Six blocks come first: header, inodes (super root, path table, root folder, the file), the super root's entries, the path
table, a block for collisions (empty), and the root folder's entries. Then the container, padded to whole blocks.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockcat.sources import inodes

# The file's usual name, blocks before it, its inode and the root folder's, flags, and permissions of all.
NAME, BEFORE, FILE_INODE, ROOT_INODE = "pfs_image.dat", 6, 3, 2
COMPRESSED, READ_ONLY, INTERNAL, ALL = 0x1, 0x10, 0x20000, 0o777
FOLDS_CASE = 0x8

Read = Callable[[int, int], bytes]


def path_hash(path: str) -> int:
    h = 0
    for c in path.encode().upper():
        h = (c + 31 * h) % (1 << 32)
    return h


def _inode(mode: int, links: int, flags: int, size: int, content: int, blocks: int, first: int, made: int, root: bool = False) -> bytes:
    raw = bytearray(inodes.INODE)
    struct.pack_into("<HHIQQ4Q", raw, 0, mode | ALL, links, flags, size, content, made, made, made, made)
    struct.pack_into("<Ii", raw, 0x60, blocks, first)
    if not root:  # places of further runs that there are none of
        struct.pack_into("<11i5i", raw, 0x68, *[-1] * 16)
    return bytes(raw)


def head(stored: int, content: int, name: str = NAME, block: int = 65_536, made: int = 0) -> bytes:
    """The six blocks before a container of ``stored`` bytes whose content has ``content`` bytes."""
    blocks = max(1, -(-stored // block))
    top = bytearray(block)
    struct.pack_into("<QQQ4BHHIIQQQQ", top, 0, inodes.VERSION, inodes.MAGIC, 0, 0, 0, 1, 0, FOLDS_CASE, 0, block, 0, 1, 4, BEFORE + blocks, 1)
    struct.pack_into("<HHIQQ4Q", top, 0x50, 0, 1, READ_ONLY, block, block, made, made, made, made)
    struct.pack_into("<I", top, 0x50 + 0x60, 1)
    struct.pack_into("<Q", top, 0x50 + 0x68 + 32, 1)
    struct.pack_into("<I", top, 0x368, 1)
    table = b"".join([
        _inode(inodes.MODE_FOLDER, 1, INTERNAL | READ_ONLY, block, block, 1, 2, made, root=True),
        _inode(inodes.MODE_FILE, 1, INTERNAL | READ_ONLY, 8, 8, 1, 3, made),
        _inode(inodes.MODE_FOLDER, 3, READ_ONLY, block, block, 1, 5, made),
        _inode(inodes.MODE_FILE, 1, READ_ONLY | COMPRESSED, stored, content, blocks, BEFORE, made),
    ])
    above = inodes.entry(1, inodes.FILE, "flat_path_table") + inodes.entry(ROOT_INODE, inodes.FOLDER, "uroot")
    paths = struct.pack("<II", path_hash(f"/{name}"), FILE_INODE)
    root = inodes.entry(ROOT_INODE, inodes.SELF, ".") + inodes.entry(ROOT_INODE, inodes.ABOVE, "..") + inodes.entry(FILE_INODE, inodes.FILE, name)
    return b"".join(x.ljust(block, b"\0") for x in (bytes(top), table, above, paths, b"", root))


def is_wrapped(first: bytes) -> bool:
    return len(first) >= 16 and struct.unpack_from("<QQ", first) == (inodes.VERSION, inodes.MAGIC)


def inner(read: Read) -> tuple[int, int, int, str, int]:
    """(where the container begins, its bytes, bytes of its content, its name, block) of a wrapped image; raises if there is none."""
    top = read(0, 0x48)
    if not is_wrapped(top):
        raise ValueError("not a wrapped container")
    (block,) = struct.unpack_from("<I", top, 0x20)
    flags, stored, content = struct.unpack_from("<4xIQQ", raw := read(block + FILE_INODE * inodes.INODE, inodes.INODE))
    (first,) = struct.unpack_from("<i", raw, 0x64)
    if not block or len(raw) < inodes.INODE or not flags & COMPRESSED or first < 0:
        raise ValueError("no compressed file in the image")
    folder = read(block + ROOT_INODE * inodes.INODE, inodes.INODE)
    mode, size = struct.unpack_from("<H6xQ", folder)
    (at,) = struct.unpack_from("<i", folder, 0x64)
    name = NAME
    if mode & inodes.MODE_FOLDER and at >= 0 and 0 < size <= block:
        name = next((n for i, kind, n in inodes.parse_entries(read(at * block, size)) if i == FILE_INODE and kind == inodes.FILE), NAME)
    return first * block, stored, content, name, block


def slack(read: Read, size: int) -> list[tuple[int, int]]:
    """(offset, length) of the bytes of a wrapped image of ``size`` bytes that hold nothing and should be zero."""
    start, stored, _, _, block = inner(read)
    if start != BEFORE * block:
        raise ValueError("the file isn't where it should be")

    def used(at: int) -> int:
        data = read(at * block, block)
        return sum(-(-(len(n.encode()) + 17) // 8) * 8 for _, _, n in inodes.parse_entries(data))

    ends = [(2 * block + used(2), 3 * block), (3 * block + 8, 4 * block), (4 * block, 5 * block), (5 * block + used(5), 6 * block), (start + stored, size)]
    return [(a, z - a) for a, z in ends if z > a]


def slack_report(spark: SparkSession, folder: str) -> DataFrame:
    """(container, off, size, dirty): the ranges of wrapped images that should be zero, and how many bytes are not. Only those
    ranges and the metadata are read; the folder must be visible to all executors."""
    paths = sorted(p for p in glob.glob(os.path.join(folder, "*")) if os.path.isfile(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                with open(path, "rb") as f:

                    def read(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    for at, n in slack(read, os.path.getsize(path)):
                        rows.append((os.path.basename(path), at, n, n - read(at, n).count(0)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["container", "off", "size", "dirty"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInArrow(run, "container string, off long, size long, dirty long")
