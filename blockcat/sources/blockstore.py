"""Block containers: a header, a table of offsets, then the stored blocks.

A block stored at its full size is raw; a shorter one is deflated. ``pack`` makes a container from encoded blocks,
``BlockStore`` reads containers as a data source (a row per block), checking magic, sizes and the order of offsets. A container
(within an outer image or not) is read by as many tasks as it has runs of ``RUN`` blocks; each reads its part of the table and its bytes. Containers of
one run share tasks, so many small ones are not as many tasks.
"""

from __future__ import annotations

import glob
import os
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockcat.sources.wrapper import inner, is_wrapped

# The header's magic number, its version words, and where the table of offsets begins.
MAGIC, ZERO, VERSION, TABLE = 0x43534650, 0, 6, 0x400
_HEAD = struct.Struct("<IIIIQQQQ")

#: Blocks that one task reads.
RUN = 4096

SCHEMA = "container string, idx long, off long, stored_len long, is_raw boolean, stored binary"


def header_span(blocks: int, block: int) -> int:
    """Bytes before the data: one block, and whole ones for offsets that don't fit it."""
    over = max(0, 8 * (blocks + 1) - (block - TABLE))
    return block + -(-over // block) * block


def header(offsets: Sequence[int], block: int, size: int) -> bytes:
    """What stands before the data: the header and the table of offsets (the first is where the data begins)."""
    head = _HEAD.pack(MAGIC, ZERO, VERSION, block, block, TABLE, offsets[0], size)
    table = array("Q", offsets)
    return (head.ljust(TABLE, b"\0") + (table if sys.byteorder == "little" else table.byteswap() or table).tobytes()).ljust(offsets[0], b"\0")


def pack(stored: Sequence[bytes], block: int, size: int) -> bytes:
    """A container of stored blocks in order; ``size`` is that of the content."""
    offsets = [header_span(len(stored), block)]
    for s in stored:
        if not 0 < len(s) <= block:
            raise ValueError("a stored block is empty or too long")
        offsets.append(offsets[-1] + len(s))
    return header(offsets, block, size) + b"".join(stored)


def read_header(data: bytes) -> tuple[int, int, int]:
    """(block, content size, where the data begins) of a container's first bytes; raises if it isn't one."""
    if len(data) < _HEAD.size:
        raise ValueError("too short")
    magic, _, version, block, wide, table, start, size = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or block != wide or not block or table != TABLE:
        raise ValueError("not a block container")
    if start != header_span(-(-size // block), block):
        raise ValueError("bad header")
    return block, size, start


def _table(data: bytes, first: int) -> list[int]:
    """Offsets from a part of the table; raises if they are out of order."""
    offsets = list(struct.unpack(f"<{len(data) // 8}Q", data))
    if any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError(f"offsets are out of order after block {first}")
    return offsets


def read_offsets(data: bytes) -> tuple[int, int, list[int]]:
    """(block, content size, offsets) of a container's beginning; raises if it isn't one."""
    if len(data) < TABLE:
        raise ValueError("too short")
    block, size, start = read_header(data)
    n = -(-size // block)
    if len(data) < TABLE + 8 * (n + 1):
        raise ValueError("bad header")
    offsets = _table(data[TABLE : TABLE + 8 * (n + 1)], 0)
    if offsets[0] != start:
        raise ValueError("offsets are out of order")
    return block, size, offsets


class Blocks:
    """A run of a container's blocks; ``at`` is where the container begins in its file."""

    def __init__(self, path: str, first: int, count: int, at: int = 0):
        self.path, self.first, self.count, self.at = path, first, count, at


class Runs(InputPartition):
    """What one task reads: runs of one or more containers."""

    def __init__(self, runs: list[Blocks]):
        self.runs = runs


def _shared(whole: Iterable[Blocks], most: int) -> list[Runs]:
    """Containers of one run, so many to a task as have at most ``most`` blocks together."""
    out: list[Runs] = []
    filled = 0
    for x in whole:
        if not out or filled + x.count > most:
            out.append(Runs([]))
            filled = 0
        out[-1].runs.append(x)
        filled += x.count
    return out


class BlockStoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"], int(options.get("blocks", RUN))

    def partitions(self) -> list[Runs]:
        """Runs of blocks of every container, from its header alone."""
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        parts, whole = [], []
        for path in found:
            if os.path.isfile(path):
                with open(path, "rb") as f:

                    def at(offset: int, length: int) -> bytes:
                        f.seek(offset)
                        return f.read(length)

                    begin = inner(at)[0] if is_wrapped(at(0, 16)) else 0
                    block, size, _ = read_header(at(begin, _HEAD.size))
                n = -(-size // block)
                if n <= self.run:
                    whole.append(Blocks(path, 0, n, begin))
                else:
                    parts += [Runs([Blocks(path, i, min(self.run, n - i), begin)]) for i in range(0, n, self.run)]
        return parts + _shared((x for x in whole if x.count), max(self.run, RUN))

    def read(self, part: Runs) -> Iterator[tuple]:
        for run in part.runs:
            yield from self._read(run)

    def _read(self, part: Blocks) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.at)
            block, _, start = read_header(f.read(_HEAD.size))
            f.seek(part.at + TABLE + 8 * part.first)
            table = f.read(8 * (part.count + 1))
            if len(table) < 8 * (part.count + 1):
                raise ValueError("bad header")
            offsets = _table(table, part.first)
            if part.first == 0 and offsets[0] != start:
                raise ValueError("offsets are out of order")
            f.seek(part.at + offsets[0])
            for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False), part.first):
                stored = f.read(b - a)
                if len(stored) != b - a or b - a > block:
                    raise ValueError(f"block {i} is cut off or too long")
                yield os.path.basename(part.path), i, a, b - a, b - a == block, stored


class BlockStore(DataSource):
    """``spark.read.format("blockcat_blocks").load("/folder")``"""

    @classmethod
    def name(cls) -> str:
        return "blockcat_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockStoreReader:
        return BlockStoreReader(self.options)
