"""Images of an inode table and directory blocks: a writer, and a reader that lists files below the root folder.

Block 0 is the header, then come the blocks of the inode table, then folders and files, each in one run of blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Version, magic, bytes of an inode, kinds of directory entries, mode bits, flag of read-only inodes.
VERSION, MAGIC, INODE = 2, 20130315, 0xA8
FILE, FOLDER, SELF, ABOVE = 2, 3, 4, 5
MODE_FOLDER, MODE_FILE, READ_ALL, READ_ONLY = 0x4000, 0x8000, 0o555, 0x10
_ENTRY = struct.Struct("<IIII")

Read = Callable[[int, int], bytes]


def entry(inode: int, kind: int, name: str) -> bytes:
    """A directory entry, padded to eight bytes with at least one zero after the name."""
    raw = name.encode()
    size = -(-(len(raw) + 17) // 8) * 8
    return (_ENTRY.pack(inode, kind, len(raw), size) + raw).ljust(size, b"\0")


def parse_entries(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(inode, kind, name) up to an entry of size zero or the end."""
    at = 0
    while at + _ENTRY.size <= len(data):
        inode, kind, n, size = _ENTRY.unpack_from(data, at)
        if not size:
            return
        if size < 16 or not 0 < n < 256 or 16 + n > size or at + size > len(data):
            raise ValueError("bad directory entry")
        yield inode, kind, data[at + 16 : at + 16 + n].decode()
        at += size


def _inode(mode: int, links: int, size: int, blocks: int, first: int) -> bytes:
    return (struct.pack("<HHIQQ", mode | READ_ALL, links, READ_ONLY, size, size).ljust(0x60, b"\0") + struct.pack("<Ii", blocks, first)).ljust(INODE, b"\0")


def write_image(files: dict[str, bytes], block: int = 65_536, root: int = 2) -> bytes:
    """Folders are numbered from the root on in order of discovery, then files in path order; an empty file has a block."""
    folders = {"": root}
    rels = sorted(files, key=lambda r: (r.lower(), r))
    for rel in rels:
        parts = rel.split("/")
        for i in range(1, len(parts)):
            folders.setdefault("/".join(parts[:i]), root + len(folders))
    number = {rel: root + len(folders) + i for i, rel in enumerate(rels)}
    above = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    last = lambda p: p.rsplit("/", 1)[-1]
    bodies = {}
    for d, i in folders.items():
        below = sorted((x for x in folders if x and above(x) == d), key=lambda x: (x.lower(), x))
        bodies[i] = b"".join([entry(i, SELF, "."), entry(folders[above(d)] if d else i, ABOVE, ".."), *[entry(folders[x], FOLDER, last(x)) for x in below], *[entry(number[r], FILE, last(r)) for r in rels if above(r) == d]])
    kinds = {i: (MODE_FOLDER, 2 + sum(1 for x in folders if x and above(x) == d)) for d, i in folders.items()} | {number[r]: (MODE_FILE, 1) for r in rels}
    bodies |= {number[r]: files[r] for r in rels}
    count = root + len(bodies)
    per = block // INODE
    table_blocks = -(-count // per)
    at, table, data = 1 + table_blocks, [bytes(INODE)] * count, []
    for i in sorted(bodies):
        n = max(1, -(-len(bodies[i]) // block))
        table[i] = _inode(*kinds[i], len(bodies[i]), n, at)
        data.append(bodies[i].ljust(n * block, b"\0"))
        at += n
    header = struct.pack("<QQ16xIIQQQQ", VERSION, MAGIC, block, 0, 1, count, at, table_blocks).ljust(block, b"\0")
    pages = b"".join(b"".join(table[k : k + per]).ljust(block, b"\0") for k in range(0, count, per))
    return header + pages + b"".join(data)


class Reader:
    """Files of an image through a function that reads (offset, length), so raw and packed images read alike."""

    def __init__(self, read: Read):
        head = read(0, 0x48)
        version, magic, self.block, _, _, self.count, _, self.table = struct.unpack("<QQ16xIIQQQQ", head)
        if version != VERSION or magic != MAGIC or not self.block or self.count > self.table * (self.block // INODE):
            raise ValueError("not an inode image")
        self.read = read

    def inode(self, number: int) -> tuple[int, int, int, int]:
        """(mode, size, blocks, first block)."""
        if not 0 <= number < self.count:
            raise ValueError("inode outside the table")
        page, place = divmod(number, self.block // INODE)
        raw = self.read(self.block * (1 + page) + place * INODE, INODE)
        mode, size = struct.unpack_from("<H6xQ", raw)
        return mode, size, *struct.unpack_from("<Ii", raw, 0x60)

    def files(self, root: int = 2) -> Iterator[tuple[str, int, int, int]]:
        """(rel, inode, image offset, size) of all files, folder by folder."""
        waiting, seen = [(root, "")], set()
        while waiting:
            number, above = waiting.pop()
            mode, size, _, first = self.inode(number)
            if not mode & MODE_FOLDER or number in seen:
                raise ValueError("not a folder, or one within itself")
            seen.add(number)
            for child, kind, name in parse_entries(self.read(first * self.block, size)):
                if name in (".", ".."):
                    continue
                if kind == FOLDER:
                    waiting.append((child, f"{above}{name}/"))
                elif kind == FILE:
                    _, n, _, start = self.inode(child)
                    yield above + name, child, start * self.block, n
                else:
                    raise ValueError("unknown kind of entry")


def list_images(images: DataFrame) -> DataFrame:
    """(image, rel, inode, image_offset, size) from (image, content): images are read where they are, one row at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, *f) for name, content in zip(b["image"], b["content"], strict=True) for f in Reader(lambda o, n, c=bytes(content): c[o : o + n]).files()]
            yield pd.DataFrame(rows, columns=["image", "rel", "inode", "image_offset", "size"])

    return images.select("image", "content").mapInPandas(run, "image string, rel string, inode long, image_offset long, size long")
