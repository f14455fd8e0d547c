"""exFAT images: a writer that lays files out one after the other, and a reader as a data source (a row per entry)."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SECTOR = 512
# Fixed values of the format: entry types, attributes, flags, chain ends.
BITMAP, UPCASE, FILE, STREAM, NAME = 0x81, 0x82, 0x85, 0xC0, 0xC1
FOLDER, ARCHIVE, POSSIBLE, NO_CHAIN, END, MEDIA = 0x10, 0x20, 1, 2, 0xFFFFFFFF, 0xFFFFFFF8

SCHEMA = "image string, rel string, is_dir boolean, first_cluster long, image_offset long, size long, contiguous boolean"

Read = Callable[[int, int], bytes]


def rotated_sum(data: bytes, bits: int, skip: tuple[int, ...] = ()) -> int:
    """Sum of bytes, the total turned right by one bit before each."""
    total, top = 0, 1 << bits
    for i, b in enumerate(data):
        if i not in skip:
            total = ((total >> 1) + (total & 1) * (top >> 1) + b) % top
    return total


def _upper(name: str) -> str:
    return "".join(c.upper() if "a" <= c <= "z" else c for c in name)


def _entry_set(name: str, folder: bool, cluster: int, size: int) -> bytes:
    raw = name.encode("utf-16-le")
    names = -(-len(raw) // 30)
    stream = struct.pack("<BBBBHHQIIQ", STREAM, POSSIBLE | NO_CHAIN if cluster else 0, 0, len(raw) // 2, rotated_sum(_upper(name).encode("utf-16-le"), 16), 0, size, 0, cluster, size)
    parts = b"".join(struct.pack("<BB30s", NAME, 0, raw[i * 30 : i * 30 + 30]) for i in range(names))
    head = struct.pack("<BBHH26x", FILE, 1 + names, 0, FOLDER if folder else ARCHIVE)
    return struct.pack("<BBH", FILE, 1 + names, rotated_sum(head + stream + parts, 16, (2, 3))) + head[4:] + stream + parts


def bitmap_clusters(used: int, cluster: int, spare: int = 0) -> tuple[int, int]:
    """(clusters of the allocation bitmap, all clusters): the bitmap's own clusters need bits too, so they are found in rounds."""
    own = 0
    while (need := -(-(-(-(used + own + spare) // 8)) // cluster)) != own:
        own = need
    return own, used + own + spare


def write_image(files: dict[str, bytes], cluster: int = 4096, spare: int = 4) -> bytes:
    """An image of files by relative path; folders are made as needed, every file lies in one run of clusters."""
    tree: dict[str, list[str]] = {"": []}
    for rel in sorted(files):
        parts = rel.split("/")
        for i in range(1, len(parts) + 1):
            up, here = "/".join(parts[: i - 1]), "/".join(parts[:i])
            if here not in tree[up]:
                tree[up].append(here)
            if i < len(parts):
                tree.setdefault(here, [])
    upcase = struct.pack("<HH", 0xFFFF, 0x61) + b"".join(struct.pack("<H", c - 32) for c in range(0x61, 0x7B)) + struct.pack("<HH", 0xFFFF, 0xFF85)
    sets = lambda d: sum(64 + 32 * -(-len(x.rsplit("/", 1)[-1].encode("utf-16-le")) // 30) for x in tree[d])
    whole = lambda n: -(-n // cluster)
    used = whole(len(upcase)) + sum(max(1, whole(sets(d) + 64 * (d == ""))) for d in tree) + sum(whole(len(x)) for x in files.values())
    bitmap, total = bitmap_clusters(used, cluster, spare)
    place, at = {}, 2 + bitmap
    place["upcase"], at = at, at + whole(len(upcase))
    for d in tree:
        place[f"d{d}"], at = at, at + max(1, whole(sets(d) + 64 * (d == "")))
    for rel, body in sorted(files.items()):
        if body:
            place[f"f{rel}"], at = at, at + whole(len(body))
    taken = at - 2
    heap: dict[int, bytes] = {2: bytes(sum(1 << b for b in range(8) if i * 8 + b < taken) for i in range(-(-total // 8))), place["upcase"]: upcase}
    for d in tree:
        out = b""
        if d == "":
            bits = -(-total // 8)
            out += struct.pack("<BB18xIQ", BITMAP, 0, 2, bits) + struct.pack("<B3xI12xIQ", UPCASE, rotated_sum(upcase, 32), place["upcase"], len(upcase))
        for x in tree[d]:
            folder = x in tree
            size = max(1, whole(sets(x))) * cluster if folder else len(files[x])
            out += _entry_set(x.rsplit("/", 1)[-1], folder, place[f"d{x}"] if folder else place.get(f"f{x}", 0), size)
        heap[place[f"d{d}"]] = out
    heap |= {place[f"f{rel}"]: body for rel, body in files.items() if body}
    fat_at, fat_len = 24, -(-(total + 2) * 4 // SECTOR)
    heap_at = fat_at + fat_len
    per = cluster // SECTOR
    length = heap_at + total * per
    boot = b"\xeb\x76\x90EXFAT   " + bytes(53) + struct.pack("<QQIIIIIIHHBBBBB", 0, length, fat_at, fat_len, heap_at, total, place["d"], 1, 0x100, 0, 9, per.bit_length() - 1, 1, 0x80, 0)
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    region = boot + (bytes(508) + b"\0\0\x55\xaa") * 8 + bytes(SECTOR * 2)
    region += struct.pack("<I", rotated_sum(region, 32, (106, 107, 112))) * (SECTOR // 4)
    fat = struct.pack("<II", MEDIA, END)
    starts = sorted([2, *place.values()])
    ends = {s - 1 for s in starts if s > 2} | {at - 1}
    fat += b"".join(struct.pack("<I", END if c in ends else c + 1) for c in range(2, at))
    image = bytearray(length * SECTOR)
    image[: 24 * SECTOR] = region * 2
    image[fat_at * SECTOR : fat_at * SECTOR + len(fat)] = fat
    for c, body in heap.items():
        start = heap_at * SECTOR + (c - 2) * cluster
        image[start : start + len(body)] = body
    return bytes(image)


class Reader:
    """Entries of an image through a function that reads (offset, length); a folder's clusters must follow one another."""

    def __init__(self, read: Read):
        boot = read(0, SECTOR)
        if boot[3:11] != b"EXFAT   " or boot[510:512] != b"\x55\xaa":
            raise ValueError("not an exFAT image")
        self.read = read
        self.fat, _, heap, self.count, self.root = struct.unpack_from("<IIIII", boot, 80)
        sector = 1 << boot[108]
        self.cluster = sector << boot[109]
        self.fat, self.heap = self.fat * sector, heap * sector

    def offset(self, cluster: int) -> int:
        return self.heap + (cluster - 2) * self.cluster

    def chain(self, first: int) -> list[int]:
        out = [first]
        while len(out) <= self.count:
            (after,) = struct.unpack("<I", self.read(self.fat + 4 * out[-1], 4))
            if not 2 <= after < self.count + 2:
                return out
            out.append(after)
        raise ValueError("a chain has a loop")

    def _folder(self, first: int, size: int | None, no_chain: bool) -> bytes:
        clusters = list(range(first, first + -(-size // self.cluster))) if no_chain and size else self.chain(first)
        if clusters != list(range(first, first + len(clusters))):
            raise ValueError("a folder is fragmented")
        return self.read(self.offset(first), len(clusters) * self.cluster)

    def entries(self, first: int | None = None, size: int | None = None, no_chain: bool = False, above: str = "") -> Iterator[tuple]:
        data = self._folder(self.root if first is None else first, size, no_chain)
        at = 0
        while at + 32 <= len(data) and data[at]:
            if data[at] != FILE:
                at += 32
                continue
            count = data[at + 1]
            group = data[at : at + 32 * (count + 1)]
            if rotated_sum(group, 16, (2, 3)) != struct.unpack_from("<H", group, 2)[0]:
                raise ValueError("an entry's checksum is wrong")
            flags, length = group[33], group[35]
            cluster, n = struct.unpack_from("<IQ", group, 52)
            raw = b"".join(group[32 * k + 2 : 32 * k + 32] for k in range(2, count + 1))
            rel = above + raw[: 2 * length].decode("utf-16-le")
            folder, plain = bool(group[4] & FOLDER), bool(flags & NO_CHAIN)
            clusters = -(-n // self.cluster)
            run = not cluster or plain or self.chain(cluster) == list(range(cluster, cluster + clusters))
            yield rel, folder, cluster, self.offset(cluster) if cluster else 0, n, run
            if folder:
                yield from self.entries(cluster, n, plain, rel + "/")
            at += 32 * (count + 1)

    def find(self, candidates: list[str]) -> tuple | None:
        """The entry of the first candidate path that there is, whatever the case."""
        known = {_upper(e[0]): e for e in self.entries()}
        return next((known[_upper(c)] for c in candidates if _upper(c) in known), None)


class Image(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ExfatReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Image]:
        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [Image(p) for p in found if os.path.isfile(p)]

    def read(self, part: Image) -> Iterator[tuple]:
        with open(part.path, "rb") as f:

            def at(offset: int, length: int) -> bytes:
                f.seek(offset)
                return f.read(length)

            for entry in Reader(at).entries():
                yield os.path.basename(part.path), *entry


class Exfat(DataSource):
    """``spark.read.format("blockcat_exfat").load("/folder")``"""

    @classmethod
    def name(cls) -> str:
        return "blockcat_exfat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExfatReader:
        return ExfatReader(self.options)
