"""Path index files: records sorted by folded path, the paths themselves, and hash slots for look-up."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

from blockcat.operators.index import place, slot_count

# Magic, version, sizes of a record and of a slot, mark of a slot whose hash occurs twice; basis and prime of the hash.
MAGIC, VERSION, RECORD, SLOT, TWICE = b"AMPRIDX3", 3, 24, 16, 1
BASIS, PRIME = 1469598103934665603, 1099511628211
_HEAD, _RECORD, _SLOT = struct.Struct("<8sIIQQQII"), struct.Struct("<IIQq"), struct.Struct("<QII")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def path_hash(path: str) -> int:
    h = BASIS
    for b in path.encode().translate(_FOLD):
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h or 1


def write(rows: Sequence[tuple[str, int, int]]) -> bytes:
    """A file of (path, size, mtime) rows, put in order here."""
    rows = sorted(rows, key=lambda r: (r[0].encode().translate(_FOLD), r[0].encode()))
    paths = [r[0].encode() + b"\0" for r in rows]
    blob = b"".join(paths)
    hashes = [path_hash(r[0]) for r in rows]
    at = _HEAD.size + RECORD * len(rows) + len(blob)
    slots_at = -(-at // SLOT) * SLOT
    out, start = [_HEAD.pack(MAGIC, VERSION, RECORD, len(rows), len(blob), slots_at, SLOT, slot_count(len(rows)))], 0
    for p, (_, size, mtime) in zip(paths, rows, strict=True):
        out.append(_RECORD.pack(start, len(p) - 1, size, mtime))
        start += len(p)
    out += [blob, bytes(slots_at - at)]
    table = [(0, 0, 0)] * slot_count(len(rows))
    often = {h for h in hashes if hashes.count(h) > 1} if len(set(hashes)) < len(hashes) else set()
    for n, (h, s) in enumerate(zip(hashes, place(hashes)[0], strict=True)):
        table[s] = (h, n + 1, TWICE if h in often else 0)
    return b"".join([*out, *[_SLOT.pack(*s) for s in table]])


def read(data: bytes) -> list[tuple[str, int, int]]:
    """All rows in order; raises if the file isn't an index."""
    magic, version, record, n, blob, slots_at, slot, slots = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or record != RECORD or slot != SLOT or len(data) != slots_at + slots * SLOT:
        raise ValueError("not a path index")
    base, out = _HEAD.size + n * RECORD, []
    for i in range(n):
        at, length, size, mtime = _RECORD.unpack_from(data, _HEAD.size + i * RECORD)
        if at + length > blob:
            raise ValueError("a path is out of bounds")
        out.append((data[base + at : base + at + length].decode(), size, mtime))
    return out


def find(data: bytes, path: str) -> tuple[str, int, int] | None:
    """One row by its path, whatever the case, through the slots."""
    _, _, _, n, _, slots_at, _, slots = _HEAD.unpack_from(data)
    base, want, at = _HEAD.size + n * RECORD, path_hash(path), path_hash(path) & slots - 1
    while True:
        h, number, _ = _SLOT.unpack_from(data, slots_at + at * SLOT)
        if not number:
            return None
        if h == want:
            start, length, size, mtime = _RECORD.unpack_from(data, _HEAD.size + (number - 1) * RECORD)
            own = data[base + start : base + start + length].decode()
            if own.encode().translate(_FOLD) == path.encode().translate(_FOLD):
                return own, size, mtime
        at = at + 1 & slots - 1


def write_indexes(entries: DataFrame) -> DataFrame:
    """(container, data): an index file for each container of (container, rel, size, mtime). A file is one task's work."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(g["rel"], g["size"].astype(int), g["mtime"].astype(int), strict=True))
        return pd.DataFrame({"container": [g["container"].iloc[0]], "data": [write(rows)]})

    kind = dict(entries.dtypes)["container"]
    return entries.select("container", "rel", "size", "mtime").groupBy("container").applyInPandas(run, f"container {kind}, data binary")
