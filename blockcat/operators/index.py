"""The case-insensitive path index: records, hash slots and their probe statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S


def slot_count(entries: int) -> int:
    """The smallest power of two of at least twice the entries, two at least."""
    return max(2, 1 << (2 * entries - 1).bit_length()) if entries else 0


def place(hashes: list[int]) -> tuple[list[int], dict[str, int]]:
    """Slot of each hash by linear probing in order, and statistics (a meeting with an equal hash counts each time)."""
    mask = slot_count(len(hashes)) - 1
    taken: dict[int, int] = {}
    slots, stats = [], {"probed": 0, "steps": 0, "longest": 0, "duplicate_groups": 0, "duplicate_entries": 0}
    for h in hashes:
        at, probes = h & mask & 0xFFFFFFFF, 0
        while at in taken:
            if taken[at] == h:
                stats["duplicate_groups"] += 1
                stats["duplicate_entries"] += 2
            at, probes = (at + 1) & mask, probes + 1
        taken[at] = h
        slots.append(at)
        if probes:
            stats["probed"] += 1
            stats["steps"] += probes
            stats["longest"] = max(stats["longest"], probes)
    return slots, stats


def records(entries: DataFrame, container: str) -> DataFrame:
    """Entries with the 64-bit hash of their folded path."""
    return entries.withColumn("hash", S.fnv1a64_hex(S.ascii_lower(F.col("rel"))))


def slot_statistics(rows: DataFrame, container: str) -> DataFrame:
    """Per container: slots and probe statistics. Probing depends on the order of insertion, so a container is one fold."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(_f=g["rel"].map(lambda x: x.translate({c: c + 32 for c in range(65, 91)}))).sort_values(["_f", "rel"])
        _, stats = place([int(h, 16) for h in g["hash"]])
        return pd.DataFrame([{container: g[container].iloc[0], "entries": len(g), "slots": slot_count(len(g)), **stats}])

    kind = dict(rows.dtypes)[container]
    return rows.select(container, "rel", "hash").groupBy(container).applyInPandas(run, f"`{container}` {kind}, entries long, slots long, probed long, steps long, longest long, duplicate_groups long, duplicate_entries long")
