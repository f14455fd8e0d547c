"""Packing token sequences: dominance reduction, then best fit, on the histogram of lengths.

Lengths are integers up to the capacity, so the whole instance is a histogram of at most ``capacity`` counts, however
many documents there are; the driver plans on that. A plan is a list of placements: ``each`` pieces of one length into
every one of ``bins`` consecutive sequences at one offset, taking pieces of that length by rank. Pieces get their ranks
within their length from a range sort (see ``running_totals``), so a length that a third of all pieces share is no
task's burden, and look their place up in the plan.

Reduction (after Martello and Toth): a set of pieces that fit together dominates another with a common piece if the
other's remaining pieces can be put, in groups, in place of single pieces of the first. A piece with a dominating set is
fixed in it, which costs no optimal solution. The rules used:

* a piece beside which not even the smallest fits is alone;
* a piece and its exact complement dominate every other set that has the piece;
* if at most one more piece fits, the largest that does;
* if at most two more fit: the largest single one, if no pair is larger in sum; or the largest single one with the
  largest that still fits beside both, if each pair has its smaller piece at most as large as that one or a sum at most
  the larger one.

What is left goes by best fit in decreasing order.

Defined cases: null and empty texts are the end id alone; an empty table gives no pieces; a document that is repeated is
packed as often; extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.common import partitions, running_totals, stored, text_bytes
from blockcat.llm.tokens import after_encoding, encoder, slices

CAPACITY = 4096
END_ID = 1
#: Pieces that one task sorts, as long as the session's number of shuffle partitions isn't exceeded: each task writes a file.
PIECES_A_TASK = 1 << 15


class Placement(NamedTuple):
    length: int
    rank: int  # of the first piece of this length
    each: int  # pieces per sequence
    bins: int
    sequence: int  # the first one
    offset: int


class Planner:
    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self.placements: list[Placement] = []
        self.bins = 0

    def _put(self, length: int, each: int, bins: int, sequence: int, offset: int) -> None:
        self.placements.append(Placement(length, self.used[length], each, bins, sequence, offset))
        self.used[length] += each * bins
        self.left[length] -= each * bins
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect.bisect_left(self.sizes, length))

    def _fix(self, pieces: list[int]) -> None:
        """As many sequences of just these pieces as there can be."""
        need = {s: pieces.count(s) for s in set(pieces)}
        bins, offset = min(self.left[s] // k for s, k in need.items()), 0
        for s, k in need.items():
            self._put(s, k, bins, self.bins, offset)
            offset += k * s
        self.bins += bins

    def _largest(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``room`` of which a piece is left besides ``without``; 0 if none."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= without.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def _smallest(self, k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.left[s] - (s == without))
            if len(out) == k:
                break
        return out

    def _dominating(self, s: int) -> list[int] | None:
        room, least = self.capacity - s, self._smallest(3, s)
        if not least or least[0] > room:
            return [s]
        if self.left.get(room, 0) > (room == s):
            return [s, room]
        one = self._largest(room, (s,))
        if len(least) < 2 or least[0] + least[1] > room:
            return [s, one]
        if len(least) < 3 or sum(least) > room:
            beside = self._largest(room - one, (s, one))
            best, fair = 0, beside > 0
            for a in self.sizes[: bisect.bisect_right(self.sizes, room)]:
                if self.left[a] > (a == s) and (b := self._largest(room - a, (s, a))):
                    best = max(best, a + b)
                    fair &= min(a, b) <= beside or a + b <= one
            if one >= best:
                return [s, one]
            if fair:
                return [s, one, beside]
        return None

    def reduce(self) -> None:
        again = True
        while again:
            again = False
            for s in self.sizes[::-1]:
                while self.left.get(s) and (pieces := self._dominating(s)):
                    self._fix(pieces)
                    again = True

    def best_fit(self) -> None:
        open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first sequence, sequences)
        rooms: list[int] = []

        def add(room: int, first: int, bins: int) -> None:
            if room and bins:
                if not open_bins[room]:
                    bisect.insort(rooms, room)
                open_bins[room].append((first, bins))

        while self.sizes:
            s = self.sizes[-1]
            n = self.left[s]
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            else:
                room, each = self.capacity, self.capacity // s
                first, bins = self.bins, -(-n // each)
                self.bins += bins
            each, offset = room // s, self.capacity - room  # a sequence takes what it can before the next one is tried
            full = min(bins, n // each)
            if full:
                self._put(s, each, full, first, offset)
                add(room - each * s, first, full)
            if full < bins and (rest := n - full * each):
                self._put(s, rest, 1, first + full, offset)
                add(room - rest * s, first + full, 1)
                full += 1
            add(room, first + full, bins - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Placements for every piece of a histogram of lengths 1 to ``capacity``."""
    p = Planner(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.placements


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the end id, cut where they exceed the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, wide = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for b in slices(batches):
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(text_bytes(b.column("text"))), strict=True):
                ids += end
                out += [(doc, i // wide, i // 4, (min(len(ids), i + wide) - i) // 4, zlib.crc32(ids[i : i + wide])) for i in range(0, len(ids), wide)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``pieces`` with the sequence_id and offset of each in sequences of at most ``capacity`` ids."""
    cut = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    placed = plan(counts, capacity)
    tasks = min(partitions(docs.sparkSession), sum(counts.values()) // PIECES_A_TASK + 1)
    ranked = running_totals(cut, ["length", "doc_id", "piece", "ids_crc32"], None, "length", "piece-order", tasks, after_encoding).withColumnRenamed("before", "rank")
    rows = np.array(sorted(placed), dtype=np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # bounded by the capacity: a few placements per length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, each, _, sequence, offset = shared.value.T
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.empty(len(n), dtype=np.int64)
            for length in np.unique(n):
                lo, hi = starts[length], starts[length + 1]
                own = n == length
                at[own] = lo + np.searchsorted(ranks[lo:hi], rank[own], side="right") - 1
            nth = rank - ranks[at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(after_encoding(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
