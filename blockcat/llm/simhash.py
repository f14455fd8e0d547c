"""Near-duplicates by 64-bit SimHash, found with fuzzy keys from the binary Golay code.

The perfect (23, 12) code puts every 23-bit word within distance 3 of exactly one codeword. Take as a word's keys the
index of that codeword and, if its distance is 3, of the five at distance 4: then of two words that differ in one bit,
each one's own codeword is among the other's keys.

A fingerprint is cut into four segments of 16 bits, each a word with seven zeros. Of at most 4 differing bits, by
pigeonhole, either two segments are free (six tables with two exact segments as key) or at least three segments have one
at most, and so both segments of (0, 1) or of (2, 3) have: two tables hold each fingerprint under its own pair of
codewords, and each one asks there with all pairs of its keys (up to 36). Every link is found in some table; a candidate
is verified by counting the differing bits.

Fingerprints are made distinct first, so copies cost one row. Rows that share a key meet in one task as a sorted run.
Short runs are compared pair by pair; in runs of up to ``DENSE`` rows only a spanning forest is passed on, never all
pairs. A longer run is not compared at all. If it is one of fuzzy keys, as most are once there are very many fingerprints, it is
dealt anew with a third segment's keys: two that differ in one bit at most in both segments of the key, and do not agree in
both, have at most three differing bits left, so one more segment has one at most. What is still longer, a dense group, goes to
a second, exact join by all centres within two bits (any two that link share one), each centre linking its fingerprints to the
smallest. That costs 2,081 rows for each, whatever the run's size, so no group grows with its square and none has a cap.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; a text of any length is read whole; a repeated doc_id gives a row each time; an empty table gives an empty
result; null doc_ids never name a component unless no other member has an id; columns named like the added ones stay as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockcat.llm.common import first_of_each, fresh, partitions, stored, text_bytes
from blockcat.llm.components import components, roots

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: Longest run compared in one task, and longest compared pair by pair.
DENSE, SHORT = 8192, 48
#: Shingles hashed at once.
_AT_ONCE = 1 << 17
#: Generator polynomial of the Golay code.
_GOLAY = 0xC75


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is in over half of its shingles' hashes. No words: 0."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n < 1:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _AT_ONCE):
        some = [digest(joined[a:z], SEED) for a, z in zip(starts[i : i + _AT_ONCE], ends[shingle - 1 + i : shingle - 1 + i + _AT_ONCE], strict=False)]
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of bytes stay bytes
            counts += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@lru_cache(1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment: up to six codeword indices, its own first, and how many there are."""
    power, x = [], 1
    for _ in range(23):
        power.append(x)
        x <<= 1
        if x & 0x800:
            x ^= _GOLAY
    words = np.arange(1 << 16, dtype=np.int64)
    rest = np.zeros(len(words), dtype=np.int64)
    for i in range(16):
        rest ^= np.where(words >> i & 1, power[i], 0)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in itertools.combinations(range(23), weight):
            s = 0
            for p in places:
                s ^= power[p]
            if weight < 4 or patterns[s]:
                patterns[s].append(sum(1 << p for p in places))
    count = np.array([len(p) for p in patterns])
    table = np.array([p + p[:1] * (6 - len(p)) for p in patterns], dtype=np.int64)
    return ((words[:, None] ^ table[rest]) >> 11).astype(np.int64), count[rest]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in ``fps``) of unsigned 64-bit fingerprints. The lowest bit of a key marks a row that only asks."""
    keys, count = golay_keys()
    seg = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    at = np.arange(len(fps))
    out = [((t << 33) | (seg[a] << 17) | (seg[b] << 1), at) for t, (a, b) in enumerate(itertools.combinations(range(4), 2))]
    for t, (a, b) in ((6, (0, 1)), (7, (2, 3))):
        for i, j in itertools.product(range(6), range(6)):
            own = np.flatnonzero((count[seg[a]] > i) & (count[seg[b]] > j))
            out.append(((t << 33) | (keys[seg[a][own], i] << 13) | (keys[seg[b][own], j] << 1) | int(i + j > 0), at[own]))
    return np.concatenate([k for k, _ in out]), np.concatenate([p for _, p in out])


def near(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _dense_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    label = np.arange(len(fps))
    for i in range(0, len(fps), 512):
        rows, cols = np.nonzero(near(fps[i : i + 512, None], fps[None, :]))
        rows += i
        keep = label[rows] != label[cols]  # those that join what isn't yet joined
        if keep.any():
            pairs = np.unique(np.stack([label[rows[keep]], label[cols[keep]]], axis=1), axis=0)
            nodes, root = roots(pairs[:, 0], pairs[:, 1])
            found.append(np.stack([nodes, root], axis=1)[nodes != root])
            move = np.arange(len(fps))
            move[nodes] = root
            label = move[label]
    pairs = np.concatenate(found)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def _links_in_runs(batches: Iterator[pa.RecordBatch], refine: bool = False) -> Iterator[pa.RecordBatch]:
    """(a, b, k) links of rows sorted by key; (a, null, k) for fingerprints in runs too long to compare here: with their key
    if a third segment may part them (``refine``, fuzzy keys), else with none."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "k"])

    def too_long(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fuzzy = refine and int(k[0]) >> 33 in (6, 7)
        fp = fp if fuzzy else np.unique(fp)
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(k) if fuzzy else pa.nulls(len(fp), pa.int64())], names=["a", "b", "k"])

    def work(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = k >> 1
        heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        ends = np.append(heads[1:], len(run))
        for s, e in zip(heads[ends - heads > SHORT].tolist(), ends[ends - heads > SHORT].tolist(), strict=True):
            a, b = _dense_links(np.unique(fp[s:e]))
            if len(a):
                yield out(a, b)
        end = np.repeat(np.where(ends - heads > SHORT, heads, ends), ends - heads)
        at = np.flatnonzero((k & 1) == 0)
        pairs = []
        for shift in range(1, SHORT):
            at = at[at + shift < end[at]]
            if not len(at):
                break
            a, b = fp[at], fp[at + shift]
            hit = near(a, b) & (a != b)
            pairs.append(np.stack([a[hit], b[hit]]))
        if pairs and (both := np.concatenate(pairs, axis=1)).size:
            both.sort(axis=0)
            both = np.unique(both, axis=1)
            yield out(both[1], both[0])

    held_k, held_fp, long_run = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), -1
    for batch in batches:
        k, fp = batch.column("k").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if long_run >= 0 and len(k):
            n = int(np.searchsorted(k >> 1, long_run, side="right"))
            if n:
                yield too_long(k[:n], fp[:n])
            k, fp, long_run = k[n:], fp[n:], -1 if n < len(fp) else long_run
        if not len(k):
            continue
        k, fp = np.concatenate([held_k, k]), np.concatenate([held_fp, fp])
        run = k >> 1
        start = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
        ready_k, ready_fp, held_k, held_fp = k[:start], fp[:start], k[start:], fp[start:]
        if len(held_k) > DENSE:
            yield too_long(held_k, held_fp)
            held_k, held_fp, long_run = held_k[:0], held_fp[:0], int(run[-1])
        if len(ready_k):
            heads = np.flatnonzero(np.concatenate([[True], ready_k[1:] >> 1 != ready_k[:-1] >> 1]))
            sizes = np.diff(np.append(heads, len(ready_k)))
            for s, n in zip(heads[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
                yield too_long(ready_k[s : s + n], ready_fp[s : s + n])
            if (sizes > DENSE).any():
                own = np.repeat(sizes <= DENSE, sizes)
                ready_k, ready_fp = ready_k[own], ready_fp[own]
            if len(ready_k):
                yield from work(ready_k, ready_fp)
    if len(held_k):
        yield from work(held_k, held_fp)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, fp): rows of fuzzy runs under their key and a third segment's, its own first. Only a row that owns both is asked for."""
    keys, count = golay_keys()
    for batch in batches:
        k, fp = batch.column("k").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(k), 16_384):
            own, some = k[i : i + 16_384], fp[i : i + 16_384]
            for third in (0, 1):
                place = np.where(own >> 33 == 6, 2 + third, third).astype(np.uint64)  # the segments that the key lacks
                seg = (some >> (place * np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
                for j in range(6):
                    at = np.flatnonzero(count[seg] > j)
                    key = ((own[at] >> 1) << 14) | (third << 13) | (keys[seg[at], j] << 1) | np.maximum(own[at] & 1, int(j > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[at].view(np.int64))], names=["k", "fp"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << i for i in range(64)]
    flips = np.array([0, *one, *[a ^ b for a, b in itertools.combinations(one, 2)]], dtype=np.uint64)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fp), 64):
            some = fp[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flips).reshape(-1).view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["centre", "fp"])


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, fp): SHA-256 of the text, and its unsigned 64-bit SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in text_bytes(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(fps.view(np.int64))], names=["doc_id", "sha", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _sha(F.col("text")).alias("sha")).mapInArrow(run, "doc_id long, sha binary, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp) that connect whatever at most 4 bits connect."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                some = fp[i : i + 4096]
                key, at = fuzzy_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[at].view(np.int64))], names=["k", "fp"])

    n = partitions(distinct.sparkSession)

    def compared(rows: DataFrame, refine: bool, label: str) -> DataFrame:
        sorted_rows = rows.repartition(n, F.expr("shiftright(k, 1)")).sortWithinPartitions("k")
        # a few links from each of many tasks: rebalanced, so that they fill a few files
        return stored(sorted_rows.mapInArrow(lambda batches: _links_in_runs(batches, refine), "a long, b long, k long").hint("rebalance"), label)

    found = compared(distinct.select("fp").mapInArrow(keyed, "k long, fp long"), True, "simhash-links")
    again = found.filter("b is null and k is not null")
    if again.limit(1).count():
        again = again.select("k", F.col("a").alias("fp")).repartition(n).mapInArrow(_refined, "k long, fp long")
        found = found.filter("b is not null or k is null").unionByName(compared(again, False, "simhash-refined"))
    far = stored(found.filter("b is null").select(F.col("a").alias("fp")).distinct(), "simhash-dense")
    near_links = found.filter("b is not null").select("a", "b")
    if far.limit(1).count():
        around = far.repartition(n).mapInArrow(_centres, "centre long, fp long")
        least = around.groupBy("centre").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select(F.col("centre").alias("c"), "b")
        near_links = near_links.unionByName(around.join(least, F.col("centre") == F.col("c")).select(F.col("fp").alias("a"), "b").filter("a <> b").distinct())
    return near_links


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, fp, root, component_id) for every document; root is the smallest fingerprint of its component."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    grouped = stored(components(links(distinct)), "fingerprint-components")
    labelled = distinct.join(grouped, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    member = stored(labelled.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "members")
    return prints.join(member, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: of each component the row of the smallest doc_id (rows of
    one doc_id are told apart by their texts, and equal ones are one)."""
    own, key, sha = fresh(docs, "_own", "_id", "_sha")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
    kept = stored(_grouped(docs).groupBy("root").agg(first.alias("r")).select(F.col("r.doc_id").alias(key), F.col("r.sha").alias(sha)), "kept")
    found = docs.withColumn(own, _sha(F.col("text"))).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    return first_of_each(found, ["doc_id", own], docs.columns) if repeated else found.drop(own)
