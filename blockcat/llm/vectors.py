"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector goes to every filter whose direction it has an inner product of at least ``height``
with. The directions are a structured random product code: the space is rotated at random and cut into blocks, each
block has its own small random code, and a filter is one code vector of each block. List decoding needs only the inner
products per block: combinations whose sum reaches the height are enumerated, block by block, dropping those that even
the best rest cannot lift. Near vectors share many filters, unrelated ones almost none; candidates that share a filter
are verified by their cosine in double precision.

The code grows with the number of vectors, so a filter holds about ``CROWD`` unrelated ones at every size: enough to compare
them as one matrix product, so few that none is compared with a part of all. The height follows from the number of filters a
vector should reach on average. Caps narrow as filters grow in number, so one code finds fewer of the pairs that just link: how
many is counted on planted pairs, and so many independent codes are used that ``RECALL`` is expected. The join is
probabilistic; measured recall is in the README. A length of up to ``BLOCK`` vectors has a single filter for all: exact.

Equal vectors are made one class first, by themselves, not by a hash. A class's row carries the filters it is in, so each pair is
counted in the first filter that it shares, without collecting pairs. In a filter, rows are compared in blocks; a filter of
more than ``BLOCK`` rows is split into blocks, each pair of blocks a task of its own. Whether a pair links is decided by one sum of
products wherever rounding could matter, so all filters agree. Links are counted where they are found; of a dense block only a
spanning forest is passed on.

Defined cases: vectors that are null or zero, or hold null or non-finite components, link with nothing and name
themselves; vectors of different lengths never link, and any number of lengths goes through together; a repeated vec_id is
a vector each time; null vec_ids come below all others; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.common import partitions, small, stored
from blockcat.llm.components import components, roots

COSINE = 0.95
#: Filters of a code that a vector reaches on average at least, unrelated vectors in a filter on average, and the codes' seed.
REACH, CROWD, SEED = 2, 64, 20_240_229
#: Two vectors that just link share a filter with this probability at least; more codes than MOST are replaced by a wider reach. Planted pairs a code.
RECALL, MOST, PAIRS = 0.99, 24, 250
#: A cap is at least so many times as wide as the angle of two vectors that just link (only low dimensions come near).
WIDEST = 1.6
#: Rows of a filter compared at once; a larger one is split into pairs of blocks. Filters of up to SHORT rows are compared together.
BLOCK, SHORT = 1024, 12
#: Matrix products so near the cosine are not trusted.
EDGE = 1e-9
#: Lengths whose codes are chosen once for all tasks; those of rarer ones are chosen where they occur.
COMMON = 8


def _cap(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the share of the sphere within each of a direction."""
    angle = np.linspace(0, np.pi, 20_001)
    share = np.cumsum(np.sin(angle) ** (dim - 2)) if dim > 1 else np.where(angle < np.pi, 0.5, 1.0)
    return angle, share / share[-1]


class Code:
    """The filters for ``n`` vectors of ``dim`` components that should link at ``cosine``."""

    def __init__(self, dim: int, n: int, cosine: float = COSINE, reach: float = REACH, seed: int = SEED):
        rng = np.random.default_rng([dim, seed])
        most = max(1, n) * reach / CROWD
        self.dim, self.blocks = dim, 1 if dim < 8 else 2 if most <= 1 << 22 or dim < 24 else 3
        size = max(4, math.ceil(most ** (1 / self.blocks)))
        angles, share = _cap(dim)
        narrow = float(np.interp(min(0.5, reach / size**self.blocks), share, angles))
        angle = max(narrow, WIDEST * math.acos(cosine))
        if angle > narrow:  # wider caps, and so fewer of them
            size = max(4, math.ceil((reach / float(np.interp(angle, angles, share))) ** (1 / self.blocks)))
        self.size, self.height = size, math.cos(angle)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            c = rng.standard_normal((self.size, z - a))
            self.codes.append((c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks)).astype(np.float32))
        self.filters = self.size**self.blocks

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors reach, by row and filter."""
        turned = (unit @ self.turn).astype(np.float32)
        scores = [turned[:, a:z] @ c.T for (a, z), c in zip(zip(self.cuts[:-1], self.cuts[1:], strict=True), self.codes, strict=True)]
        rest = np.cumsum([s.max(axis=1) for s in scores][::-1], axis=0)[::-1]  # the best that blocks k and on can add
        row, word, total = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit), dtype=np.float32)
        for k, s in enumerate(scores):
            ahead = rest[k + 1] if k + 1 < self.blocks else np.zeros(len(unit))
            rows, words, totals = [], [], []
            for i in range(0, len(row), max(1, 2_000_000 // self.size)):
                part = slice(i, i + max(1, 2_000_000 // self.size))
                sums = total[part, None] + s[row[part]]
                at, c = np.nonzero(sums + ahead[row[part], None] >= self.height)
                rows.append(row[part][at])
                words.append(word[part][at] * self.size + c)
                totals.append(sums[at, c])
            row, word, total = np.concatenate(rows or [row]), np.concatenate(words or [word]), np.concatenate(totals or [total])
        return row, word


def planted(dim: int, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors in random directions, at exactly this cosine."""
    a, b = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b / np.linalg.norm(b, axis=1, keepdims=True)


def sharing(code: Code, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each vector of ``a`` has a filter in common with that of ``b``."""
    (left, x), (right, y) = code.decode(a), code.decode(b)
    both = np.intersect1d(left * code.filters + x, right * code.filters + y)
    return np.isin(np.arange(len(a)), both // code.filters)


@lru_cache(64)
def choose(dim: int, n: int, cosine: float = COSINE, reach: float = REACH, seed: int = SEED) -> tuple[int, float]:
    """(codes, reach): so many that a pair at ``cosine`` shares a filter with probability ``RECALL``."""
    while True:
        first = [Code(dim, n, cosine, reach, seed + k) for k in range(4)]
        if dim < 2:
            return 1, reach
        rng = np.random.default_rng([dim, seed, 1])
        rates = np.array([sharing(c, *planted(dim, cosine, PAIRS, rng)).mean() for c in first])
        # a turned code serves all pairs alike, so codes miss independently; two standard errors are left as a margin
        rate = float(rates.mean()) - 2 * math.sqrt(float(rates.mean()) * (1 - float(rates.mean())) / (PAIRS * len(first)))
        need = 1 if rate >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - rate)) if rate > 0 else MOST + 1
        if need <= MOST or reach * 2 >= first[0].filters:
            return min(need, MOST), reach
        reach *= 2


@lru_cache(16)
def codes_of(dim: int, n: int, codes: int, cosine: float, reach: float, seed: int) -> list[Code]:
    return [Code(dim, n, cosine, reach, seed + k) for k in range(codes)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the largest and the smallest doubles stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters_before(rows: dict, which: np.ndarray, word: int) -> dict[int, frozenset]:
    return {r: frozenset(w for w in ws if w < word) for r, ws in zip(which.tolist(), rows["words"].take(pa.array(which)).to_pylist(), strict=True)}


def _links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``x`` link with which of ``y``: by a matrix product, and by ``_decided`` where that is too near to call."""
    product = x @ y.T
    hit = product >= cosine
    i, j = np.nonzero(np.abs(product - cosine) < EDGE)
    for k in range(0, len(i), 50_000):
        a, b = i[k : k + 50_000], j[k : k + 50_000]
        hit[a, b] = _decided(x[a], y[b], cosine)
    return hit


def _decided(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether rows link, pair by pair: the same sum of the same products in the same order wherever the pair is met."""
    return (x * y).sum(axis=1) >= cosine


def _compare(a: dict, b: dict | None, word: int, cosine: float) -> tuple[list, list]:
    """Links within rows ``a`` of a filter (or between ``a`` and ``b``): counts as (class, links), forest as (class, class)."""
    other = a if b is None else b
    hit = _links(a["unit"], other["unit"], cosine)
    if b is None:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    if not len(i):
        return [], []
    # a pair counts here if it shares no filter before this one
    left, right = _filters_before(a, np.unique(i), word), _filters_before(other, np.unique(j), word)
    if len(i) <= 5_000:
        earlier = np.array([not left[x].isdisjoint(right[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        own = {w: k for k, w in enumerate(set().union(*left.values()) & set().union(*right.values()))}

        def mask(sets: dict[int, frozenset], n: int) -> np.ndarray:
            m = np.zeros((n, len(own)), dtype=np.float32)
            for r, ws in sets.items():
                m[r, [own[w] for w in ws if w in own]] = 1
            return m

        earlier = ((mask(left, len(a["id"])) @ mask(right, len(other["id"])).T) > 0)[i, j]
    new_i, new_j = i[~earlier], j[~earlier]
    counts = []
    if len(new_i):
        counts.append((a["id"], np.bincount(new_i, weights=other["copies"][new_j], minlength=len(a["id"])).astype(np.int64)))
        if b is not None:
            counts.append((other["id"], np.bincount(new_j, weights=a["copies"][new_i], minlength=len(other["id"])).astype(np.int64)))
    nodes, root = roots(a["id"][i], other["id"][j])
    return [(k[n > 0], n[n > 0]) for k, n in counts], [(nodes[nodes != root], root[nodes != root])]


def _short(rows: dict, end: np.ndarray, cosine: float) -> tuple[list, list]:
    """Links within short runs, all runs of a batch at once: each row with the next one, the one after that, and so on."""
    unit, ids, copies, word = rows["unit"], rows["id"], rows["copies"], rows["word"]
    at, shift, left, right = np.arange(len(ids)), 0, [], []
    while True:
        shift += 1
        at = at[at + shift < end[at]]
        if not len(at):
            break
        hit = np.concatenate([_decided(unit[x], unit[x + shift], cosine) for x in np.array_split(at, 1 + len(at) // 20_000)])
        left.append(at[hit])
        right.append(at[hit] + shift)
    i, j = np.concatenate(left or [at]), np.concatenate(right or [at])
    if not len(i):
        return [], []
    used = np.unique(np.concatenate([i, j]))
    lists = rows["words"].take(pa.array(used)).to_pylist()
    before = {r: frozenset(w for w in ws if w < word[r]) for r, ws in zip(used.tolist(), lists, strict=True)}
    new = np.array([before[x].isdisjoint(before[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    counts = []
    if new.any():
        a, b = i[new], j[new]
        keys, place = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
        counts.append((keys, np.bincount(place, weights=np.concatenate([copies[b], copies[a]])).astype(np.int64)))
    nodes, root = roots(ids[i], ids[j])
    return counts, [(nodes[nodes != root], root[nodes != root])]


def _part(rows: dict, start: int, end: int) -> dict:
    return {k: v.slice(start, end - start) if isinstance(v, pa.Array) else v[start:end] for k, v in rows.items()}


def _verify(cosine: float):
    def out(found: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(found):
            for x, y in parts:
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int32)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], names=["kind", "a", "b"])

    def group(own: dict) -> Iterator[pa.RecordBatch]:
        n, word = len(own["id"]), int(own["word"][0])
        if own["left"][0] == own["right"][0]:
            parts = [_part(own, i, i + BLOCK) for i in range(0, n, BLOCK)]
            for i, a in enumerate(parts):
                yield from out(_compare(a, None, word, cosine))
                for b in parts[i + 1 :]:
                    yield from out(_compare(a, b, word, cosine))
        else:
            cut = int(np.searchsorted(own["side"], 1))
            for i in range(0, cut, BLOCK):
                for j in range(cut, n, BLOCK):
                    yield from out(_compare(_part(own, i, min(cut, i + BLOCK)), _part(own, j, j + BLOCK), word, cosine))

    def work(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs of one length; ``edges``: where they begin, and the end of the last."""
        rows = {c: t.column(c).to_numpy() for c in ("word", "left", "right", "side", "id", "copies")}
        rows |= {"unit": _unit(_matrix(t.column("vector").combine_chunks(), int(t.column("dim")[0].as_py()))), "words": t.column("words").combine_chunks()}
        sizes = np.diff(edges)
        own = (sizes <= SHORT) & (rows["left"] == rows["right"])[edges[:-1]]
        end = np.repeat(np.where(own, edges[1:], edges[:-1]), sizes)
        yield from out(_short(rows, end, cosine))
        for s, n in zip(edges[:-1][~own].tolist(), sizes[~own].tolist(), strict=True):
            if n > 1:
                yield from group(_part(rows, s, s + n))

    def by_length(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = [t.column(c).to_numpy() for c in ("dim", "word", "left", "right")]
        edges = np.concatenate([[0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1, [t.num_rows]])
        cuts = np.concatenate([[0], np.flatnonzero(ids[0][1:] != ids[0][:-1]) + 1, [t.num_rows]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from work(t.slice(s, e - s), edges[(edges >= s) & (edges <= e)] - s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None or not held.num_rows else pa.concat_tables([held, t]).combine_chunks()
            if not held.num_rows:
                continue
            ids = [held.column(c).to_numpy() for c in ("dim", "word", "left", "right")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            if len(new):  # the last run may go on in the next batch
                yield from by_length(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield from by_length(held)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, reach: float = REACH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    spark, e = vectors.sparkSession, F.col("embedding")
    if dict(vectors.dtypes)["embedding"] not in ("array<float>", "array<double>"):
        e = e.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # classes of equal vectors: found by a hash and the vectors themselves, numbered once they are written
    named = rows.filter(fine).select("vec_id", F.xxhash64("vector").alias("key"), "vector")
    classes = named.groupBy("key", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "key", F.size("vector").alias("dim"), "vector", "first", "copies"), "vector-classes")
    sizes = stored(classes.groupBy("dim").agg(F.count("*").alias("n")), "vector-lengths")
    common = [(r.dim, r.n) for r in sizes.orderBy(F.col("n").desc(), "dim").limit(COMMON).collect()]
    plan = {dim: choose(dim, n, cosine, reach, seed) for dim, n in common if n > block}
    narrow = max([n for _, n in common], default=0) < 1 << 24  # the filters of all codes then have numbers below 2**31
    kind = dict(rows.dtypes)["vector"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                n = int(own.column("n")[0].as_py())
                codes, wide = (0, reach) if n <= block else plan.get(dim) or choose(dim, n, cosine, reach, seed)
                filters = codes_of(dim, n, codes, cosine, wide, seed)
                for i in range(0, own.num_rows, 512):
                    part = own.slice(i, 512)
                    if filters:
                        unit = _unit(_matrix(part.column("vector"), dim))
                        found = [code.decode(unit) for code in filters]
                        row, word = np.concatenate([r for r, _ in found]), np.concatenate([w * codes + k for k, (_, w) in enumerate(found)])
                        order = np.lexsort((word, row))
                        row, word = row[order], word[order]
                    else:  # few vectors: one filter has them all
                        row, word = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int64)
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), part.column("vector"), part.column("copies"), pa.ListArray.from_arrays(pa.array(ends), pa.array(word, type=pa.int32() if narrow else pa.int64()))], names=["id", "dim", "vector", "copies", "words"])

    counted = classes.select("id", "dim", "vector", "copies").join(small(sizes), "dim").select("id", "dim", "n", "vector", "copies")
    coded = stored(counted.mapInArrow(decode, f"id long, dim int, vector {kind}, copies long, words array<{'int' if narrow else 'long'}>"), "vector-filters")
    # filters of more than a block of rows are dealt out as pairs of blocks
    full = coded.select(F.col("dim").alias("d"), F.explode("words").alias("w")).groupBy("d", "w").count().filter(F.col("count") > block).select("d", "w", F.ceil(F.col("count") / block).cast("int").alias("pieces"))
    full = stored(full, "full-filters")
    placed = coded.select("id", "dim", "vector", "copies", "words", F.explode("words").alias("word")).join(small(full), (F.col("dim") == F.col("d")) & (F.col("word") == F.col("w")), "left")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")).cast("int")
    pairs = F.when(F.col("pieces").isNull(), F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("left"), F.greatest(p, F.col("own")).alias("right"), (F.col("own") > p).cast("int").alias("side")))
    )
    dealt = placed.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("dim", "word", "pair.left", "pair.right", "pair.side", "id", "vector", "copies", "words")
    work = dealt.repartition(partitions(spark), "dim", "word", "left", "right").sortWithinPartitions("dim", "word", "left", "right", "side")
    found = stored(work.mapInArrow(_verify(cosine), "kind int, a long, b long"), "vector-links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("_cid")).agg(F.sum("b").alias("links"))
    grouped = components(found.filter("kind = 1").select("a", "b")).select(F.col("node").alias("_gid"), "root")
    whole = classes.select("id", "key", "vector", "first", "copies").join(counts, F.col("id") == F.col("_cid"), "left").join(grouped, F.col("id") == F.col("_gid"), "left")
    whole = stored(whole.select("key", "vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "vector-classes-linked")
    least = stored(whole.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "_root"), "vector-components")
    label = stored(whole.join(least, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), F.col("vector").alias("_vector"), "n_links", "component_id"), "vector-labels")
    linked = named.join(label, (F.col("key") == F.col("_key")) & (F.col("vector") == F.col("_vector")))
    linked = linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
