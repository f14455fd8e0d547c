"""Toxicity scores by the nearest labelled examples in exact TF-IDF cosine, from a block-max inverted index.

Examples are a bounded sample of labelled rows (about ``EXAMPLES``, by hash of the id; folds 1 to 3). Terms are all words
and the beginnings (``STEM`` characters) of longer ones; none is left out. A term's weight is its occurrences times its IDF times how
surely toxic examples have it more often: z^2 / (z^2 + EVEN) of its log odds, never below ``LEAST``, so the rule is the same
at every number of examples. IDF comes from all documents; terms that no example has can't match and add to a text's length only,
with the IDF of a term that one document has.

Examples form an inverted index cut into blocks of alike ones. Rare terms have postings, and what they add to a cosine is
summed for all examples. Common terms have their greatest weight in each block: with these a block gets an upper bound, blocks
are opened from the highest bound on, and those whose bound lies below the k-th best cosine so far are never opened. The
neighbours (ties with the k-th included) are exact. They vote, weighted by nearness; the nearest are named as evidence. Votes
are calibrated by isotonic regression on fold 4.

Terms go by their 64-bit hashes. The index is bounded by the sample, so it goes to all tasks; texts are read twice and never shuffled.

Defined cases: null and empty texts, and those that share no term with an example, get the rate of all examples; without labels every
score is 0.5 and predicted 1; several labels of a doc_id count as toxic if most are; rows of the same doc_id are scored each; a text
of any length is read whole; an empty table gives an empty result; columns named like the added ones are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.calibration import CALIBRATE, HELD_OUT, calibrated, curve, fold
from blockcat.llm.common import WORD_BYTES, stored, text_bytes

THRESHOLD = 0.5
#: Examples at most, on average over hashes; neighbours; nearness of a cosine c: 1 / (1 - c + SOFT).
EXAMPLES, NEIGHBOURS, SOFT = 8_000, 15, 0.02
#: A term of more than one in so many examples has a row of weights; texts are looked up so many at once.
OFTEN, TEXTS = 8, 128
#: Examples in a block of the index.
BLOCK = 64
#: Length of a beginning; the z^2 at which a term has about half its weight, and the share of it that every term keeps.
STEM, EVEN, LEAST = 5, 20.0, 0.1
#: Bytes of texts whose terms are taken at once.
AT_ONCE = 1 << 19

# Fixed numbers of the terms' hashes.
_ODD, _STEM_MARK = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    return tuple(np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n - 1, x % (1 << 64), dtype=np.uint64))]) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all terms of a text that ends in a space: of words, and of the beginnings of longer ones.

    A hash is a polynomial of the term's bytes, taken for all terms at once from running sums over the text.
    """
    data = np.frombuffer(text.translate(WORD_BYTES), dtype=np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[::2], edges[1::2]
    up, down = _powers(1 << max(20, len(data).bit_length()))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])])
    h = (sums[end] - sums[start]) * down[start]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    at = np.searchsorted(first, start)
    far = np.append(first, np.full(STEM + 1, len(data)))[at + STEM]
    long = far < end
    stem = (sums[far[long]] - sums[start[long]]) * down[start[long]]
    return np.concatenate([start, start[long]]), np.concatenate([_mixed(h), _mixed(stem ^ np.uint64(_STEM_MARK))])


class Terms:
    """Occurrences of terms in texts: those of a sorted vocabulary of hashes by place, others by -1 - hash."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, occurrences) of each text."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > AT_ONCE or len(group) == 256:
                yield from self._of(group)
                group, size = [], 0
        yield from self._of(group)

    def _of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not texts:
            return
        docs, hashes = [], []
        for at, piece in self._pieces(texts):
            start, h = _words(piece)
            docs.append(np.searchsorted(at[1], start, side="right") - 1 + at[0])
            hashes.append(h)
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        at = np.searchsorted(self.vocabulary, distinct)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == distinct[known]
        terms = np.where(known, at, -1 - distinct)
        keys, counts = np.unique(np.concatenate(docs) * max(1, len(distinct)) + place, return_counts=True)
        terms, cuts = terms[keys % max(1, len(distinct))], np.searchsorted(keys, np.arange(len(texts) + 1) * max(1, len(distinct)))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield terms[a:z], counts[a:z]

    @staticmethod
    def _pieces(texts: list[bytes]) -> Iterator[tuple[tuple[int, np.ndarray], bytes]]:
        """((number of the first text, start of each text), joined bytes): several texts, or a part of a very long one, cut before a space."""
        if len(texts) > 1 and sum(map(len, texts)) > 2 * AT_ONCE:  # the last one is long
            yield from Terms._pieces(texts[:-1])
            yield from (((len(texts) - 1, at), piece) for (_, at), piece in Terms._pieces(texts[-1:]))
        elif len(texts) > 1 or len(texts[0]) <= 2 * AT_ONCE:
            yield (0, np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])), b" ".join(texts) + b" "
        else:
            start = 0
            while start < len(texts[0]):
                end = texts[0].find(b" ", start + AT_ONCE)
                end = len(texts[0]) if end < 0 else end
                yield (0, np.zeros(1, dtype=np.int64)), texts[0][start:end] + b" "
                start = end


def _alike(rows: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which alike ones are neighbours: halved along the direction in which they vary most, again and again."""
    out, waiting = [], [np.arange(len(rows))]
    while waiting:
        own = waiting.pop()
        if len(own) <= block or not rows.shape[1]:
            out.append(own)
            continue
        x = rows[own] - rows[own].mean(axis=0)
        way = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(8):
            way = (x @ way) @ x
            way /= np.linalg.norm(way) + 1e-300
        own = own[np.argsort(x @ way, kind="stable")]
        half = max(block, len(own) // 2 // block * block)
        waiting += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class Index:
    """TF-IDF vectors of labelled examples, in blocks: postings of rare terms, and of each common term a row of occurrences
    cut into blocks, with the greatest weight in every block. Postings hold occurrences; weights and lengths are applied to sums."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, idf: np.ndarray, rest: float, unknown: float = 0.0, block: int = BLOCK):
        """``terms``, ``tfs``: those of the examples one after the other, ``sizes`` of each; ``idf``: the weight of each term;
        ``unknown``: that of a term that isn't among them; ``rest``: the vote without neighbours."""
        self.idf, self.rest, self.unknown, self.block = idf, rest, unknown, block
        ids, labels = ids[sizes > 0], labels[sizes > 0]
        sizes, n = sizes[sizes > 0], int((sizes > 0).sum())
        at = np.repeat(np.arange(n, dtype=np.int32), sizes)
        length = np.sqrt(np.bincount(at, (tfs * idf[terms]) ** 2, n))
        tfs = tfs.astype(np.uint16 if tfs.max(initial=0) < 1 << 16 else np.uint32)
        df = np.bincount(terms, minlength=len(idf))
        often = np.flatnonzero(df * OFTEN > n)
        self.row = np.full(len(idf), -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        dense = self.row[terms] >= 0
        counts = np.zeros((n, len(often)), dtype=tfs.dtype)
        counts[at[dense], self.row[terms[dense]]] = tfs[dense]
        # alike examples share blocks, so that a block's greatest weights are near its members' own
        order = _alike(counts * idf[often] / length[:, None], block)
        place = np.empty(n, dtype=np.uint16 if n < 1 << 16 else np.uint32)
        place[order] = np.arange(n)
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = max(1, -(-n // block))
        self.length = np.concatenate([length[order], np.ones(self.blocks * block - n)])
        rows = np.concatenate([counts[order], np.zeros((self.blocks * block - n, len(often)), dtype=tfs.dtype)]).reshape(self.blocks, block, len(often))
        self.greatest = np.array([(x * idf[often] / z[:, None]).max(axis=0) for x, z in zip(rows, self.length.reshape(self.blocks, block), strict=True)]).T.copy()
        self.rows = np.ascontiguousarray(rows.transpose(0, 2, 1))
        term, at, tfs = terms[~dense], place[at[~dense]], tfs[~dense]
        order = np.lexsort((at, term))
        self.at, self.tfs = at[order], tfs[order]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])

    @classmethod
    def of(cls, examples: list[tuple[int, list[int], list[float], float]], idf: np.ndarray, rest: float, unknown: float = 0.0, block: int = BLOCK) -> Index:
        """From (id, terms, occurrences, label) of each example."""
        flat = lambda k, kind: np.array([x for e in examples for x in e[k]], dtype=kind)
        ids, labels, sizes = (np.array(x) for x in ([e[0] for e in examples], [e[3] for e in examples], [len(e[1]) for e in examples]))
        return cls(ids, labels, sizes.astype(np.int64), flat(1, np.int64), flat(2, np.float64), idf, rest, unknown, block)

    def vector(self, terms: np.ndarray, tfs: np.ndarray, others: float = 0.0) -> np.ndarray:
        """The weights of terms in a text of length 1; ``others``: the squares of the weights of its other terms, summed."""
        w = np.asarray(tfs, dtype=np.float64) * self.idf[np.asarray(terms, dtype=np.int64)]
        return w / math.sqrt(float(w @ w) + others)

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> np.ndarray:
        """Of each query (terms, weights) with each example; minus one where the example's block can't hold one of the ``k``
        nearest or one as near."""
        n, size = len(self.ids), self.block
        q, out = np.zeros((len(queries), self.rows.shape[1])), np.zeros((len(queries), self.blocks * size))
        for own, part, (terms, w) in zip(q, out, queries, strict=True):
            row = self.row[terms]
            own[row[row >= 0]] = w[row >= 0]
            many = self.cuts[terms + 1] - self.cuts[terms]
            span = _spans(self.cuts[terms], many)
            part[:] = np.bincount(self.at[span], np.repeat(w * self.idf[terms], many) * self.tfs[span], len(part))  # rare terms: exact for all
        out /= self.length
        cells = out.reshape(len(queries), self.blocks, size)
        most = q @ self.greatest + cells.max(axis=2) + 2e-9  # no example of the block is nearer
        order, closed = np.argsort(-most, axis=1), np.ones((len(queries), self.blocks), dtype=bool)
        best = np.full((len(queries), k), -1.0)
        q *= self.idf[self.row >= 0]
        length = self.length.reshape(self.blocks, size)
        done, step = 0, 2
        while done < self.blocks:
            want = order[:, done : done + step]
            which, place = np.nonzero(np.take_along_axis(most, want, axis=1) >= np.maximum(best.min(axis=1), 1e-12)[:, None])
            if not len(which):  # blocks come by their bounds: those after them are no nearer
                break
            block = want[which, place]
            for b in np.unique(block).tolist():
                own = which[block == b]
                cells[own, b] += q[own] @ self.rows[b].astype(np.float64) / length[b]
            closed[which, block] = False
            found = np.full((len(queries), want.shape[1], size), -1.0)
            found[which, place] = cells[which, block]
            both = np.concatenate([best, found.reshape(len(queries), -1)], axis=1)
            best = -np.partition(-both, k - 1, axis=1)[:, :k]
            done, step = done + step, step * 2
        cells[closed] = -1.0
        return out[:, :n]

    def best(self, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        kth = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) > k else 0
        at = np.flatnonzero((cos > 1e-12) & (cos >= kth - 1e-9))
        at = at[np.lexsort((self.ids[at], -cos[at]))]
        return at, cos[at]

    def nearest(self, terms: list[int], tfs: list[float], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine, and of those as near as the k-th; best first."""
        return self.best(self.cosines([(np.asarray(terms, dtype=np.int64), self.vector(terms, tfs))], k)[0], k)

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
        """Of each text (terms, occurrences): the weighted share of toxic neighbours, and the five nearest as id:label:cosine."""
        queries = []
        for terms, tfs in texts:
            known = terms >= 0
            others = float(((tfs[~known] * self.unknown) ** 2).sum())
            queries.append((terms[known], self.vector(terms[known], tfs[known], others) if known.any() else np.zeros(0)))
        out = []
        for cos in self.cosines(queries):
            at, cos = self.best(cos, NEIGHBOURS)
            w = 1 / (1 - np.minimum(cos, 1) + SOFT)
            share = float((w * self.labels[at]).sum() / w.sum()) if len(at) else self.rest
            out.append((share, ",".join(f"{self.ids[a]}:{self.labels[a]:.0f}:{c:.4f}" for a, c in zip(at[:5].tolist(), cos[:5].tolist(), strict=True))))
        return out


def surely(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """How surely toxic examples have a term more often than others, from ``LEAST`` to 1, from the numbers that have it."""
    a, b, c, d = toxic + 0.5, clean + 0.5, all_toxic - toxic + 0.5, all_clean - clean + 0.5
    z = np.maximum(0, np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return LEAST + (1 - LEAST) * z * z / (z * z + EVEN)


def _learn(docs: DataFrame, examples: DataFrame) -> tuple[np.ndarray, Index]:
    """The vocabulary of the examples (sorted hashes), and their index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(np.zeros(0, dtype=np.int64))
        for b in batches:
            rows = list(terms.of(text_bytes(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([-1 - t for t, _ in rows], type=pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in rows], type=pa.list_(pa.int32()))], names=["doc_id", "label", "terms", "tfs"])

    # bounded by the sample: a number and a half per term of an example
    known = examples.mapInArrow(count, "doc_id long, label int, terms array<long>, tfs array<int>").toArrow()
    ids, labels = known.column("doc_id").to_numpy(), known.column("label").to_numpy().astype(np.int64)
    sizes = np.concatenate([np.zeros(0, dtype=np.int64), *[c.value_lengths().to_numpy() for c in known.column("terms").chunks]]).astype(np.int64)
    hashes, tfs = (np.concatenate([np.zeros(0, dtype=kind), *[c.flatten().to_numpy() for c in known.column(name).chunks]]) for name, kind in (("terms", np.int64), ("tfs", np.int32)))
    del known
    vocabulary = np.unique(hashes)
    place = np.searchsorted(vocabulary, hashes).astype(np.int32)
    del hashes
    toxic, of = int(labels.sum()), np.repeat(labels, sizes)
    have = [np.bincount(place[of == k], minlength=len(vocabulary)) for k in (1, 0)]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, total = Terms(shared.value), np.zeros(len(shared.value), dtype=np.int64), 0
        for b in batches:
            for at, _ in terms.of(text_bytes(b.column("text"))):
                n[at[at >= 0]] += 1
            total += b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], total))], names=["term", "docs"])

    sums = docs.select("text").mapInArrow(spread, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()  # a row a term of the sample
    at, n = sums.column("term").to_numpy(), sums.column("docs").to_numpy()
    total, spread_over = int(n[at < 0].sum()), np.zeros(len(vocabulary))
    spread_over[at[at >= 0]] = n[at >= 0]
    weights = (np.log((total + 1) / (spread_over + 1)) + 1) * surely(*have, toxic, len(labels) - toxic)
    unknown = (math.log((total + 1) / 2) + 1) * LEAST
    index = Index(ids, labels.astype(np.float64), sizes, place, tfs, weights, (toxic + 0.5) / (len(labels) + 1), unknown)
    return vocabulary, index


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, vote, evidence) for every document; ``labels`` has doc_id and toxic (0 or 1)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("toxic") > 0.5).cast("int").alias("label"))
    marks = stored(marks.withColumn("fold", fold(F.col("_id"))).filter(F.col("fold") != HELD_OUT), "marks")
    learn = marks.filter(F.col("fold") != CALIBRATE)
    n = learn.count()
    held = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    if not n:
        return docs.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(0.5).alias("vote"), F.lit("").alias("evidence"))
    sample = learn if n <= EXAMPLES else learn.filter(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < int(EXAMPLES / n * (1 << 30)))
    sample = stored(sample.select("_id", "label"), "example-ids")  # about EXAMPLES rows at most: it is broadcast
    examples = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(_learn(docs, examples))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        terms, seen = Terms(vocabulary), {}
        for b in batches:
            texts = text_bytes(b.column("text"))
            keys = [xxhash.xxh3_128_digest(t) for t in texts]
            if len(seen) > 100_000:
                seen = {}
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}  # equal texts once
            todo = list(new)
            for i in range(0, len(todo), TEXTS):
                some = todo[i : i + TEXTS]
                seen |= zip(some, index.votes(list(terms.of([new[k] for k in some]))), strict=True)
            votes = [seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([v for v, _ in votes], type=pa.float64()), pa.array([e for _, e in votes], type=pa.string())], names=["doc_id", "raw", "evidence"])

    voted = stored(docs.mapInArrow(vote, "doc_id long, raw double, evidence string"), "votes")
    test = voted.select("doc_id", "raw").join(marks.filter(F.col("fold") == CALIBRATE), F.col("doc_id") == F.col("_id")).select("raw", "label")
    rates = curve(test)
    found = voted.withColumn("score", calibrated(F.col("raw"), rates))
    return found.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("raw").alias("vote"), "evidence")
