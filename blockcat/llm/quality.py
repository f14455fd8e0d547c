"""Quality scores: random Fourier features, ridge regression from partition sums, isotonic calibration.

A text is described by statistics of its whole: lengths, shares of kinds of characters, repetition of words, of runs of
three words and of lines. Standardised, they go through random Fourier features, whose inner products approximate a
Gaussian kernel. Ridge regression on these needs only sums over labelled rows (a matrix as large as the features
squared); each task adds up its rows', and the sums are added in a tree, so a task and the driver get a bounded number of
matrices whatever the input's size. The raw score is then calibrated by isotonic regression on labelled rows that the
regression didn't see.

All labelled rows outside the held-out fold are used: folds 1 to 3 for the regression, 4 for the calibration. Neither
labels nor lang, source or doc_id enter a score.

Defined cases: null and empty texts have statistics like any other (all zero) and get a score; a text of any length is read whole;
without labels every
score is 0.5; several labels of a doc_id count by their mean; rows of the same doc_id are scored each; an empty table
gives an empty result; columns named like the added ones are not looked at.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.calibration import CALIBRATE, HELD_OUT, calibrated, curve, fold
from blockcat.llm.common import fresh, stored, text_bytes

THRESHOLD = 0.3
#: Random features, width of the kernel in units of the square root of the statistics' number, ridge per labelled row.
FEATURES, WIDTH, RIDGE, SEED = 192, 0.7, 1e-3, 11
#: Matrices that one task, or the driver, adds up.
FAN = 32

_KINDS = (range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" ", b"\n", b".", b",", b"!?", b"|<>{}[]=;/\\", b"*$%&#@~^_+", range(0x80, 0x100))
_TABLE = np.zeros((256, len(_KINDS)))
for _k, _kind in enumerate(_KINDS):
    _TABLE[list(_kind), _k] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics per text."""
    counts = np.stack([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts]) if texts else np.zeros((0, 256))
    size = counts.sum(axis=1)
    shares = counts @ _TABLE / np.maximum(size, 1)[:, None]
    letters = shares[:, 0] + shares[:, 1]
    more = np.zeros((len(texts), 10))
    for row, text in zip(more, texts, strict=True):
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        n, m = len(words), len(lines)
        if n:
            distinct = len(set(words))
            row[:6] = np.log1p(n), sum(map(len, words)) / n, distinct / n, distinct / n**0.8, sum(map(operator.eq, words, words[1:])) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)
        if m:
            row[6:] = np.log1p(m), len(set(lines)) / m, np.log1p(len(text) / m), max(map(len, lines)) / len(text)
    return np.column_stack([np.log1p(size), shares, shares[:, 0] / np.maximum(letters, 1e-9), more])


STATISTICS = statistics([b""]).shape[1]


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


class Model:
    """Standardisation, random features, and the weights once they are fitted."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.standard_normal((STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5) / 2 + 0.25  # 0 to 1


def total(rows: DataFrame, shape: tuple[int, ...], of: Callable[[pa.RecordBatch], np.ndarray], fan: int = FAN) -> np.ndarray:
    """The sum over all rows of what ``of`` makes of a batch: by task, then by up to ``fan`` tasks together, level after level."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                out, some = out + of(b), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([out.tobytes()], type=pa.binary())], names=["g", "part"])

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for g, x in zip(b.column("g").to_pylist(), b.column("part"), strict=True):
                own = np.frombuffer(x.as_py(), dtype=np.float64)
                sums[g] = sums[g] + own if g in sums else own
        for g, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([x.tobytes()], type=pa.binary())], names=["g", "part"])

    tasks = rows.rdd.getNumPartitions()
    parts = rows.mapInArrow(by_task, "g long, part binary")
    while tasks > fan:
        tasks = -(-tasks // fan)
        parts = parts.withColumn("g", F.expr(f"g div {fan}")).repartition(tasks, "g").mapInArrow(by_group, "g long, part binary")
    return sum((np.frombuffer(r[0], dtype=np.float64) for r in parts.select("part").collect()), np.zeros(int(np.prod(shape)))).reshape(shape)  # at most `fan` rows


def fit(labelled: DataFrame) -> Model | None:
    """A model from (x, label); None without rows."""
    k = STATISTICS

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _rows(b)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = total(labelled, (2 * k + 1,), moments)
    if not m[0]:
        return None
    mean = m[1 : k + 1] / m[0]
    model = Model(mean, np.sqrt(np.maximum(0, m[k + 1 :] / m[0] - mean**2)))

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z = model.features(_rows(b))
        return z.T @ np.column_stack([z, b.column("label").to_numpy(zero_copy_only=False)])

    s = total(labelled, (FEATURES + 1, FEATURES + 2), normal)
    ridge = RIDGE * m[0] * np.eye(FEATURES + 1) / FEATURES
    ridge[0, 0] = 1e-9
    model.weights = np.linalg.solve(s[:, :-1] + ridge, s[:, -1])
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, raw) for every document; ``labels`` has doc_id and quality (0 or 1)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(text_bytes(b.column("text")))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * STATISTICS
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, x array<double>")
    rows = stored(rows.withColumn("fold", fold(F.col("doc_id"))), "statistics")
    marks = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("quality").alias("label"))
    known = stored(rows.filter(F.col("fold") != HELD_OUT).join(marks, F.col("doc_id") == F.col("_id")).select("x", "fold", "label"), "labelled")
    model = fit(known.filter(F.col("fold") != CALIBRATE))
    if model is None:
        return rows.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(0.5).alias("raw"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [c for c in b.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(model.raw(_rows(b)) if b.num_rows else np.zeros(0))], names=[*own, "raw"])

    rates = curve(known.filter(F.col("fold") == CALIBRATE).select("x", "label").mapInArrow(rate, "label double, raw double"))
    found = rows.mapInArrow(rate, "doc_id long, fold int, raw double").withColumn("score", calibrated(F.col("raw"), rates))
    return found.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "raw")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted bad; all columns as they were. A doc_id of several rows stays if any of them is good."""
    (key,) = fresh(docs, "_id")
    bad = score(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("best")).filter("best = 0").select(F.col("doc_id").alias(key))
    return docs.join(stored(bad, "bad"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")
