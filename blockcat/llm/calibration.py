"""Isotonic calibration from binned scores, and the folds by which labelled rows are held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
#: Bins of a raw score between 0 and 1; their counts cover all labelled rows of the fold.
BINS = 500


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 4 calibrates, the others are learnt from."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def isotonic(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The non-decreasing rates that fit bins of ``right`` out of ``total`` best, by pooling adjacent violators; empty bins get what lies before them (the first ones what follows)."""
    blocks: list[list[float]] = []  # right, total, bins
    for r, t in zip(right.tolist(), total.tolist(), strict=True):
        blocks.append([r, t, 1])
        while len(blocks) > 1 and (not blocks[-1][1] or not blocks[-2][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            r2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), (r + 0.5) / (t + 1.0) if t else 0.5) for r, t, n in blocks]) if blocks else np.zeros(0)


def _bin(raw: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(raw * BINS))).cast("int")


def curve(labelled: DataFrame) -> list[float]:
    """The calibrated rate of each bin from (raw, label); without rows, the bins' own middles."""
    counts = labelled.groupBy(_bin(F.col("raw")).alias("b")).agg(F.sum("label").alias("r"), F.count("*").alias("t")).collect()  # at most BINS rows
    if not counts:
        return [(i + 0.5) / BINS for i in range(BINS)]
    right, total = np.zeros(BINS), np.zeros(BINS)
    for b, r, t in counts:
        right[b], total[b] = r, t
    return np.maximum.accumulate(isotonic(right, total)).tolist()


def calibrated(raw: Column, rates: list[float]) -> Column:
    """The curve at a raw score, linear between the middles of bins."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), raw * BINS - 0.5))
    low = F.floor(at).cast("int")
    values = F.array(*[F.lit(float(x)) for x in rates])
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(F.lit(BINS), low + 2))
    return a + (b - a) * (at - low)
