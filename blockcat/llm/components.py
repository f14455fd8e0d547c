"""Connected components of a graph given as edges, by alternating star contractions.

Each round replaces edges by stars: every node links its larger neighbours, then its smaller ones, to the smallest node
it knows (Kiveris et al., 2014). Rounds needed grow as the logarithm of the nodes; a round is one aggregation and one
join on each side. Before a round each task cuts what it has down to a spanning forest, so repeated links and dense
groups shrink before any shuffle. The smallest neighbours are a table of one row per node; while it is
small it is broadcast, so the links of a hub stay where they are, and beyond that a hub is a skewed key of a join of two
stored tables, which adaptive execution splits. Rounds are stored in shared storage, not in executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.common import Stored, small

#: Links that a task holds at once while cutting to a forest.
FOREST_ROWS = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)  # the old root follows
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def cut() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        own = nodes != root
        return nodes[own], root[own]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n > FOREST_ROWS:
            a, b = cut()
            if len(a) > FOREST_ROWS // 2:  # little to gain: pass it on
                yield out(a, b)
                held, n = [], 0
            else:
                held, n = [(a, b)], len(a)
    if n:
        yield out(*cut())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (a, b: long). Nodes without links aren't listed."""
    now = Stored(links.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long"), "links")
    before = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the smallest neighbours are stored and not part of the join's plan: few are broadcast, and else a hub's links are a
        # skewed partition of a plain shuffle join, which adaptive execution splits
        least = Stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "links-least")
        large = both.filter("b > a").join(small(least.df), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").mapInArrow(_forest, "a long, b long")
        mid = Stored(large, "links-large")
        low = mid.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        first = Stored(low.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "links-first")
        star = low.join(small(first.df), F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = Stored(star.filter("a <> b").distinct(), "links-star")
        for used in (least, first):
            used.drop()
        mid.drop()
        now.drop()
        state = new.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        now = new
        if state == before:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
