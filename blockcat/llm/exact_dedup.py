"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All blocks are sorted; a block's name is its rank among the
distinct ones, an integer. Then adjacent names are paired, the pairs sorted and ranked in the same way, and so on until
each text has one name: two texts of equally many blocks are equal exactly if their names are. Names are ranks, not
hashes, so nothing can collide.

Sorting is a range shuffle whose order includes the row's own key, so a block that a third of all rows hold spreads over
many tasks. Blocks are sorted by a hash first and by themselves then, which keeps the sampled range boundaries small;
should blocks of one hash fall where two ranges meet, they are sorted anew by themselves alone. Each task ranks what it has; a table of one row per task (its first and last value, its distinct values)
gives the offsets. Each level halves the rows; a text of n blocks takes part in ceil(log2 n) + 1 levels.

Defined cases: a null text counts as empty; empty texts are equal to each other; a row repeated with the same doc_id and
text counts in ``group_size`` each time, and one of them stays; an empty table gives an empty result; null doc_ids sort
below all others; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockcat.llm.common import first_of_each, Stored, fresh, partitions, small, stored

BLOCK_BYTES = 1024


def _rank(values: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranks of rows sorted by ``h`` and values within their task. Rows of negative ``idx`` follow for the task's first and
    last values; ``mixed`` tells whether other values share their ``h`` here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, rank, last, first = TaskContext.get().partitionId(), -1, None, None
        runs, in_first, in_last = 0, 0, 0  # runs of equal h so far, and distinct values in the first and the last one
        names = ["id", "sha", "n", "idx", "part", "rank", "mixed", *[f"edge_{v}" for v in ("h", *values)]]
        kinds: list[pa.DataType] = []
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(v) for v in ("h", *values)]
            kinds = [c.type for c in cols]
            differs = [np.concatenate([[False], pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)]) for c in cols]
            head = tuple(c[0].as_py() for c in cols)
            new, new_run = np.any(differs, axis=0), differs[0]
            new[0], new_run[0] = head != last, last is None or head[0] != last[0]
            first = head if first is None else first
            run_of = runs + np.cumsum(new_run)
            in_last = int(new[run_of == run_of[-1]].sum()) + (in_last if run_of[-1] == runs else 0)
            in_first += int(new[run_of == 1].sum())
            runs = int(run_of[-1])
            ranks = rank + np.cumsum(new)
            rank, last = int(ranks[-1]), tuple(c[n - 1].as_py() for c in cols)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sha"), b.column("n"), b.column("idx"), pa.array(np.full(n, pid, dtype=np.int32)), pa.array(ranks), pa.nulls(n, pa.bool_()), *[pa.nulls(n, t) for t in kinds]], names=names)
        if first is not None:
            edges = [pa.array([a, z], type=t) for t, a, z in zip(kinds, first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.nulls(2, pa.binary()), pa.nulls(2, pa.int64()), pa.array([-1, -2], type=pa.int64()), pa.array([pid, pid], type=pa.int32()), pa.array([rank, rank], type=pa.int64()), pa.array([in_first > 1, in_last > 1]), *edges], names=names)

    return run


def _named(rows: DataFrame, values: list[str], label: str, parts: int, by_hash: bool = False) -> tuple[DataFrame, Stored]:
    """(id, sha, n, idx, name): the rank of each row's values among all rows' distinct ones; and the table behind it, sorted in
    ``parts`` tasks.

    ``by_hash`` sorts by a hash of the values first, so that range boundaries are small whatever the values are. Equal
    values still stand together, unless two values of one hash meet where two tasks' ranges do: then all is sorted anew
    by the values alone.
    """
    kinds = ", ".join(f"edge_{v} {dict(rows.dtypes)[v]}" for v in values)
    keyed = rows.withColumn("h", F.xxhash64(*values) if by_hash else F.lit(0).cast("long"))
    dealt = keyed.repartitionByRange(parts, *(["h"] if by_hash else values), "id", "idx").sortWithinPartitions("h", *values)
    table = Stored(dealt.mapInArrow(_rank(values), f"id long, sha binary, n long, idx long, part int, rank long, mixed boolean, edge_h long, {kinds}"), label)
    edge = F.struct(*[f"edge_{v}" for v in values])
    ends = table.df.filter("idx < 0").groupBy("part").agg(F.max("rank").alias("top"), *[F.max(F.when(F.col("idx") == k, F.struct("edge_h", "mixed", edge.alias("v")))).alias(a) for k, a in ((-1, "first"), (-2, "last"))])
    by = Window.partitionBy(F.lit(0)).orderBy("part")
    ahead = F.lag("last").over(by)
    ends = ends.withColumn("same_h", F.coalesce(F.col("first.edge_h") == ahead["edge_h"], F.lit(False))).withColumn("same", F.coalesce(F.col("first.v") == ahead["v"], F.lit(False))).withColumn("mixed", F.col("first.mixed") | F.coalesce(ahead["mixed"], F.lit(False)))
    base = F.coalesce(F.sum(F.col("top") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum(F.col("same").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ends = stored(ends.select(F.col("part").alias("_part"), base.alias("_base"), (F.col("same_h") & (F.col("mixed") | ~F.col("same"))).alias("torn")), f"{label}-base")
    if by_hash and ends.filter("torn").limit(1).count():
        table.drop()
        return _named(rows, values, label, parts)
    return table.df.filter("idx >= 0").join(small(ends), F.col("part") == F.col("_part")).select("id", "sha", "n", "idx", (F.col("rank") + F.col("_base")).alias("name")), table


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, sha, copies, n, name): one row per distinct (doc_id, text); (n, name) is the text's identity."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(body, 256)).alias("sha"), body.alias("body"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("long"))
    blocks = rows.select("id", "sha", "n", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    blocks = blocks.select("id", "sha", "n", "idx", F.substring("body", (F.col("idx") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("block"))
    most = partitions(docs.sparkSession)
    named, table = _named(blocks, ["block"], "blocks", most, by_hash=True)
    copies = stored(named.filter("idx = 0").groupBy("id", "sha", "n").agg(F.count("*").alias("copies")), "copies")
    widest, total = table.df.agg(F.max("n"), F.count("*")).first()
    # a row repeated with the same id and text repeats its blocks and their names: one of each goes on
    done = stored(named.filter("n = 1").groupBy("id", "sha", "n").agg(F.max("name").alias("name")), "names-1")
    names, level, before = named.filter("n > 1"), 0, table
    while 2**level < (widest or 1):
        level += 1
        pairs = names.groupBy("id", "sha", "n", F.expr("idx div 2").alias("idx")).agg(*[F.coalesce(F.max(F.when(F.col("idx") % 2 == k, F.col("name"))), F.lit(-1)).alias(a) for k, a in ((0, "a"), (1, "b"))])
        rows = Stored(pairs, f"pairs-{level}")
        before.drop()
        parts = max(1, math.ceil(most * rows.df.count() / total))  # as many rows to a task as at first: a level halves the rows, and so tasks and files
        names, before = _named(rows.df, ["a", "b"], f"names-{level + 1}", parts)
        rows.drop()
        whole = F.col("n") <= 2**level
        done = done.unionByName(stored(names.filter(whole).select("id", "sha", "n", "name"), f"whole-{level}"))
        names = names.filter(~whole)
    before.drop()
    ids = done.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "name")
    return copies.join(ids, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).select(F.col("id").alias("doc_id"), "sha", "copies", "n", "name")


def duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id of equal texts), group_size, kept, text_sha256."""
    named = stored(identities(docs, block_bytes), "identities")
    # stored, so that adaptive execution can split a class that very many rows share
    classes = stored(named.groupBy(F.col("n").alias("_n"), F.col("name").alias("_name")).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "classes")
    rows = named.join(classes, (F.col("n") == F.col("_n")) & (F.col("name") == F.col("_name")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    own, key, sha = fresh(docs, "_own", "_id", "_sha")
    kept = stored(duplicates(docs, block_bytes).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)), "kept")
    rows = docs.withColumn(own, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    found = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    return first_of_each(found, ["doc_id", own], docs.columns) if repeated else found.drop(own)
