"""Intermediate tables in shared storage, and running totals over frames of any order.

Intermediate results are Parquet tables under the folder named by ``spark.checkpoint.dir``, which the driver and all
executors share: a lost executor costs a re-read, never a wrong answer. A local temporary folder serves only a local master
(tests on one machine); on a cluster without that setting nothing is written and an error says so.

A lazy frame needs its tables for as long as it is used, so they are deleted at exit, by ``drop``, or, as soon as a result
is written, by ``scratch``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Most rows that a side table may have to be broadcast (rows here are a few numbers wide: at most a few MB).
BROADCAST_ROWS = 50_000
#: Integer places that one task sums.
CHUNK = 1 << 16

_root: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; on a local master one of its own where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _root:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="blockcat-")
        _root[app] = f"{base.rstrip('/')}/blockcat-{uuid.uuid4().hex[:12]}"
        atexit.register(lambda: _delete_quietly(spark, _root[app]))
    return _root[app]


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone at exit; the folder is then left to the cluster's clean-up
        pass


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Stored:
    """A frame written once to shared storage: ``df`` reads it back, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(self.path)
        _made.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)
        if (self.spark, self.path) in _made:
            _made.remove((self.spark, self.path))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame, written once and read again: its cost is not paid twice, and its values no longer change."""
    return Stored(df, label).df


@contextmanager
def scratch() -> Iterator[list[Stored]]:
    """Deletes what was stored inside, but for the tables put in the list: for work whose result is written at its end."""
    start, keep = len(_made), []
    try:
        yield keep
    finally:
        kept = {x.path for x in keep}
        for spark, path in [x for x in _made[start:] if x[1] not in kept]:
            delete(spark, path)
            _made.remove((spark, path))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if a count shows at most ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has such columns (in whatever case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def changes(column: pa.Array, before: object, any_before: bool) -> np.ndarray:
    """True where a value differs from the one before it (null equals null); ``before`` precedes the first."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        out[1:] = np.where(_np(pc.is_null(a)) | _np(pc.is_null(b)), _np(pc.is_null(a)) != _np(pc.is_null(b)), _np(pc.fill_null(pc.not_equal(a, b), False)))
    if n and any_before:
        out[0] = column[0].as_py() != before
    return out


def _np(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _local_totals(group: str | None, value: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total, last, seen = TaskContext.get().partitionId(), 0, None, False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = np.ones(n, dtype=np.int64) if value is None else b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            if group is None:
                out, total = before + total, total + int(v.sum())
            else:
                new = changes(b.column(group), last, seen)
                heads = np.flatnonzero(new)
                base = np.zeros(n, dtype=np.int64)  # what to take off: the sum before the row's group began
                base[heads] = before[heads]
                at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                out = before - np.where(at >= 0, base[np.maximum(at, 0)], 0) + np.where(at >= 0, 0, total)
                total, last, seen = int(out[-1] + v[-1]), b.column(group)[n - 1].as_py(), True
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(out)], names=[*b.schema.names, "_part", "_before"])

    return run


def running_totals(df: DataFrame, order: Sequence[str], value: str | None = None, group: str | None = None, label: str = "totals", tasks: int | None = None, around: Callable = lambda work: work) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` (rows, if None) over the rows that precede in ``order`` (within ``group``,
    which must be the first of ``order``).

    Rows are range-partitioned on all of ``order``, so one group spreads over as many tasks as it needs; each task sums
    what it has, and the tasks' totals (one row per task and group in it) give the offsets. Range partitioning reads
    its input twice, so ``df`` should be a stored or cheap frame. Nulls sort first and form one group. ``tasks`` is for a
    caller that knows how many rows there are, ``around`` for what the Python workers have to do first.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(tasks or partitions(spark), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = stored(dealt.mapInArrow(around(_local_totals(group, value)), f"{kinds}, _part int, _before long"), label)
    keys = ["_part"] + ([group] if group else [])
    sums = local.groupBy(*keys).agg((F.sum(value) if value else F.count("*")).alias("_sum"))
    ahead = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).select(*[F.col(k).alias(f"_o{k}") for k in keys], "_offset"), f"{label}-offsets")
    same = [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    return local.join(small(offsets), on, "left").withColumn("before", F.col("_before") + F.coalesce("_offset", F.lit(0))).select(*df.columns, "before")


def _with_heads(df: DataFrame, container: str, at: str, value: str, chunk: int, of_chunk: Callable[[Column, Column], Column], of_chunks: Callable[[Column], Column]) -> tuple[DataFrame, WindowSpec, str, str]:
    """Rows cut into chunks of integer places, each led by a row that carries what ``of_chunks`` makes of the chunks before it."""
    row, part, lead, place, carried = fresh(df, "_row", "_chunk", "_lead", "_at", "_carried")
    cut = df.select(F.col(container), F.call_function("div", F.col(at).cast("long"), F.lit(chunk)).alias(part), F.col(at).cast("long").alias(place), F.col(value).cast("long").alias(carried), F.struct(*df.columns).alias(row))
    by = Window.partitionBy(container).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy(container, part).agg(of_chunk(F.col(carried), F.col(place)).alias(carried))
    heads = heads.select(container, part, F.lit(0).alias(lead), F.lit(None).cast("long").alias(place), of_chunks(F.col(carried)).over(by).alias(carried), F.lit(None).cast(cut.schema[row].dataType).alias(row))
    both = heads.unionByName(cut.withColumn(lead, F.lit(1)))
    return both, Window.partitionBy(container, part).orderBy(lead, place), row, carried


def sum_before(df: DataFrame, container: str, at: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the container whose integer place ``at`` is smaller.

    No container is one task's: chunks of places are summed first (a row each, combined before the shuffle), and each
    chunk's window begins with the sum of those before it. Places are distinct within a container.
    """
    both, by, row, carried = _with_heads(df, container, at, value, chunk, lambda v, place: F.sum(v), F.sum)
    total = F.coalesce(F.sum(carried).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    (own,) = fresh(df, "_total")
    return both.withColumn(own, total).filter(F.col(row).isNotNull()).select(f"{row}.*", F.col(own).alias(name))


def value_before(df: DataFrame, container: str, at: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row with the next smaller place in the container; null for the first."""
    both, by, row, carried = _with_heads(df, container, at, value, chunk, lambda v, place: F.max_by(v, place), lambda v: F.last(v, ignorenulls=True))
    (own,) = fresh(df, "_total")
    return both.withColumn(own, F.lag(carried).over(by)).filter(F.col(row).isNotNull()).select(f"{row}.*", F.col(own).alias(name))
