"""The order in which files go through a limited amount of space.

By path, a file's credit is what the files before it have gained: a running total. The greedy order depends on each choice, so
it is a fold over one container's files, with heaps instead of a search per step.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.operators import layout, oplog
from blockcat.operators.shared import fresh, sum_before

# Budget and reserve where none are given.
BUDGET, RESERVE = 1 << 30, 128 << 20


def start_credit(budget: int = 0, reserve: int = 0) -> int:
    budget = budget or BUDGET
    reserve = reserve or (budget // 8 if budget <= 2 * RESERVE else RESERVE)
    return budget - (0 if reserve >= budget else reserve)


def by_path(files: DataFrame, container: str, credit: int) -> DataFrame:
    """``credit`` before each file, and ``reverse_required`` where its predicted size exceeds that."""
    gain, order = fresh(files, "_gain", "_order")
    rows = files.withColumn(gain, F.greatest(F.lit(0).cast("long"), F.col("size") - F.col("predicted")))
    rows = layout.by_path(rows, container).withColumnRenamed("before", order)
    rows = sum_before(rows, container, order, gain, "credit").withColumn("credit", F.lit(credit).cast("long") + F.col("credit"))
    return rows.drop(gain).withColumnRenamed(order, "schedule_order").withColumn("reverse_required", F.col("predicted") > F.col("credit"))


def greedy_order(sizes: list[int], predicted: list[int], names: list[str], credit: int) -> list[tuple[int, bool]]:
    """(file, reverse required) in order: the best file that fits the credit, else the largest; each adds its gain."""
    n = len(sizes)
    gain = [max(0, s - p) for s, p in zip(sizes, predicted, strict=True)]
    folded = [(x.translate({c: c + 32 for c in range(65, 91)}), x) for x in names]
    waiting = sorted(range(n), key=lambda i: (predicted[i], i), reverse=True)
    fits: list[tuple] = []
    by_size = [(-sizes[i], folded[i], i) for i in range(n)]
    heapq.heapify(by_size)
    used, out = [False] * n, []
    while len(out) < n:
        while waiting and predicted[waiting[-1]] <= credit:
            i = waiting.pop()
            heapq.heappush(fits, (gain[i] <= 0, -sizes[i], -gain[i], folded[i], i))
        while fits and used[fits[0][-1]]:
            heapq.heappop(fits)
        if fits:
            i, reverse = heapq.heappop(fits)[-1], False
        else:
            while used[by_size[0][-1]]:
                heapq.heappop(by_size)
            i, reverse = heapq.heappop(by_size)[-1], True
        used[i] = True
        out.append((i, reverse))
        credit += gain[i]
    return out


def greedy(files: DataFrame, container: str, credit: int) -> DataFrame:
    """(container, rel, schedule_order, reverse_required): one container at a time, as each choice depends on those before."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        order = greedy_order(g["size"].tolist(), g["predicted"].tolist(), g["rel"].tolist(), credit)
        at = [i for i, _ in order]
        return pd.DataFrame({container: g[container].iloc[at].values, "rel": g["rel"].iloc[at].values, "schedule_order": range(len(at)), "reverse_required": [r for _, r in order]})

    kind = dict(files.dtypes)[container]
    return files.select(container, "rel", "size", "predicted").groupBy(container).applyInPandas(run, f"`{container}` {kind}, rel string, schedule_order long, reverse_required boolean")


def credit_now(state: DataFrame, container: str, budget: int, reserve: int) -> DataFrame:
    """Credit of a running job from its files' (original, committed, reverse_temp) and output bytes."""
    base = budget - reserve if budget > reserve else budget
    sums = state.groupBy(container).agg(F.sum(F.least("committed", "original")).alias("freed"), F.sum("reverse_temp").alias("temp"), F.max("output").alias("output"))
    return sums.withColumn("credit", F.greatest(F.lit(0).cast("long"), F.lit(base) + F.col("freed") - F.col("output") - F.col("temp")))


def resume(plan: DataFrame, journal: DataFrame, container: str) -> DataFrame:
    """Where a broken-off job goes on, per container: (done, freed, next, partial).

    ``plan`` has (container, rel, schedule_order, size), ``journal`` the job's lines (container, rel, seq, state, committed), of which
    a file's last one counts. ``done`` files need nothing more; ``freed`` bytes of sources are gone; ``next`` is the first file in
    the order that isn't done (null if all are), and ``partial`` its committed bytes.
    """
    last = oplog.latest(journal, [container, "rel"], ["seq"], ["state", "committed"]).select(container, "rel", "state", "committed")
    rows = plan.join(last, [container, "rel"], "left")
    done = F.coalesce(F.col("state") == "done", F.lit(False))
    gone = F.when(done, F.col("size")).otherwise(F.least(F.coalesce("committed", F.lit(0).cast("long")), F.col("size")))
    first = F.min(F.when(~done, F.struct("schedule_order", F.coalesce("committed", F.lit(0).cast("long")).alias("committed"))))
    sums = rows.groupBy(container).agg(F.count_if(done).alias("done"), F.sum(gone).alias("freed"), first.alias("_first"))
    return sums.select(container, "done", "freed", F.col("_first.schedule_order").alias("next"), F.col("_first.committed").alias("partial"))
