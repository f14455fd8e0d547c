"""Operation logs as streams: the last line per key, and the states of operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(stream: DataFrame, keys: Sequence[str], order: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The last line of each key so far (update or complete mode): a stateful aggregation of one row per key."""
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_t")).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in [*order, *rest]])


#: State after an event; an event that a state doesn't allow changes nothing.
MOVES = {("", "enqueue"): "queued", ("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "finish"): "success", ("running", "fail"): "failed"}


def step(state: str, cancelled: bool, event: str) -> tuple[str, bool]:
    """The next state; a cancel of a running operation counts when it ends, whatever its result."""
    if state == "running" and event == "cancel":
        return state, True
    new = MOVES.get((state, event), state)
    return ("cancelled", cancelled) if cancelled and new in ("success", "failed") else (new, cancelled)


def operation_states(stream: DataFrame) -> DataFrame:
    """(op_id, seq, status) after each event of (op_id, seq, event), in order of seq within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, cancelled = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            status, cancelled = step(status, cancelled, event)
            out.append((key[0], seq, status))
        state.update((status, cancelled))
        yield pd.DataFrame(out, columns=["op_id", "seq", "status"])

    return stream.groupBy("op_id").applyInPandasWithState(run, "op_id string, seq long, status string", "status string, cancelled boolean", "append", GroupStateTimeout.NoTimeout)


def unscanned(blocks: DataFrame, journal: DataFrame, keys: Sequence[str] = ("container", "idx")) -> DataFrame:
    """Blocks that a journal of earlier results doesn't know: where a scan goes on."""
    return blocks.join(journal.filter("state <> 0").select(*keys), list(keys), "left_anti")
