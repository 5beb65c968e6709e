"""Numeric state per task, merged as a tree.

For sums whose state is a block of numbers (a k x k matrix, say): every task
reduces its Arrow batches to one state, and states are merged ``fan`` at a time
in the order of their tasks. A state is one binary value, never exploded into
cells; at most ``fan`` of them meet in a task, and at the driver as many as make
``DRIVER_BYTES`` or one. The order is fixed, so the same splits give the same bits again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import settle_table

#: Bytes of states that may meet at one place.
MEETING_BYTES = 64 << 20
#: Bytes of states that may meet at the driver, which holds each several times: in Spark, on the way and in Python.
DRIVER_BYTES = 4 << 20
_SCHEMA = "slot long, state binary"


def fan_in(state_bytes: int) -> int:
    return max(2, min(32, MEETING_BYTES // max(state_bytes, 1)))


def tree_reduce(
    df: DataFrame,
    accumulate: Callable[[Iterator[pa.RecordBatch]], bytes | None],
    merge: Callable[[bytes, bytes], bytes],
    state_bytes: int,
) -> bytes | None:
    """The merged state of all rows of ``df``; None without any.

    ``accumulate`` takes a task's batches and gives its state, or None for a task
    without rows; ``merge`` takes two states, the earlier first.
    """
    fan = fan_in(state_bytes)

    def reduce(batches):
        state = accumulate(batches)
        if state is not None:
            yield _batch([TaskContext.get().partitionId()], [state])

    def join(batches):
        slot, held = None, None
        for batch in batches:
            for group, state in zip(*(c.to_pylist() for c in batch.columns)):
                if group != slot and held is not None:
                    yield _batch([slot], [held])
                    held = None
                slot, held = group, state if held is None else merge(held, state)
        if held is not None:
            yield _batch([slot], [held])

    states = settle_table(df.mapInArrow(reduce, _SCHEMA), "states")
    few = max(1, min(fan, DRIVER_BYTES // max(state_bytes, 1)))
    while (left := states.count()) > few:
        dealt = states.withColumn("group", F.expr(f"slot div {fan}")).repartition(-(-left // fan), "group").sortWithinPartitions("group", "slot")
        states = settle_table(dealt.select(F.col("group").alias("slot"), "state").mapInArrow(join, _SCHEMA), "states")
    total = None
    for row in sorted(states.collect()):
        total = bytes(row.state) if total is None else merge(total, bytes(row.state))
    return total


def _batch(slots: list[int], states: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(states, pa.binary())], names=["slot", "state"])
