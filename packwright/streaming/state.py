"""Stateful stream operators on value state and timers (RocksDB state store): the first occurrence
of a key under late arrival, and packing that carries a remainder from one micro-batch to the next.

State is as large as its keys: one row for a key within the watermark, and less than one packed
row for a lane. Both operators restart from their checkpoint.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from packwright.params import DEFAULT, Params

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# names that a state function sees as they are (it renames those with a leading underscore)
KEY = "packwright_key"
EVENT = "packwright_event_ms"


@contextmanager
def rocksdb(spark: SparkSession):
    """For queries started inside: value state and timers need this state store. The setting goes
    back afterwards; a query keeps the one it was started with, also when it is restarted."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else v.item() if isinstance(v, np.generic) else v


class First(StatefulProcessor):
    """Holds the row of least order of a key; hands it on when its timer is due."""

    def __init__(self, schema: str, names: list[str], order_col: str, delay_ms: int):
        self.schema, self.names, self.order_col, self.delay_ms = schema, names, order_col, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.least = handle.getValueState("least", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.least.get()) if self.least.exists() else None
        at = self.names.index(self.order_col)
        for frame in rows:
            i = int(frame[self.order_col].to_numpy().argmin())
            if held is None:
                # copies within the delay of the first one seen are older than this when it is due
                self.handle.registerTimer(int(frame[EVENT].min()) + self.delay_ms)
            if held is None or frame[self.order_col].iloc[i] < held[at]:
                held = tuple(_plain(frame[c].iloc[i]) for c in self.names)
        self.least.update(held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.least.exists():
            row = self.least.get()
            self.least.clear()
            yield pd.DataFrame({c: pd.Series([v], dtype=object) for c, v in zip(self.names, row)})

    def close(self) -> None:
        pass


def first_occurrences(stream: DataFrame, key: str, order_col: str, event_time: str, delay_seconds: int) -> DataFrame:
    """The row of least ``order_col`` (a whole number) of each ``key`` among copies whose event
    times are within ``delay_seconds`` of each other, whatever order they arrive in. A row leaves
    when the watermark (``delay_seconds`` behind the latest event time) has passed its key, so
    what is handed on is final, and state holds one row for each key within it. Other columns are
    strings, numbers and booleans; ``event_time`` is not returned. Null keys are one key."""
    names = [c for c in stream.columns if c != event_time]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name != event_time)
    marked = stream.select(F.md5(F.to_json(F.struct(F.col(key)))).alias(KEY), "*", F.unix_millis(event_time).alias(EVENT))
    return marked.withWatermark(event_time, f"{delay_seconds} seconds").groupBy(KEY).transformWithStateInPandas(
        First(schema, names, order_col, 1000 * delay_seconds), schema, "append", "EventTime")


FRAME = 256  # packed rows handed on together


class Carry(StatefulProcessor):
    """Packs a lane's tokens; what is left over waits for the next micro-batch."""

    def __init__(self, groups: list[str], order_col: str, ids_col: str, length: int, flush_ms: int | None):
        self.groups, self.order_col, self.ids_col, self.length, self.flush_ms = groups, order_col, ids_col, length, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "tail array<int>, chunk long")

    def handleInputRows(self, key, rows, timerValues):
        tail, chunk = self.tail.get() if self.tail.exists() else ([], 0)
        # a lane's share of one micro-batch, put in order: the trigger bounds it
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order_col)[self.ids_col]
        flat = np.concatenate([np.asarray(tail, dtype=np.int32), *(np.asarray(x, dtype=np.int32) for x in batch)])
        n = len(flat) // self.length
        self.tail.update((flat[n * self.length :].tolist(), chunk + n))
        if self.flush_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if len(flat) > n * self.length:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)
        packed = flat[: n * self.length].reshape(n, self.length)
        for i in range(0, n, FRAME):
            yield self.out(key, range(chunk + i, chunk + min(i + FRAME, n)), list(packed[i : i + FRAME]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        tail, chunk = self.tail.get() if self.tail.exists() else ([], 0)
        if len(tail):
            self.tail.update(([], chunk + 1))
            yield self.out(key, [chunk], [list(tail)])

    def out(self, key, chunks, ids) -> pd.DataFrame:
        return pd.DataFrame({**{c: [k] * len(ids) for c, k in zip(self.groups, key)}, "chunk": list(chunks), "input_ids": ids})

    def close(self) -> None:
        pass


def carry_over_pack(stream: DataFrame, group_cols: list[str], order_col: str, ids_col: str, params: Params = DEFAULT,
                    flush_idle_seconds: int | None = None) -> DataFrame:
    """Pack across micro-batches: per group the remainder (< max_length tokens) is kept in state
    and stands before the next batch's tokens, so no tokens are dropped at batch borders. With
    ``flush_idle_seconds`` a group that gets nothing for so long hands on its remainder as a
    shorter row (by timers of processing time, so the trigger must go on: available-now would
    wait for the next one for ever). A group is one task at a time: put a lane of the key (see
    ``incremental.with_lane``) into ``group_cols``, so that a source that holds a third of the rows
    is packed by many tasks, each with its share of a micro-batch."""
    schema = ", ".join([f"{c} string" for c in group_cols]) + ", chunk long, input_ids array<int>"
    flush = None if flush_idle_seconds is None else 1000 * flush_idle_seconds
    return stream.select(*group_cols, order_col, ids_col).groupBy(*group_cols).transformWithStateInPandas(
        Carry(group_cols, order_col, ids_col, params.max_length, flush), schema, "append",
        "None" if flush is None else "ProcessingTime")
