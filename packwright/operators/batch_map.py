"""User hook for batched maps: a function from a pandas batch to a pandas batch that
may change the row count (the reference's ``map(batched=True)`` contract). Spark
partitions and schedules the batches; Arrow moves them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rebatched(frames: Iterator[pd.DataFrame], batch_rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``batch_rows``, the last one shorter: what is left of a frame
    stands before the next, so the sizes in which rows come make no difference."""
    held, n = [], 0
    for f in frames:
        at = 0
        while n + len(f) - at >= batch_rows:
            cut = at + batch_rows - n
            yield pd.concat([*held, f.iloc[at:cut]], ignore_index=True)
            held, n, at = [], 0, cut
        if at < len(f):
            held.append(f.iloc[at:])
            n += len(f) - at
    if n:
        yield pd.concat(held, ignore_index=True)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str,
                batch_rows: int = 1000, index: str | None = None) -> DataFrame:
    """Apply ``fn`` to batches of exactly ``batch_rows`` rows (1000 is the reference's map batch).

    Without ``index``: consecutive rows of every partition, whatever the session's Arrow batch
    size; the last batch of a partition is shorter. With ``index`` (a column that numbers rows
    from 0): rows ``k * batch_rows`` and following of the whole table, in that order, whatever the
    partitions; only the table's last batch is shorter. A batch is what a task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rebatched(batches, batch_rows):
            out = fn(b)
            if out is not None and len(out):
                yield out

    if index is None:
        return df.mapInPandas(run, schema)

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted by index, and whole batches to a task: one ends where the number of the next begins
        held = None
        for f in batches:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            number = f[index] // batch_rows
            for k in number.unique()[:-1]:
                yield from run([f[number == k].reset_index(drop=True)])
            held = f[number == number.iloc[-1]] if len(f) else held
        if held is not None and len(held):
            yield from run([held.reset_index(drop=True)])

    batch = F.expr(f"`{index}` div {batch_rows}")
    return df.repartition(batch).sortWithinPartitions(batch, index).mapInPandas(numbered, schema)
