"""Distinct counts that can be stored and merged: one sketch for each group and shard, added up
later over any set of them without reading the rows again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12  # 2^12 registers, a few kilobytes a sketch
#: Relative standard error of an estimate is about 1.04 / sqrt(2^LG_K); results are held to three.
ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """keys, n_rows, sketch (binary) of the values of each key: partial sketches before the
    shuffle, so a large group sends one sketch a task. Null values are not counted."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, sketch: stored sketches added up over all columns but ``keys``."""
    return sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, out: str = "n_distinct") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
