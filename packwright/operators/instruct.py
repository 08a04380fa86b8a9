"""Instruction data: union of sources, repeat removal, placeholder rewrite, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import template_replace
from packwright.operators.ordering import exact_split
from packwright.params import DEFAULT, Params

HISTORY_TYPE = "array<array<string>>"


def dedup_key(params: Params = DEFAULT, history: str = "history", instruction: str = "instruction",
              input_: str = "input") -> Column:
    """All history strings, then instruction and input. Compat mode joins them with no
    separator (distinct rows can collide); the default puts a unit separator between."""
    parts = F.concat(F.flatten(F.coalesce(F.col(history), F.array().cast(HISTORY_TYPE))),
                     F.array(F.col(instruction), F.col(input_)))
    return F.array_join(parts, "" if params.dedup_compat else params.key_separator)


def hashed(key: Column) -> Column:
    """A key of fixed size in place of a long text: 128-bit hash and length."""
    return F.concat(F.unhex(F.md5(key)), F.unhex(F.lpad(F.hex(F.length(key)), 8, "0")))


def dedup_first(df: DataFrame, key: Column, order_col: str, partition_cols: list[str] | None = None) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every key, within each partition
    value (e.g. source).

    One pass and one exchange: the first row of each hashed key is found map-side before
    the shuffle, so a key shared by a third of all rows sends one row per task."""
    parts = list(partition_cols or [])
    row = F.struct(*[F.col(c) for c in df.columns])
    d = df.select(*parts, hashed(key).alias("__key"), F.col(order_col).alias("__order"), row.alias("__row"))
    return d.groupBy(*parts, "__key").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def duplicate_report(df: DataFrame, key: Column) -> DataFrame:
    d = df.select(hashed(key).alias("__key"))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("__key").alias("n_distinct"),
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; ``source_rank`` keeps the concatenation order, a
    missing ``history`` becomes an empty list."""
    out = None
    for rank, f in enumerate(frames):
        f = f.withColumn("source_rank", F.lit(rank))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if "history" in out.columns:
        out = out.withColumn("history", F.coalesce(F.col("history"), F.array().cast(HISTORY_TYPE)))
    return out


def rewrite_placeholders(df: DataFrame, col: str = "output", params: Params = DEFAULT) -> DataFrame:
    return df.withColumn(col, template_replace(col, params.placeholder_values))


def split_train_test(df: DataFrame, key: str, params: Params = DEFAULT) -> DataFrame:
    return exact_split(df, key, params.test_fraction, params.seed)
