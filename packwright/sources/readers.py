"""Readers and writers: split pairs, JSON lines, shard listing, file audit,
partitioned parquet round trips. Schemas are always explicit (JSON inference mixes
string and list fields)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packwright.session import scratch_path
from packwright.sources.json_array import read_json_array, write_json_arrays  # noqa: F401

CORRUPT = "_corrupt_record"


_MADE: list[str] = []


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for one written table."""
    _MADE.append(scratch_path(spark, f"{name}-{uuid.uuid4().hex}"))
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Remove the folders that :func:`new_location` gave out in this process; results that read
    them are over by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _MADE:
        p = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


def read_splits(spark: SparkSession, fmt: str, train: list[str], validation: list[str],
                schema: StructType | str) -> DataFrame:
    """A train/validation pair of file lists as one frame with a ``split`` column."""
    def one(paths, name):
        r = spark.read.schema(schema).format(fmt)
        return r.load(paths).withColumn("split", F.lit(name))

    return one(train, "train").unionByName(one(validation, "validation"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, order_col: str | None = None,
               num_samples: int | None = None) -> DataFrame:
    """JSON lines; with ``num_samples`` the first n rows in ``order_col`` order
    (exactly n: the reference's reader returns one extra row)."""
    df = spark.read.schema(schema).json(path)
    if num_samples is not None:
        df = df.orderBy(order_col).limit(num_samples)
    return df


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """JSON lines, UTF-8 with non-ASCII kept, one file per task (never one whole array)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return path


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Persist prepared rows partitioned by split (readers prune on it)."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def list_shards(spark: SparkSession, base: str) -> list[str]:
    """Sorted child paths of a folder (metadata only: one entry per shard)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    names = [s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]
    return sorted(names)


def shard_subset(spark: SparkSession, base: str, num_shards: int, fmt: str = "parquet",
                 schema: StructType | str | None = None) -> DataFrame:
    """The first ``num_shards`` shards of a folder in sorted order (the reference takes
    the first files of an unsorted listing; sorting makes it reproducible)."""
    chosen = list_shards(spark, base)[:num_shards]
    r = spark.read.option("basePath", base)
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(chosen)


def audit_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """File health, one row per file: rows, sound rows and unparsable rows."""
    s = StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])
    df = spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    first = schema.fields[0].name  # referencing a data column keeps the raw-file scan legal
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(first).alias("n_valid"), F.count(CORRUPT).alias("n_corrupt"))


def audit_parquet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """File health, one row per file: its rows, and whether any could be read. The listing is
    Spark's own (paths only, no content); files that cannot be read give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("file"))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    read = rows.groupBy(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("file")).agg(
        F.count(F.lit(1)).alias("n"))
    return files.join(read, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"), F.col("n").isNotNull().alias("readable"))
