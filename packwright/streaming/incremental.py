"""Structured Streaming forms of the batch jobs: newly landed shards are cleaned and
encoded incrementally, packed per micro-batch (idempotent per batch id), or de-duplicated
within a watermark. ``state`` has the operators that keep state of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packwright.streaming.state import rocksdb

BATCHES = 4  # micro-batches that a landed table makes at least, if not told otherwise
BATCH_BYTES = 512 << 20  # of files in a micro-batch: a larger table makes more of them


def land(df: DataFrame, path: str, key: str, unit: str | None = None, files: int | None = None) -> str:
    """Land a table as ``files`` key-ordered files, the way a stream would see shards arrive. By
    default as many as Spark has shuffle partitions, so that no task sorts more than its share.

    One distributed write: rows are range-partitioned on ``unit`` (default ``key``), so
    rows sharing a unit are never split across files, sorted by ``key`` inside each
    file. File modification times are then set in key order (metadata only), so a file
    stream (oldest first) reads them in order; on a store that ignores them the order of
    arrival is the store's. A test-side helper: in production files arrive from upstream."""
    part = F.col(unit) if unit else F.col(key)
    files = files or max(BATCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(files, part).sortWithinPartitions(key).write.parquet(path)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    files = sorted((s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    t0 = int(__import__("time").time() * 1000) - 1000 * (len(files) + 1)
    for i, f in enumerate(files):
        fs.setTimes(f, t0 + 1000 * i, -1)
    return path


def files_a_batch(spark: SparkSession, path: str, batches: int = BATCHES, most_bytes: int = BATCH_BYTES) -> int:
    """Files of a micro-batch if what lies in ``path`` is to make ``batches`` of them, or more where
    they would be larger than ``most_bytes``: what a task holds does not grow with the table."""
    from packwright.sources.readers import list_shards

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    n = len(list_shards(spark, path))
    return max(1, -(-n // max(batches, -(-size // most_bytes))))


def source(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> str:
    """Process everything available now into a parquet sink and stop (restartable from
    the checkpoint; the file sink is exactly-once)."""
    with rocksdb(stream.sparkSession):
        q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start(out))
        q.awaitTermination()
    return out


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """foreachBatch driver; ``fn`` must write idempotently keyed by batch id."""
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def dedup_within_watermark(stream: DataFrame, key_cols: list[str], event_time: str, delay: str) -> DataFrame:
    """Keep one row per key among rows whose event times are within ``delay``;
    state for a key is dropped once the watermark passes it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key_cols)


def with_lane(df: DataFrame, key: str, block: int, lanes: int, out: str = "lane") -> DataFrame:
    """Blocks of ``block`` consecutive keys dealt out to ``lanes`` packing lanes in turn."""
    return df.withColumn(out, F.expr(f"cast({key} div {block} % {lanes} as string)"))
