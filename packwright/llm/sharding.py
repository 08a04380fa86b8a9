"""Sharding by histogram sort: whole rows in shards of nearly equal bytes, exchanged once.

Rows are ordered by (hash of the text, hash of the id, hash of the row's number), 192 bits in
all: texts are well mixed, equal texts stand side by side, and even a row repeated for a third of
the table can be cut anywhere. The shards are ranges of that order. Splitters are found by
counting: each round, every partition of the keys counts rows and exact bytes below a few
probes for each splitter that is still open; the sums (a row per probe) and the least and
greatest key between probes narrow the interval of each splitter, until a boundary within
``tolerance`` of a shard's bytes is met, or one key is left. Probes fall between texts as long as
an interval holds several, so a group of equal texts is cut only where that tolerance asks for it.
Shards are cut further into parts of about ``part_mb`` MB of text, the unit of a task; then the
rows are exchanged once, straight to the number of their part, sorted and written.

Format: folders ``rows/shard=N`` of Parquet files, one a part (and ``schema``, an empty file): columns ``row`` (all
columns of the table, whatever their names), ``size`` (UTF-8 bytes of the text and ``OVERHEAD``),
``part`` and ``at`` (place in the part). A row's slot in its shard is ``at`` plus the rows of
the shard's parts before its own, one number per part.

What meets on the driver is ``PROBES`` numbers per part, not per row, and there are at most
``MOST_PARTS``. Which row of several that
agree in id and text goes below a splitter may change if a lost task is run again on other
partitions; no row is lost or doubled by it, and slots are counted in what is written.

Defined cases: a null text has no bytes; null and repeated ids and repeated rows are rows of
their own; fewer rows than shards leave shards empty; no boundary is nearer than one row, so a
shard may be off by half of its largest row; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.llm import common as C
from packwright.session import scratch_path

OVERHEAD = 8  # bytes that a row counts besides its text
PROBES = 12  # of each open splitter in a round
PART_MB = 32
MOST_PARTS = 50_000  # of all shards; parts of larger tables are larger
TOLERANCE = 0.005  # of a shard's bytes
PART_TOLERANCE = 0.1  # of a part's bytes
KEY = ["a", "b", "c"]
KEY_END = 1 << 192
TEXT_BITS = 128  # of a key, below the hash of the text
BROADCAST_PARTS = 500_000  # rows of 20 bytes


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, a, b, c (the key's words), size."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(text).alias("a"),
                       F.xxhash64(docs[f"`{id_col}`"]).alias("b"), F.monotonically_increasing_id().alias("c"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    return rows.select("row", "a", "b", F.xxhash64("c").alias("c"), (F.col("size") + OVERHEAD).alias("size"))


def packed(*words: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort like the words, as unsigned numbers."""
    out = np.empty((len(words[0]), len(words)), dtype=">u8")
    for i, w in enumerate(words):
        out[:, i] = w.view(np.uint64)
    return out.view(f"S{8 * len(words)}").reshape(-1)


def as_key(number: int) -> bytes:
    return number.to_bytes(24, "big")


def as_number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def key_array(numbers: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(map(as_key, numbers)), dtype="S24")


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """For each stretch between neighbouring probes (number of probes at or below its keys) that
    holds rows: its bytes, least and greatest key."""
    sent = keys.sparkSession.sparkContext.broadcast(key_array(probes))
    schema = "stretch int, size long, least binary, most binary"
    types = C.pa_schema(keys.sparkSession, schema)

    def run(batches):
        limits = sent.value
        size = np.zeros(len(limits) + 1, dtype=np.int64)
        least, most = np.full(len(size), b"\xff" * 24, dtype="S24"), np.zeros(len(size), dtype="S24")
        for b in batches:
            if not b.num_rows:
                continue
            k = packed(*(b.column(c).to_numpy(zero_copy_only=False) for c in KEY))
            order = np.argsort(k)
            k, s = k[order], b.column("size").to_numpy(zero_copy_only=False)[order]
            edge = np.concatenate(([0], np.searchsorted(k, limits, "left"), [len(k)]))
            total = np.concatenate(([0], np.cumsum(s)))
            size += np.diff(total[edge])
            met = np.flatnonzero(np.diff(edge))
            low, high = k[edge[met]], k[edge[met + 1] - 1]
            least[met] = np.where(low < least[met], low, least[met])
            most[met] = np.where(high > most[met], high, most[met])
        met = np.flatnonzero(size)
        if len(met):
            # numpy drops zeros at the end of a byte string
            whole = [[bytes(x).ljust(24, b"\0") for x in ends[met].tolist()] for ends in (least, most)]
            yield C.to_batch({"stretch": met.astype(np.int32), "size": size[met], "least": whole[0], "most": whole[1]}, types)

    parts = C.arrow_stream(keys.select(*KEY, "size"), run, schema)
    sums = parts.groupBy("stretch").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r.stretch: (r.size, as_number(r.least), as_number(r["most"])) for r in sums.collect()}


def unlike_above(least: int, most: int) -> int:
    """Bits below which boundaries need not look: those below the text if the keys have different
    texts, below the id if different ids."""
    return next((bits for bits in (TEXT_BITS, TEXT_BITS // 2) if least >> bits != most >> bits), 0)


class Splitter:
    """The boundary of ``target`` bytes: somewhere in [lo, hi], with the exact bytes below both."""

    def __init__(self, target: float, tolerance: float, total: int):
        self.target, self.tolerance = target, tolerance
        self.lo, self.below_lo, self.hi, self.below_hi = 0, 0, KEY_END, total
        self.at: int | None = None

    def probes(self, n: int) -> list[int]:
        """Boundaries to count next, in (lo, hi)."""
        bits = unlike_above(self.lo, self.hi - 1)
        lo, hi = self.lo >> bits, self.hi >> bits
        found = {lo + (hi - lo) * i // (n + 1) for i in range(1, n + 1)} | {lo + 1, hi - 1}
        return [x << bits for x in found if lo < x < hi]

    def narrow(self, least: int, below_lo: int, most: int, below_hi: int) -> None:
        """The target lies in the stretch of the keys least to most."""
        bits = unlike_above(least, most)
        self.lo, self.below_lo = (least >> bits) << bits, below_lo
        self.hi, self.below_hi = ((most >> bits) + 1) << bits, below_hi
        under, over = self.target - below_lo, below_hi - self.target
        if min(under, over) <= self.tolerance or least == most:
            self.at = self.lo if under <= over else self.hi


def splitters(keys: DataFrame, total: int, cuts: list[tuple[float, float]]) -> list[int]:
    """Sorted boundaries near each of ``cuts`` (bytes below, tolerance)."""
    all_of = [Splitter(target, tolerance, total) for target, tolerance in cuts]
    while open_ones := [s for s in all_of if s.at is None]:
        shared: dict[tuple[int, int], int] = {}
        for s in open_ones:
            shared[s.lo, s.hi] = shared.get((s.lo, s.hi), 0) + 1
        probes = sorted({p for s in open_ones for p in s.probes(PROBES * shared[s.lo, s.hi])} | {s.lo for s in open_ones}
                        | {s.hi for s in open_ones if s.hi < KEY_END})
        found = histogram(keys, probes)
        stretches, below = [], 0
        for i in sorted(found):
            size, least, most = found[i]
            stretches.append((below, below + size, least, most))
            below += size
        ends = np.array([x[1] for x in stretches])
        for s in open_ones:
            below_lo, below_hi, least, most = stretches[min(int(np.searchsorted(ends, s.target)), len(stretches) - 1)]
            s.narrow(least, below_lo, most, below_hi)
    return sorted(s.at for s in all_of)


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, f"shards-{uuid.uuid4().hex}")


def write(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
          part_mb: float = PART_MB, tolerance: float = TOLERANCE) -> str:
    """Write ``docs`` as ``shards`` shards in the format to the new folder ``path``."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    keys = C.saved(rows.select(*KEY, "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(MOST_PARTS // shards, -int(-total // (shards * part_mb * (1 << 20)))))  # of a shard
    n = shards * parts
    cuts = [(total * i / n, min(tolerance * total / shards, total / n / 3) if i % parts == 0 else PART_TOLERANCE * total / n)
            for i in range(1, n)]
    limits = splitters(keys, total, cuts) if total else []
    sent = spark.sparkContext.broadcast(key_array(limits))

    def part_of(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        k = packed(*(x.to_numpy(zero_copy_only=False) for x in (a, b, c)))
        return pa.array(np.searchsorted(sent.value, k, "right").astype(np.int32))

    C.ready(spark)
    out = rows.withColumn("part", F.arrow_udf(part_of, "int")(*KEY)).withColumn("shard", (F.col("part") / parts).cast("int"))
    out = out.repartitionById(n, "part").sortWithinPartitions("shard", *KEY)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = out.select("row", "size", "part", at.alias("at"), "shard")
    spark.createDataFrame([], out.schema).write.parquet(f"{path}/schema")
    with C.shuffles_released(spark):
        out.write.partitionBy("shard").parquet(f"{path}/rows")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """row, size, shard, slot (gapless from 0 in each shard)."""
    files = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    counts = files.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    before = C.saved(before, "shard-parts")
    if before.count() <= BROADCAST_PARTS:
        before = F.broadcast(before)
    return files.join(before, "part").select("row", "size", "shard", (F.col("before") + F.col("at")).alias("slot"))
