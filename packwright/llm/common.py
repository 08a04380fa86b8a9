"""Shared helpers: table access, Arrow row functions, and vectorised word hashing.

Words everywhere in this subpackage: A-Z lower-cased, then maximal runs of ASCII letters,
digits and non-ASCII characters (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.session import cut_lineage, scratch_path

#: Rows per Arrow batch handed to a Python function. Batches are the unit of memory in a
#: Python worker, and rows are whole texts.
BATCH_ROWS = 256
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 20

_FOLD = np.zeros(256, dtype=np.uint8)  # word bytes -> lower-cased byte, others -> 0
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_POWERS = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list | dict], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; ``fn`` maps a batch to a dict of columns."""
    types = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield to_batch(fn(b), types)

    return arrow_stream(df, run, schema)


def arrow_stream(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the batch size of this subpackage (whole texts in a row)."""
    ready(df.sparkSession)

    def released(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(released, schema)


_SHIPPED: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Before Python functions run: small Arrow batches, and this package sent to the
    executors (once per application), which need not have it installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        import packwright

        root = Path(packwright.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="packwright-ship-")) / "packwright.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(columns: dict, types: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in types:
        c = columns[f.name]
        arrays.append(c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=types)


#: Spark removes an action's shuffle files when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """For actions whose result is on storage afterwards: nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; a lost executor loses nothing of it."""
    with shuffles_released(df.sparkSession):
        return cut_lineage(df.select("*"))  # planned anew, under that setting


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its size is then known,
    and Spark broadcasts it in joins only if it is below its threshold."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def low_hash(*cols) -> F.Column:
    """A number of 31 bits from the hash of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 31))


def low_limit(total: int, want: int) -> int:
    """A bound on :func:`low_hash` under which about twice ``want`` of ``total`` rows lie."""
    return 1 << 31 if total <= 2 * want else (2 * want << 31) // total


def sample(df: DataFrame, hash_cols: list[str], order_cols: list[str], total: int, want: int) -> DataFrame:
    """At most ``want`` of the ``total`` rows, those of smallest hash. The bound on the hash comes
    first, so that what meets in the last task is about twice the sample at any size."""
    h = low_hash(*hash_cols)
    return df.filter(h < low_limit(total, want)).orderBy(h, *order_cols).limit(want)


def split_texts(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts (bytes) of about ``limit`` bytes each, one text at least."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        grown = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _FOLD[raw]
    word = low != 0
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    at = np.flatnonzero(word)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = np.arange(len(at)) - np.repeat(first, lens)
    v = (low[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[inside]
    h = np.add.reduceat(v, first)
    return mix64(h + lens.astype(np.uint64) * _MIX), starts, ends


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, start and end byte of every word of ``data``. Long data is worked on
    in pieces that end between words, so scratch memory stays near one piece."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) <= 2 * SLICE_BYTES:
        return _hash_piece(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + SLICE_BYTES, len(raw))
        while end < len(raw):  # move to the next byte outside a word
            out = np.flatnonzero(_FOLD[raw[end : end + SLICE_BYTES]] == 0)
            if len(out):
                end += int(out[0])
                break
            end = min(end + SLICE_BYTES, len(raw))
        h, s, e = _hash_piece(raw[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def words_of(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (index of the first text, joined bytes, word hashes, starts,
    ends, bounds), words ``bounds[k]:bounds[k+1]`` being those of text ``first + k``."""
    for i, j in split_texts(texts):
        part = texts[i:j]
        joined = b"\n".join(part)
        h, s, e = hash_words(joined)
        sizes = np.fromiter((len(t) + 1 for t in part), dtype=np.int64, count=j - i)
        limits = np.concatenate(([0], np.cumsum(sizes)))
        yield i, joined, h, s, e, np.searchsorted(s, limits)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position (shorter by size-1 than ``h``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix64(out + np.uint64(size))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of ``docs``, whatever their names), id, th (hash of the text): (id, th)
    names a row by content, the same in every re-read; rows that agree in both are repeats."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"),
                       F.xxhash64(F.col(f"row.`{text_col}`")).alias("th"))


def join_results(docs: DataFrame, results: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 how: str = "left") -> DataFrame:
    """``keyed_rows`` of ``docs`` with the columns of ``results`` (by its id and th)."""
    r = results.dropDuplicates(["id", "th"]).withColumnsRenamed({"id": "rid", "th": "rth"})
    rows = keyed_rows(docs, id_col, text_col)
    return rows.join(r, rows["id"].eqNullSafe(r["rid"]) & (rows["th"] == r["rth"]), how)
