"""Whole JSON documents (arrays of records) read by byte ranges, and written in pieces.

A file that is one array is read by many tasks, however large it is. The text source cuts it at
``}`` and deals out byte ranges; what a range means depends on whether it starts inside a
string, and how deep. So there are two passes:

1. each range reports, for a start outside and for one inside a string, the state it ends in and
   the change of depth: one small row a range. These compose in range order, which gives every
   range its true start.
2. each range is cut at the commas between the array's elements. Elements that lie within a range
   are parsed where they are; only the first and the last piece of a range travel, to be joined
   with their other parts.

A backslash before ``}`` in a string is part of an escaped backslash (JSON has no other escape
that ends there), so no escape is pending where a range starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CUT = "}"
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
SPACE = b" \t\r\n"
STRETCH = 1 << 20  # bytes looked at together, unless one piece of text is longer


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), value: the file's text between ``}``, in order within a
    range."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, bytes) of stretches of one range, ``}`` put back; a stretch ends with a piece and
    holds about STRETCH bytes, however many a batch has."""
    for b in batches:
        if not b.num_rows:
            continue
        files, starts = b.column("file"), b.column("start").to_numpy()
        values = b.column("value").cast(pa.binary())
        until = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
        part = until // STRETCH
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(part, part[i], side="right"))
            file, other = files[i].as_py(), np.flatnonzero(starts[i:j] != starts[i])
            j = i + int(other[0]) if len(other) else j
            names = files.slice(i, j - i).to_pylist()
            j = next((i + k for k, f in enumerate(names) if f != file), j)
            yield file, int(starts[i]), b"".join(v + b"}" for v in values.slice(i, j - i).to_pylist())
            i = j


def _quotes(raw: np.ndarray) -> np.ndarray:
    """Marks of the quotes that no backslash escapes."""
    quote = raw == QUOTE
    at = np.flatnonzero(quote)
    slash = raw == BACKSLASH
    if len(at) and slash.any():
        last_other = np.maximum.accumulate(np.where(slash, np.int32(-1), np.arange(len(raw), dtype=np.int32)))
        run = np.where(at > 0, at - 1 - last_other[np.maximum(at - 1, 0)], 0)  # backslashes before it
        quote[at[run % 2 == 1]] = False
    return quote


def _depths(raw: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(depth after each byte, counted from 0; marks of bytes in strings; whether the end is)."""
    inside = np.logical_xor.accumulate(_quotes(raw)) ^ in_string
    step = np.zeros(len(raw), dtype=np.int8)
    step[(raw == ord("[")) | (raw == ord("{"))] = 1
    step[(raw == ord("]")) | (raw == ord("}"))] = -1
    step[inside] = 0
    return np.cumsum(step, dtype=np.int32), inside, bool(inside[-1]) if len(raw) else in_string


STATE_SCHEMA = "file string, start long, first string, out_in boolean, out_depth long, in_in boolean, in_depth long"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of STATE_SCHEMA per range."""
    now, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(
            ("file", "start", "first", "out_in", "out_depth", "in_in", "in_depth"), (*now, *state))}, schema=pa.schema([
                ("file", pa.string()), ("start", pa.int64()), ("first", pa.string()), ("out_in", pa.bool_()),
                ("out_depth", pa.int64()), ("in_in", pa.bool_()), ("in_depth", pa.int64())]))

    for file, start, data in _ranges(batches):
        if now != (file, start):
            if now:
                yield row()
            now, state = (file, start), [data.lstrip(SPACE + b"\xef\xbb\xbf")[:1].decode("ascii", "replace"), False, 0, True, 0]
        raw = np.frombuffer(data, dtype=np.uint8)
        for k in (1, 3):
            depth, _, state[k] = _depths(raw, state[k])
            state[k + 1] += int(depth[-1])
    if now:
        yield row()


def range_starts(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """(in a string, depth, file is an array) where each byte range starts. One row a range comes
    to the driver."""
    rows = _pieces(spark, path).mapInArrow(_states, STATE_SCHEMA).collect()
    out, in_string, depth, array, file = {}, False, 0, False, None
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, in_string, depth, array = r.file, False, 0, r.first == "["
        out[r.file, r.start] = in_string, depth, array
        in_string, depth = (r.in_in, depth + r.in_depth) if in_string else (r.out_in, depth + r.out_depth)
    return out


PART_SCHEMA = "file string, start long, place long, last boolean, text string"


def _elements(starts: dict, batch_rows: int = 512, batch_bytes: int = 4 * STRETCH):
    """Rows of PART_SCHEMA: the parts of elements in a range, numbered; place 0 goes on from the
    range before, ``last`` goes on into the next."""
    types = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def parts(batches):
        now, held, place = None, [], 0
        for file, start, data in _ranges(batches):
            if now != (file, start):
                if now:
                    yield (*now, place, True, b"".join(held))
                now, held, place = (file, start), [], 0
                in_string, depth, array = starts[now]
                closed = depth <= 0 and start > 0
            if closed:
                continue
            raw = np.frombuffer(data, dtype=np.uint8)
            after, inside, in_string = _depths(raw, in_string)
            after = after + depth
            opening = 0
            if depth == 0:  # the document has not begun
                up = np.flatnonzero(after == 1)
                if not len(up):
                    continue
                opening = int(up[0])
            end = opening + np.flatnonzero(after[opening:] == 0)
            closed = len(end) > 0
            depth = int(after[-1])
            stop = int(end[0]) if closed else len(raw)
            at = opening + (array if opening or not held and place == 0 and starts[now][1] == 0 else 0)
            if array:
                cuts = np.flatnonzero((raw == COMMA) & ~inside & (after == 1))
                for c in cuts[(cuts >= at) & (cuts < stop)].tolist():
                    held.append(data[at:c])
                    yield (*now, place, False, b"".join(held))
                    held, place, at = [], place + 1, c + 1
                held.append(data[at:stop])
            else:
                held.append(data[at : stop + 1])
        if now:
            yield (*now, place, True, b"".join(held))

    def run(batches):
        held, size = [], 0

        def batch():
            file, start, place, last, text = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(place, pa.int64()),
                                               pa.array(last, pa.bool_()), pa.array(text, pa.binary()).cast(pa.string())], schema=types)

        for p in parts(batches):
            held.append(p)
            size += len(p[-1])
            if len(held) == batch_rows or size >= batch_bytes:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, place: list[str] | None = None) -> DataFrame:
    """The records of whole JSON documents: the elements of each file that is an array, or the
    file itself if it is one object. Elements that do not fit ``schema`` give null columns.
    ``place`` names three more columns: file, start of the range that an element begins in, and
    its number there, which goes up by one."""
    starts = spark.sparkContext.broadcast(range_starts(spark, path))

    def cut(batches):
        yield from _elements(starts.value)(batches)

    parts = _pieces(spark, path).mapInArrow(cut, PART_SCHEMA)
    inner = parts.filter("place > 0 AND NOT last").select("file", "start", "place", "text")
    # the ends of the ranges, two a range at most: a first piece belongs to the last one before
    # it that began an element
    w = Window.partitionBy("file").orderBy("start", "place")
    begins = F.when((F.col("place") > 0) | (F.col("start") == 0), F.struct("start", "place"))
    ends = parts.filter("place = 0 OR last").withColumn("element", F.last(begins, ignorenulls=True).over(w))
    joined = ends.groupBy("file", "element").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "text"))), lambda p: p["text"]), "").alias("text"))
    texts = inner.unionByName(joined.select("file", "element.*", "text")).filter(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    where = [F.col(c).alias(n) for c, n in zip(("file", "start", "place"), place or [])]
    return texts.select(*where, F.from_json("text", schema).alias("r")).select("r.*", *(place or []))


def write_json_arrays(df: DataFrame, path: str) -> str:
    """Every partition as one file that is a JSON array of its rows, written as they come."""

    def lines(batches):
        lead = "["
        for rows in (b.column("value").slice(i, 512).to_pylist() for b in batches for i in range(0, b.num_rows, 512)):
            out = [("," if i else lead) + r for i, r in enumerate(rows)]
            if out:
                lead = ","
                yield pa.RecordBatch.from_pydict({"value": out})
        if lead == ",":
            yield pa.RecordBatch.from_pydict({"value": ["]"]})

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(
        lines, "value string").write.text(path)
    return path
