"""Line dedup: drop the lines whose key occurs in many documents.

Texts are split at ``\\n`` (null or empty: one empty line). A line's key is the line without
white space (space, tab to carriage return) at either end and with A-Z lower-cased. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
lines everywhere; the other lines stay, joined by ``\\n`` in their order.

Plan: one row per document and distinct key (128-bit hash, line positions), counted with
partial sums; the keys over the threshold meet those rows again; the positions to drop are
gathered per document (at most its own lines) and the text is put together by position.
A key that holds a large share of all rows is looked up in a broadcast whose size has a
proven bound (see ``hot_share``); the rest is a shuffled join in which no key is large.

Defined cases: a repeated row counts as a document of its own; null or repeated ids are
fine (rows are matched by id and text hash); null text has one empty line and stays null in
``drop_repeated_lines``; an empty table gives an empty result; other columns pass through
untouched whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: bytes) -> list[bytes]:
    # bytes.lower() changes A-Z only; strip() takes exactly the six characters
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def document_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per document and distinct key: id, th (text hash), k1, k2 (key hash), at
    (positions of its lines)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                      F.xxhash64(text_col).alias("th"))

    def lines(b: pa.RecordBatch) -> dict:
        row, digests, at = [], [], []
        for i, text in enumerate(C.text_bytes(b.column("t"))):
            found: dict[bytes, list[int]] = {}
            for p, key in enumerate(_keys(text)):
                if len(key) >= min_chars and (min_chars <= 1 or _chars(key) >= min_chars):
                    found.setdefault(xxhash.xxh3_128_digest(key), []).append(p)
            row += [i] * len(found)
            digests += found.keys()
            at += found.values()
        k = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        pick = pa.array(row, type=pa.int64())
        return {"id": b.column("id").take(pick), "th": b.column("th").take(pick),
                "k1": np.ascontiguousarray(k[:, 0]), "k2": np.ascontiguousarray(k[:, 1]), "at": at}

    return C.arrow_map(src, lines, "id long, th long, k1 long, k2 long, at array<int>")


def lines_to_drop(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int,
                  hot_share: int) -> DataFrame:
    """id, th, gone: the positions to drop, of the documents that lose lines."""
    lines = C.cut(document_lines(docs, id_col, text_col, min_chars))
    total = lines.count()
    often = C.cut(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs))
    # fewer than hot_share keys can each hold over 1/hot_share of the rows
    hot = F.col("n") * F.lit(hot_share) > F.lit(total)
    of_hot = F.broadcast(often.filter(hot).select("k1", "k2", F.lit(True).alias("hot")))
    seen = lines.join(of_hot, ["k1", "k2"], "left")
    rest = seen.filter(F.col("hot").isNull()).select("k1", "k2", "id", "th", "at").join(
        often.filter(~hot).select("k1", "k2"), ["k1", "k2"], "left_semi")
    dropped = seen.filter(F.col("hot")).select("id", "th", "k1", "k2", "at").unionByName(rest.select("id", "th", "k1", "k2", "at"))
    # repeats of one row give the same positions: one of them stays before a document's are gathered
    once = dropped.groupBy("id", "th", "k1", "k2").agg(F.first("at").alias("at"))
    return once.groupBy("id", "th").agg(F.flatten(F.collect_list("at")).alias("gone"))


def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts put together again, by position, from the lines that stay."""
    out = texts.to_pylist()
    for i, positions in enumerate(gone.to_pylist()):
        if positions is not None and out[i] is not None:
            drop = set(positions)
            out[i] = "\n".join([x for p, x in enumerate(out[i].split("\n")) if p not in drop])
    return pa.array(out, type=pa.string())


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                        min_chars: int = 1, hot_share: int = 4096) -> DataFrame:
    """``docs`` as (row: all its columns, kept: new text, n_lines, n_dropped)."""
    gone = lines_to_drop(docs, id_col, text_col, min_docs, min_chars, hot_share)
    C.ready(docs.sparkSession)
    joined = C.join_results(docs, C.saved(gone, "line-dedup"), id_col, text_col)
    text = F.col(f"row.`{text_col}`")
    kept = F.arrow_udf(without_lines, "string")(text, F.col("gone"))
    return joined.select(
        "row",
        kept.alias("kept"),
        (F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("")))
         + 1).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_dropped"),
    )


def with_lines_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       chars_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with the new texts, and their code points in ``chars_col`` (if it is there)."""
    out = drop_repeated_lines(docs, id_col, text_col, **options)
    row = F.col("row").withField(f"`{text_col}`", F.col("kept"))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        row = F.when(F.col("n_dropped") > 0, row.withField(f"`{chars_col}`", F.length("kept").cast(kind))).otherwise(row)
    return out.select(row.alias("row")).select("row.*")
