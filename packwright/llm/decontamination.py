"""Benchmark decontamination: a prefix-filtered set join of documents and benchmark windows.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit. A document is
contaminated if ``n_hit > 0`` and ``one_in * n_hit >= n_words``.

1. Shingles (``shingle`` words, or all words of a shorter window) of the benchmark get their
   number of occurrences in all documents. A window with a shingle that no document has is out.
2. Containment of a whole window needs each of its shingles, so a prefix of one is enough:
   the rarest shingle of the window (ties: smaller hash, then earlier place).
3. Document shingles that are the prefix of some window become candidates, with the words
   that a window around them can reach. They meet the windows in an equi-join on the shingle.
4. Positional bound: the window must begin inside the document; length bound: it must end
   inside it. Then its words are compared with the document's: the result is exact.

Documents are never shuffled: candidates are told apart on the fly by a bit table of fixed
size (2 MB) that every task gets; its false alarms fall out of the join. No pair of a
document and an item is formed without a common prefix shingle.

Defined cases: null or wordless texts have no words and no hits; wordless items have no
window; repeated items count by their item_id, repeated documents each get their row (ids may
be null or repeated); empty tables give rows without hits, or no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import common as C

SIZE = 13
SHINGLE = 4
FILTER_BITS = 24  # the bit table has 2 ** 24 bits, whatever the size of the benchmark
COUNT_FLUSH = 500_000  # distinct shingles that a task counts before it hands them on


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, size: int, shingle: int) -> DataFrame:
    """item, words (joined by a space), n (words), g (words of a shingle), shingles."""
    src = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t"))

    def cut_windows(b: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("item", "words", "n", "g", "shingles")}
        ids = b.column("item").to_pylist()
        for first, joined, h, s, e, bounds in C.words_of(C.text_bytes(b.column("t"))):
            low = joined.lower()
            for k in range(len(bounds) - 1):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if hi == lo:
                    continue
                n = min(size, hi - lo)
                g = min(shingle, n)
                grams = C.as_long(C.shingle_hashes(h[lo:hi], g))
                for p in range(lo, hi - n + 1):
                    out["item"].append(ids[first + k])
                    out["words"].append(b" ".join([low[s[q]:e[q]] for q in range(p, p + n)]).decode())
                    out["n"].append(n)
                    out["g"].append(g)
                    out["shingles"].append(grams[p - lo : p - lo + n - g + 1].tolist())
        return out

    return C.arrow_map(src, cut_windows, "item string, words string, n int, g int, shingles array<long>")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The fixed-size bit table of a column ``h`` of hashes; at most 2**18 rows come back."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("m")).collect()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in rows:
        words[r.w] = r.m
    return words.view(np.uint64)


def in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingles_of(h: np.ndarray, bounds: np.ndarray, sizes: list[int], bits: np.ndarray):
    """(size, positions, hashes) of the shingles inside one document that pass the table."""
    for g in sizes:
        grams = C.shingle_hashes(h, g)
        at = np.flatnonzero(in_table(bits, grams))
        # the last word must be in the same document
        same = np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + g - 1, side="right")
        yield g, at[same], grams[at[same]]


def shingle_counts(docs: DataFrame, text_col: str, sizes: list[int], bits) -> DataFrame:
    """h, n: occurrences in all documents of the shingles that pass the table."""
    types = C.pa_schema(docs.sparkSession, "h long, n long")

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for _, _, h, _, _, bounds in C.words_of(C.text_bytes(b.column("t"))):
                for _, _, hit in shingles_of(h, bounds, sizes, bits.value):
                    keys, n = np.unique(C.as_long(hit), return_counts=True)
                    for k, v in zip(keys.tolist(), n.tolist()):
                        found[k] += v
            if len(found) > COUNT_FLUSH:
                yield C.to_batch({"h": list(found.keys()), "n": list(found.values())}, types)
                found = Counter()
        if found:
            yield C.to_batch({"h": list(found.keys()), "n": list(found.values())}, types)

    part = C.arrow_stream(docs.select(F.col(text_col).alias("t")), count, "h long, n long")
    return part.groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """words, n, prefix (its rarest shingle), place (of the prefix in the window)."""
    distinct = windows.dropDuplicates(["words"]).select("words", "n", F.posexplode("shingles").alias("place", "h"))
    known = distinct.join(counts.withColumnRenamed("n", "seen"), "h", "left")
    return known.groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "place")).alias("first")
    ).filter("first.seen > 0").select("words", "n", F.col("first.h").alias("prefix"), F.col("first.place").alias("place"))


def candidates(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], reach: int, bits) -> DataFrame:
    """One row per document: id, th, n_words, near: its shingles that may be a prefix, each
    with its hash, its word number, and the words before and after it that a window reaches."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("t"))

    def find(b: pa.RecordBatch) -> dict:
        n_words, near = [], []
        for _, joined, h, s, e, bounds in C.words_of(C.text_bytes(b.column("t"))):
            n_words += np.diff(bounds).tolist()
            mine: list[list] = [[] for _ in range(len(bounds) - 1)]
            for g, at, grams in shingles_of(h, bounds, sizes, bits.value):
                doc = np.searchsorted(bounds, at, side="right") - 1
                for p, d, x in zip(at.tolist(), doc.tolist(), C.as_long(grams).tolist()):
                    lo, hi = max(int(bounds[d]), p - reach + 1), min(int(bounds[d + 1]), p + reach)
                    mine[d].append({"h": x, "at": p - int(bounds[d]), "back": p - lo,
                                    "ctx": b" ".join([joined[s[q]:e[q]].lower() for q in range(lo, hi)]).decode()})
            near += mine
        return {"id": b.column("id"), "th": b.column("th"), "n_words": n_words, "near": near}

    return C.arrow_map(src, find, "id long, th long, n_words long, "
                                  "near array<struct<h:long,at:long,back:int,ctx:string>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE,
                  shingle: int = SHINGLE, one_in: int = 20) -> DataFrame:
    """One row per document: id, th (hash of the text), n_words, n_hit, items (sorted ids of
    the items with a window in it), contaminated."""
    spark = docs.sparkSession
    windows = C.cut(benchmark_windows(items, item_col, item_text_col, size, shingle))
    sizes = sorted(r.g for r in windows.select("g").distinct().collect())  # at most `shingle` values
    send = spark.sparkContext.broadcast
    known = send(bit_table(windows.select(F.explode("shingles").alias("h"))))
    rarest = C.cut(prefixes(windows, shingle_counts(docs, text_col, sizes, known)))
    wanted = send(bit_table(rarest.select(F.col("prefix").alias("h"))))
    found = C.cut(candidates(docs, id_col, text_col, sizes, size, wanted))

    near = found.select("id", "th", F.explode("near").alias("c")).select("id", "th", "c.*")
    met = near.join(rarest, near["h"] == rarest["prefix"])
    inside = met.filter((F.col("place") <= F.col("back"))
                        & (F.col("back") - F.col("place") + F.col("n") <= F.size(F.split("ctx", " "))))
    same = inside.filter(F.array_join(F.slice(F.split("ctx", " "), F.col("back") - F.col("place") + 1, F.col("n")), " ")
                         == F.col("words"))
    spans = same.select("id", "th", (F.col("at") - F.col("place")).alias("a"),
                        (F.col("at") - F.col("place") + F.col("n")).alias("z"), "words").distinct()
    spans = C.cut(spans)
    before = Window.partitionBy("id", "th").orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("z") - F.greatest(F.col("a"), F.coalesce(F.max("z").over(before), F.lit(0))), F.lit(0))
    hits = spans.select("id", "th", new.alias("new")).groupBy("id", "th").agg(F.sum("new").alias("n_hit"))
    named = spans.select("id", "th", "words").distinct().join(windows.select("words", "item").distinct(), "words")
    named = named.select("id", "th", "item").distinct().groupBy("id", "th").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    of = hits.join(named, (hits["id"].eqNullSafe(named["id"])) & (hits["th"] == named["th"])).select(
        hits["id"].alias("hid"), hits["th"].alias("hth"), "n_hit", "items")
    out = found.drop("near").join(of, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("id", "th", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = contamination(docs, items, id_col, text_col, **options).filter("contaminated").select("id", "th")
    return C.join_results(docs, C.saved(bad, "contaminated"), id_col, text_col, "left_anti").select("row.*")
