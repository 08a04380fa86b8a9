"""Near-duplicate classes: improved consistent weighted sampling (ICWS) over TF-IDF shingles,
banded, verified by weighted Jaccard similarity.

A text is the weighted set of its shingles of ``size`` words (all words, if fewer): weight =
occurrences x idf, idf = 1 + idf_share * log((N+1)/(df+1)) / log((N+1)/(least+1)). N and df are
exact, over all documents. Shingles of fewer than ``least`` documents count as ``least``, where
``least`` = max(2, shingles of all documents / ``FREQUENT``): so at most ``FREQUENT`` shingles
have a weight of their own, and the table of them that tasks get is of proven size whatever the
corpus. Two texts are linked if sum(min weights) / sum(max weights) >= ``similarity``; classes
are what links connect.

1. Texts with the same word sequence are one content (key: 128-bit hash). Only distinct
   contents go on, so a group of copies of any size costs its counts.
2. Each content gets ``bands * rows`` ICWS samples; ``rows`` samples make one band hash.
3. Contents with an equal band hash share a bucket. No bucket is gathered or paired up: its
   members are compared with the bucket's hub, the member that shares most buckets with
   others (the centre of a group of near copies). Members that are not in the hub's class then
   meet the next ``rounds - 1`` hubs in that order. This compares buckets of up to
   ``rounds + 1`` contents wholly.
4. The members of larger buckets that are still of different classes are joined exactly: in one
   order of all shingles, rarest first, two texts that are similar enough share a shingle in
   their prefixes (what stands before less than ``similarity`` of the weight; in the lighter
   text, less than 2 s / (1 + s) of it), and from the first one on both have enough weight left
   for the overlap they need. Pairs of different classes that meet these conditions are
   verified; no pair that is similar enough fails them. Pages of one template, too unlike for a
   link, share no shingle of the lighter one's shorter prefix, so they do not meet at all.
5. A pair is verified on whole texts: exact weighted Jaccard similarity of all shingles.
6. Classes: connected components over the verified links, by alternating large-star and
   small-star steps on checkpointed edges.

Links found are exact; links missed are those that no band brings together (probability below
0.2 % at similarity 0.8, for 12 bands of 4).

Defined cases: null texts are never copies of anything; texts without words are copies only of
the very same text; repeated rows are copies of each other; ids may be null or repeated; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import common as C

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
IDF_SHARE = 0.5
ROUNDS = 3
CELLS = 1 << 18  # of the sketch that orders shingles and finds those that may be frequent
FREQUENT = 1 << 16  # shingles with a weight of their own, at most
TABLE_ROWS = 1 << 15  # of the table of random numbers of ICWS
STEP = 1024  # shingles sampled in one vectorised step
SEED = 20_240_607


def shingles(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text's word hashes, and their occurrences."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(C.shingle_hashes(h, min(size, len(h))), return_counts=True)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)  # 18 high bits


def document_sketch(docs: DataFrame, text_col: str, size: int) -> tuple[int, np.ndarray]:
    """Number of documents, and documents' shingles in each cell: at least the df of each."""
    types = C.pa_schema(docs.sparkSession, "cell int, n long")

    def count(batches):
        cells = np.zeros(CELLS, dtype=np.int64)
        n = 0
        for b in batches:
            n += b.num_rows
            for _, _, h, _, _, bounds in C.words_of(C.text_bytes(b.column("t"))):
                for k in range(len(bounds) - 1):
                    s, _ = shingles(h[bounds[k]:bounds[k + 1]], size)
                    np.add.at(cells, cell_of(s), 1)
        if n:
            at = np.flatnonzero(cells)
            yield C.to_batch({"cell": np.append(at, -1).astype(np.int32), "n": np.append(cells[at], n)}, types)

    rows = C.arrow_stream(docs.select(F.col(text_col).alias("t")), count, "cell int, n long")
    got = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS + 1 rows at most
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    sketch = np.zeros(CELLS, dtype=np.int64)
    sketch[cell[cell >= 0]] = n[cell >= 0]
    return int(n[cell < 0].sum()), sketch


class Idf:
    """Inverse document frequency of shingles, and the order that puts rare ones first."""

    def __init__(self, total: int, least: int, hashes: np.ndarray, df: np.ndarray, sketch: np.ndarray, idf_share: float):
        order = np.argsort(hashes)
        self.hashes, self.sketch, self.rest = hashes[order], sketch, np.float32(1 + idf_share)
        span = max(np.log((total + 1) / (least + 1)), 1e-9)
        scaled = np.log((total + 1) / (df[order] + 1)) / span
        self.idf = (1 + idf_share * np.clip(scaled, 0, 1)).astype(np.float32)

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), self.rest, dtype=np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            known = self.hashes[at] == s
            out[known] = self.idf[at[known]]
        return out


def document_frequencies(docs: DataFrame, text_col: str, size: int, idf_share: float) -> Idf:
    """Exact df of all shingles of ``least`` documents or more. A first pass counts cells; the
    second counts the shingles of cells that hold enough, pre-aggregated by task."""
    spark = docs.sparkSession
    total, sketch = document_sketch(docs, text_col, size)
    least = max(2, -int(-int(sketch.sum()) // FREQUENT))
    sent = spark.sparkContext.broadcast(sketch >= least)

    def often(b: pa.RecordBatch) -> dict:
        found = [np.empty(0, np.uint64)]
        for _, _, h, _, _, bounds in C.words_of(C.text_bytes(b.column("t"))):
            for k in range(len(bounds) - 1):
                s, _ = shingles(h[bounds[k]:bounds[k + 1]], size)
                found.append(s[sent.value[cell_of(s)]])
        s, n = np.unique(np.concatenate(found), return_counts=True)
        return {"h": C.as_long(s), "n": n}

    rows = C.arrow_map(docs.select(F.col(text_col).alias("t")), often, "h long, n long")
    got = rows.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()  # FREQUENT rows at most
    h, n = (got.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    return Idf(total, least, h.view(np.uint64), n, sketch, idf_share)


_RANDOM: dict = {}


def random_table(samples: int) -> tuple[np.ndarray, ...]:
    """r and log c ~ Gamma(2, 1), beta ~ U(0, 1), for each table row and sample. A shingle
    takes the row that its hash names; shingles on one row are told apart by their hash."""
    if samples not in _RANDOM:
        g = np.random.Generator(np.random.Philox(SEED))
        shape = (TABLE_ROWS, samples)
        r = g.gamma(2, 1, shape).astype(np.float32)
        _RANDOM[samples] = r, 1 / r, np.log(g.gamma(2, 1, shape)).astype(np.float32), g.random(shape, np.float32)
    return _RANDOM[samples]


def icws(h: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """One ICWS sample hash per column, of a non-empty weighted set."""
    r, inv, log_c, beta = random_table(samples)
    best = np.full(samples, np.inf, dtype=np.float32)
    out = np.zeros(samples, dtype=np.uint64)
    cols = np.arange(samples)
    lw = np.log(weight).astype(np.float32)
    for i in range(0, len(h), STEP):  # hashes ascend, so ties go to the smaller hash
        part = h[i : i + STEP]
        row = (part & np.uint64(TABLE_ROWS - 1)).astype(np.int64)
        rr, bb = r[row], beta[row]
        t = np.floor(lw[i : i + STEP, None] * inv[row] + bb)
        a = log_c[row] - rr * (t - bb + 1)
        k = np.argmin(a, axis=0)
        least = a[k, cols]
        new = least < best
        best[new] = least[new]
        step = t[k, cols].astype(np.int64).astype(np.uint64)
        out[new] = C.mix64(part[k] + step * np.uint64(0x9E3779B97F4A7C15))[new]
    return out


def weights(h: np.ndarray, idf: Idf, size: int) -> tuple[np.ndarray, np.ndarray]:
    s, n = shingles(h, size)
    return s, n * idf.of(s)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, idf) -> DataFrame:
    """id, th, content (16 bytes naming the word sequence), bands (hash of each; null without
    words). A null text's content holds its id, so that it meets no other."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("t"))
    mult = C.mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(b: pa.RecordBatch) -> dict:
        texts = C.text_bytes(b.column("t"))
        ids, known = b.column("id").to_pylist(), b.column("t").is_valid().to_pylist()
        key, out = [None] * len(texts), [None] * len(texts)
        for first, _, h, _, _, bounds in C.words_of(texts):
            for k in range(len(bounds) - 1):
                i, own = first + k, h[bounds[k]:bounds[k + 1]]
                if len(own):
                    key[i] = xxhash.xxh3_128_digest(own.tobytes())
                    got = icws(*weights(own, idf.value, size), bands * rows).reshape(bands, rows)
                    out[i] = C.as_long(C.mix64((got * mult).sum(axis=1) + np.arange(bands, dtype=np.uint64)))
                else:
                    key[i] = xxhash.xxh3_128_digest(b"text" + texts[i] if known[i] else b"null%r" % ids[i])
        return {"id": b.column("id"), "th": b.column("th"), "content": key, "bands": out}

    return C.arrow_map(src, sign, "id long, th long, content binary, bands array<long>")


def buckets(contents: DataFrame) -> DataFrame:
    """key, tie, band, bh, size, degree, of buckets with 2 or more. Ties in degree are settled by
    what a content holds, not by its number, which follows the partitions."""
    flat = contents.filter(F.col("bands").isNotNull()).select(
        "key", F.xxhash64("bands").alias("tie"), F.posexplode("bands").alias("band", "bh"))
    size = flat.groupBy("band", "bh").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = C.cut(flat.join(size, ["band", "bh"]))
    degree = shared.groupBy("key").agg(F.sum("size").alias("degree"))
    return shared.join(degree, "key")


def hubs(shared: DataFrame, rounds: int) -> DataFrame:
    """band, bh, hub, round: the first ``rounds`` members of each bucket, by falling degree.
    Spark cuts the ranks to ``rounds`` a task before the shuffle (group limit)."""
    w = Window.partitionBy("band", "bh").orderBy(F.desc("degree"), "tie", "key")
    ranked = shared.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= rounds)
    return ranked.select("band", "bh", F.col("key").alias("hub"), "round")


def verified(pairs: DataFrame, texts: DataFrame, idf, size: int, similarity: float) -> DataFrame:
    """The pairs (key, hub) whose texts are similar enough. The rows of a hub of more than
    ``PART`` pairs are dealt out in parts of about so many, so it is no hot key."""
    large = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART).select(
        "hub", F.ceil(F.col("n") / PART).alias("parts"))
    pairs = C.cut(pairs.join(large, "hub", "left").select(
        "key", "hub", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")))
    left = pairs.join(texts.select("key", F.col("text").alias("a")), "key")
    hub_text = pairs.select("hub", "salt").distinct().join(
        texts.select(F.col("key").alias("hub"), F.col("text").alias("b")), "hub")
    both = left.join(hub_text, ["hub", "salt"])

    def compare(batch: pa.RecordBatch) -> dict:
        seen: dict = {}

        def bag(text: bytes):
            return weights(C.hash_words(text)[0], idf.value, size)

        keep = []
        hub, a, b = batch.column("hub").to_pylist(), C.text_bytes(batch.column("a")), C.text_bytes(batch.column("b"))
        for i, k in enumerate(hub):
            if k not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[k] = bag(b[i])
            keep.append(weighted_jaccard(*bag(a[i]), *seen[k]) >= similarity)
        return {"u": batch.column("key").filter(pa.array(keep)), "v": batch.column("hub").filter(pa.array(keep))}

    return C.arrow_map(both.select("key", "hub", "a", "b"), compare, "u long, v long")


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    same = float(np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64))
    return same / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - same)


def components(links: DataFrame) -> DataFrame:
    """key, root (smallest key that links lead to) of the linked keys other than the roots."""
    edges, state = C.cut(links.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None

    def with_least(e: DataFrame) -> DataFrame:
        # partial minima, then a join that Spark splits where one key has many rows: the centre
        # of a large class is no hot group
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    while True:
        # large star: each larger neighbour to the smallest one (or the key itself)
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        large = with_least(both.select("e.u", "e.v")).filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: the smaller neighbours, and the key, to the smallest one
        small = with_least(large).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = C.cut(small.select("e.u", "e.v").filter("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        state = now


def not_joined(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (key, hub) that are not in one class yet."""
    other = roots.select(F.col("key").alias("hub"), F.col("root").alias("hub_root"))
    apart = F.coalesce("root", "key") != F.coalesce("hub_root", "hub")
    return pairs.join(roots, "key", "left").join(other, "hub", "left").filter(apart).select("key", "hub")


def left_apart(shared: DataFrame, roots: DataFrame, rounds: int) -> DataFrame:
    """key, root of the members of buckets that the hubs do not compare wholly, if the bucket
    holds more than one class."""
    members = shared.filter(F.col("size") > rounds + 1).select("key", "band", "bh").join(roots, "key", "left").withColumn(
        "root", F.coalesce("root", "key"))
    apart = members.groupBy("band", "bh").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b")
    return members.join(apart.select("band", "bh"), ["band", "bh"]).select("key", "root").distinct()


def prefix(h: np.ndarray, idf: Idf, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The shingles of a text's prefix, the weight from each on (itself included), and the
    weight of all. What follows the prefix weighs less than ``similarity`` of all."""
    s, w = weights(h, idf, size)
    order = np.lexsort((s, idf.sketch[cell_of(s)]))  # one order for all texts: rarest first, then by hash
    w = w[order].astype(np.float64)
    left = np.cumsum(w[::-1])[::-1]
    n = np.count_nonzero(left >= similarity * left[0] * (1 - SLACK)) if len(w) else 0
    return s[order[:n]], left[:n], float(left[0]) if len(w) else 0.0


def prefixes(members: DataFrame, texts: DataFrame, idf, size: int, similarity: float) -> DataFrame:
    """key, root, weight of the text, token (shingle of its prefix), left (weight from it on)."""

    def first(b: pa.RecordBatch) -> dict:
        got = [prefix(C.hash_words(t)[0], idf.value, size, similarity) for t in C.text_bytes(b.column("text"))]
        return {"key": b.column("key"), "root": b.column("root"), "weight": [w for _, _, w in got],
                "tokens": [C.as_long(s) for s, _, _ in got], "left": [x for _, x, _ in got]}

    rows = C.arrow_map(members.join(texts, "key").select("key", "root", "text"), first,
                       "key long, root long, weight double, tokens array<long>, left array<double>")
    return rows.select("key", "root", "weight", F.explode(F.arrays_zip("tokens", "left")).alias("t")).select(
        "key", "root", "weight", F.col("t.tokens").alias("token"), F.col("t.left").alias("left"))


def possible_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """The pairs (key, hub) of different classes that can be similar enough, by their prefixes
    (``first``). Classes meet first, so that members of one class are not paired up; a token of
    many classes is dealt out in parts of about ``PART`` of them. Side 1 is the lighter text,
    which must hold the token in its shorter prefix."""
    bound = similarity * (1 - SLACK)

    def can(left1, left2, least1, most1, least2, most2):
        # shared shingles stand at or after the first shared one; lengths are alike
        need = bound / (1 + bound) * (F.col(least1) + F.col(least2))
        return ((F.least(left1, left2) >= need) & (F.col(most1) >= bound * F.col(least2))
                & (F.col(most2) >= bound * F.col(least1)))

    def lighter(left, weight):
        return F.col(left) >= 2 * bound / (1 + bound) * F.col(weight)

    classes = first.groupBy("token", "root").agg(
        F.min("weight").alias("least"), F.max("weight").alias("most"), F.max("left").alias("left"),
        F.max(lighter("left", "weight")).alias("light"))
    several = classes.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("light").alias("any")).filter(
        "n > 1 AND any").select("token", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    c = C.cut(classes.join(several, "token"))
    side = lambda n, *more: c.select("token", *(F.col(x).alias(f"{x}{n}") for x in ("root", "least", "most", "left", "light")), *more)
    one = side(1, F.pmod(F.xxhash64("root"), F.col("parts")).cast("int").alias("part")).filter("light1")
    two = side(2, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = one.join(two, ["token", "part"]).filter("root1 != root2").filter(
        can("left1", "left2", "least1", "most1", "least2", "most2")).drop("part", "least1", "most1", "left1", "light1", "light2")
    member = lambda n: first.select("token", F.col("root").alias(f"root{n}"), F.col("key").alias(f"key{n}"),
                                    F.col("weight").alias(f"w{n}"), F.col("left").alias(f"l{n}"))
    half = met.join(member(1).filter(lighter("l1", "w1")), ["token", "root1"]).filter(
        can("l1", "left2", "w1", "w1", "least2", "most2")).select("token", "root2", "key1", "w1", "l1")
    both = half.join(member(2), ["token", "root2"]).filter(
        can("l1", "l2", "w1", "w1", "w2", "w2") & (F.col("w1") <= F.col("w2") * (1 + SLACK)))
    return both.select(F.greatest("key1", "key2").alias("key"), F.least("key1", "key2").alias("hub")).distinct()


SLACK = 1e-5  # of weights summed in different orders and precisions
PART = 1000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    idf_share: float = IDF_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, th (hash of the text), class_id (smallest id of its class),
    class_th (with it names the row that stays for the class), class_size, kept."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col, size, idf_share))
    signed = C.cut(signatures(docs, id_col, text_col, size, bands, rows, idf))
    # one row per content: F.first of the bands, as they follow from the content; key: a number
    # for it, half the size, for all that follows
    contents = C.cut(signed.groupBy("content").agg(
        F.first("bands").alias("bands"), F.min(F.struct("id", "th")).alias("least"),
        F.count(F.lit(1)).alias("n")).withColumn("key", F.monotonically_increasing_id()))
    shared = C.cut(buckets(contents))
    centre = C.cut(hubs(shared, rounds))
    need = shared.select("key").distinct().join(contents.select("key", "least"), "key")
    texts = saved_texts(docs, id_col, text_col, need)

    members = shared.select("key", "band", "bh")
    met = members.join(centre, ["band", "bh"]).filter("key != hub")
    first = met.filter("round = 1").select("key", "hub").distinct()
    roots = components(verified(first, texts, idf, size, similarity))
    if rounds > 1:
        # a pair can come from either side and from several buckets
        later = not_joined(met.filter("round > 1").select(F.greatest("key", "hub").alias("key"), F.least("key", "hub").alias("hub"))
                           .distinct(), roots)
        found = verified(later, texts, idf, size, similarity)
        roots = components(roots.select(F.col("key").alias("u"), F.col("root").alias("v")).unionByName(found))
    apart = C.cut(left_apart(shared, roots, rounds))
    if not apart.isEmpty():
        prefixed = C.cut(prefixes(apart, texts, idf, size, similarity))
        found = verified(C.cut(possible_pairs(prefixed, similarity)), texts, idf, size, similarity)
        roots = components(roots.select(F.col("key").alias("u"), F.col("root").alias("v")).unionByName(found))

    named = contents.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = named.groupBy("root").agg(F.min("least").alias("stays"), F.sum("n").alias("class_size"))
    of = C.cut(named.select("content", "root").join(classes, "root").select("content", "stays", "class_size"))
    out = signed.select("id", "th", "content").join(of, "content")
    first = (F.col("id").eqNullSafe(F.col("stays.id"))) & (F.col("th") == F.col("stays.th"))
    return out.select("id", "th", F.col("stays.id").alias("class_id"), F.col("stays.th").alias("class_th"),
                      F.col("class_size").cast("long").alias("class_size"), first.alias("kept"))


def saved_texts(docs: DataFrame, id_col: str, text_col: str, need: DataFrame) -> DataFrame:
    """key, text of the contents that share a bucket, from the row with the least (id, th)."""
    n = need.select("key", F.col("least.id").alias("nid"), F.col("least.th").alias("nth"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                    F.col(text_col).alias("text"))
    got = n.join(d, F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth")))
    return C.cut(got.select("key", "text").dropDuplicates(["key"]))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class, one of repeated rows."""
    stays = classes.filter("kept").select("id", "th")
    rows = C.join_results(docs, stays, id_col, text_col, "inner")
    w = Window.partitionBy("id", "th").orderBy("rth")
    return rows.withColumn("again", F.row_number().over(w)).filter("again = 1").select("row.*")
