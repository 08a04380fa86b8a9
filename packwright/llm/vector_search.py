"""Approximate nearest neighbours by largest inner product: balanced posting lists.

1. Equal vectors become one point with the smallest ``top + 1`` of their ids (no result can
   need more), so a vector that fills a third of the table costs one point.
2. Inner products turn into distances by one more component, sqrt(M^2 - |x|^2) for points and
   0 for queries (M: largest length), so that the nearest point has the largest product.
3. A bounded sample of points (``sample``, smallest hashes) is halved again and again at the
   median between two far means; the leaves' means are the centroids, so lists are balanced.
4. A point goes to its nearest list, and, if it is near a boundary, to up to ``copies - 1`` more
   whose distance is within ``spread`` of the nearest one's. Every point is indexed.
5. A query walks a graph of neighbouring centroids in memory, best first, and reads all lists
   whose distance is within ``ratio`` of the nearest one's: few where vectors lie in clusters,
   many where they do not.
6. Lists are stored in blocks of bounded size, so long ones are read by many tasks; queries of
   a list come in blocks too. A task multiplies pairs of blocks and hands on each query's best
   of all of them; these are ranked with a limit applied before the shuffle.

Scores are exact inner products of the original vectors in double precision; what is
approximate is which points are compared. At least 16 lists are read, so small tables give
whole results.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller id; a query is never its own result,
equal vectors of other rows are; repeated ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import common as C

BLOCK_BYTES = 1 << 16
QUERIES_A_TASK = 256  # walks over the graph of centroids
SAMPLE_BYTES = 64 << 20  # of vectors that the centroids are learnt from, on the driver


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ok & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("n")).limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi")


def points(rows: DataFrame, top: int) -> DataFrame:
    """pid (smallest id), ph (hash), v, ids (the smallest top + 1) of distinct vectors."""
    w = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("pid"), F.xxhash64("v").alias("ph"), "v", "ids")


def halve(x: np.ndarray, leaves: int, seed: int = 7) -> np.ndarray:
    """Means of ``leaves`` (a power of 2) equal parts of x."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < leaves:
        out = []
        for p in parts:
            if len(p) < 2:
                out += [p, p]
                continue
            a, b = p[rng.choice(len(p), 2, replace=False)]
            for _ in range(4):  # two means
                side = (p @ (b - a)) > ((b @ b - a @ a) / 2)
                if side.all() or not side.any():
                    break
                a, b = p[~side].mean(axis=0), p[side].mean(axis=0)
            order = np.argsort(p @ (b - a), kind="stable")
            out += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = out
    return np.unique(np.array([p.mean(axis=0) for p in parts]), axis=0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T), 0))


def graph_of(c: np.ndarray, degree: int = 24, far: int = 4, seed: int = 11) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones and a few others that keep the graph whole."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(0, len(c), 512):
        d = distances(c[i : i + 512], c)
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, :degree])
    near = np.concatenate(out)
    ring = (np.arange(len(c))[:, None] + 1) % len(c)
    return np.concatenate([near, ring, rng.integers(0, len(c), (len(c), far))], axis=1)


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, ratio: float, width: int = 16) -> np.ndarray:
    """Centroids within (1 + ratio) of the nearest one's distance, as found from a few starts:
    best first over the graph until what is left is farther than that, and ``width`` are known."""
    starts = np.unique(np.linspace(0, len(c) - 1, 8).astype(int))
    dist = np.full(len(c), np.inf)  # inf: not met yet
    dist[starts] = np.sqrt(((c[starts] - q) ** 2).sum(axis=1))
    todo = list(zip(dist[starts].tolist(), starts.tolist()))
    heapq.heapify(todo)
    nearest, taken = todo[0][0], 0
    while todo:
        x, i = heapq.heappop(todo)
        if x > (1 + ratio) * nearest and taken >= width:
            break
        taken += 1
        fresh = np.unique(graph[i][np.isinf(dist[graph[i]])])
        if len(fresh):
            d = np.sqrt(((c[fresh] - q) ** 2).sum(axis=1))
            dist[fresh] = d
            nearest = min(nearest, float(d.min()))
            for y, j in zip(d.tolist(), fresh.tolist()):
                heapq.heappush(todo, (y, j))
    least = np.partition(dist, min(width, len(c)) - 1)[min(width, len(c)) - 1]
    return np.flatnonzero(np.isfinite(dist) & (dist <= max((1 + ratio) * nearest, least) + 1e-12))


def lists_of(x: np.ndarray, c: np.ndarray, copies: int, spread: float) -> list[list[int]]:
    """Posting lists of points: the nearest, and others near a boundary."""
    d = distances(x, c)
    k = min(len(c), 4 * copies)
    order = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)
    out = []
    for i, row in enumerate(order):
        own = [int(row[0])]
        limit = (1 + spread) * d[i, row[0]] + 1e-12
        for j in row[1:]:
            if len(own) == copies or d[i, j] > limit:
                break
            own.append(int(j))
        out.append(own)
    return out


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """list, block (arrays of pid, ph, v): the rows (list, pid, ph, v) of a list dealt out to
    blocks of about ``size``."""
    n = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("n"))
    dealt = rows.join(n, "list").withColumn("b", F.pmod(F.xxhash64("pid", "ph", F.lit(3)), "n"))
    return dealt.groupBy("list", "b").agg(F.collect_list(F.struct("pid", "ph", "v")).alias("block")).drop("b")


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pid, ph, vectors) of each row's block."""
    out = []
    for block in column:
        s = block.values
        v = s.field("v").flatten().to_numpy(zero_copy_only=False)
        pid = s.field("pid").to_numpy(zero_copy_only=False)
        out.append((pid, s.field("ph").to_numpy(zero_copy_only=False), v.reshape(len(pid), -1)))
    return out


def best_only(rows: list[np.ndarray], top: int) -> list[np.ndarray]:
    """qid, qh, pid, ph, score: each query's ``top`` best points, each once; ties to smaller ids."""
    qid, qh, pid, ph, score = rows
    order = np.lexsort((ph, pid, -score, qh, qid))
    rows = [x[order] for x in rows]
    qid, qh, pid, ph, score = rows
    same_query = np.concatenate(([False], (qid[1:] == qid[:-1]) & (qh[1:] == qh[:-1])))
    again = same_query & np.concatenate(([False], (pid[1:] == pid[:-1]) & (ph[1:] == ph[:-1])))
    rows = [x[~again] for x in rows]
    first = np.flatnonzero(~same_query[~again])
    rank = np.arange(len(rows[0])) - np.repeat(first, np.diff(np.append(first, len(rows[0]))))
    return [x[rank < top] for x in rows]


def best_of_blocks(met: DataFrame, top: int) -> DataFrame:
    """qid, qh, pid, ph, score: the best points that a task finds for each query, over all the
    pairs of blocks that it multiplies."""
    schema = "qid long, qh long, pid long, ph long, score double"
    types = C.pa_schema(met.sparkSession, schema)

    def multiply(qi, qh, q, pi, ph, p):
        s = q @ p.T
        if len(p) > top:
            # all that may be among the best, with room for rounding
            least = np.partition(s, len(p) - top, axis=1)[:, len(p) - top]
            row, at = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        else:
            row, at = np.repeat(np.arange(len(q)), len(p)), np.tile(np.arange(len(p)), len(q))
        score = (q[row] * p[at]).sum(axis=1)  # the same for a pair whatever its blocks
        return qi[row], qh[row], pi[at], ph[at], score

    def run(batches):
        held, size = [], 0
        for b in batches:
            for left, right in zip(matrix(b.column("qblock")), matrix(b.column("block"))):
                held.append(multiply(*left, *right))
                size += len(held[-1][0])
                if size > HELD_ROWS:
                    held = [best_only([np.concatenate(x) for x in zip(*held)], top)]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:  # many queries: hand on what there is
                        yield C.to_batch(dict(zip(types.names, held[0])), types)
                        held, size = [], 0
        if held:
            yield C.to_batch(dict(zip(types.names, best_only([np.concatenate(x) for x in zip(*held)], top))), types)

    return C.arrow_stream(met.select("qblock", "block"), run, schema)


HELD_ROWS = 1_000_000  # candidates that a task holds


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           top: int = 20, list_size: int = 200, max_lists: int = 4096, sample: int = 65_536, copies: int = 2,
           spread: float = 0.02, ratio: float = 0.16) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of ``vectors`` for each row of
    ``queries`` (same columns), its own id excepted."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    pts = C.cut(points(usable(vectors, id_col, vector_col), top))
    stats = pts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                    F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m2")).first()
    if not stats.n:
        return spark.createDataFrame([], out_schema)
    asked = usable(queries, id_col, vector_col).select("id", F.xxhash64("v").alias("qh"), "v")
    asked = C.cut(asked.filter(F.size("v") == stats.dim))
    # dealt out by their number: partitions merged by bytes would leave all walks to a few tasks
    q_points = asked.groupBy("v").agg(F.min("id").alias("pid"), F.first("qh").alias("ph")).repartition(
        max(1, -(-asked.count() // QUERIES_A_TASK)))

    lists = 1 << max(0, min(int(np.log2(max_lists)), round(np.log2(max(1, stats.n / list_size)))))
    rows = max(2 * lists, min(sample, SAMPLE_BYTES // (8 * stats.dim)))
    part = C.sample(pts, ["ph"], ["ph", "pid"], stats.n, rows).select("v").toArrow()
    x = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, stats.dim)
    x = np.concatenate([x, np.sqrt(np.maximum(stats.m2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)
    centroids = halve(x, lists)
    sent = spark.sparkContext.broadcast((centroids, graph_of(centroids)))  # max_lists rows
    m2 = float(stats.m2)

    def post(b: pa.RecordBatch) -> dict:
        v = b.column("v").flatten().to_numpy().reshape(len(b.column("v")), -1)
        wide = np.concatenate([v, np.sqrt(np.maximum(m2 - (v * v).sum(axis=1), 0))[:, None]], axis=1)
        return {"pid": b.column("pid"), "ph": b.column("ph"), "v": b.column("v"),
                "lists": lists_of(wide, sent.value[0], copies, spread)}

    def visit(b: pa.RecordBatch) -> dict:
        c, graph = sent.value
        out = []
        for v in b.column("v").flatten().to_numpy().reshape(len(b.column("v")), -1):
            # a longer query has the same order of nearness; M is the scale of the points
            q = np.append(v * (np.sqrt(m2) / np.sqrt(v @ v)), 0.0)
            out.append(walk(q, c, graph, ratio).tolist())
        return {"pid": b.column("pid"), "ph": b.column("ph"), "v": b.column("v"), "lists": out}

    schema = "pid long, ph long, v array<double>, lists array<int>"
    size = max(16, BLOCK_BYTES // (8 * stats.dim))
    posted = C.arrow_map(pts.select("pid", "ph", "v"), post, schema)
    asking = C.arrow_map(q_points.select("pid", "ph", "v"), visit, schema)
    flat = ["pid", "ph", "v", F.explode("lists").alias("list")]
    stored = blocks_of(C.cut(posted.select(*flat)), size)
    asked_blocks = blocks_of(C.cut(asking.select(*flat)), size).withColumnRenamed("block", "qblock")
    found = best_of_blocks(stored.join(asked_blocks, "list"), top + 1)
    # a point met in two lists has one score, so one dense rank
    w = Window.partitionBy("qid", "qh").orderBy(F.desc("score"), "pid", "ph")
    ranked = found.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= top + 1)
    near = ranked.dropDuplicates(["qid", "qh", "pid", "ph"])
    ids = near.join(pts.select("pid", "ph", "ids"), ["pid", "ph"]).select(
        "qid", "qh", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("qid", "qh").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1).drop("r")
    of = asked.join(q_points.select("v", F.col("pid").alias("qid")), "v").select(F.col("id").alias("query_id"), "qid", "qh")
    w = Window.partitionBy("query_id", "qid", "qh").orderBy(F.desc("score"), "vec_id")
    out = of.join(ids, ["qid", "qh"]).filter("vec_id != query_id").withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
