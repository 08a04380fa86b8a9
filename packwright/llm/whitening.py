"""Embedding whitening by singular values of a bidiagonal matrix.

Entries c become whole numbers x = floor(1024 c) + 100000. The covariance of all remaining
vectors (divisor n) is never formed; its eigenvectors and eigenvalues are the right singular
vectors of the centred rows A, and their squared singular values over n:

1. Sums per dimension are exact whole numbers, added per partition first. Rows are centred as
   (n x - S) / n with an exact numerator.
2. Blockwise QR: each task reduces its centred rows to a triangle R, block by block; triangles
   are reduced the same way, ``FAN_IN`` at a time, until a few are left for the driver. A
   triangle has as many rows as dimensions, however long the table.
3. Householder reflections from both sides make R bidiagonal.
4. dqds (differential quotient-difference with shifts) finds all singular values to high
   relative accuracy; shifts come from the trace of the inverse, so none passes the least value.
5. A twisted factorisation at each wanted value, cut where its pivot is least, gives the
   direction; directions of values that nearly agree are found together by inverse iteration
   with that factorisation and separated by plane rotations of B's columns.
6. A pass over the rows measures the covariance of the whitened values; a last one returns them.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those
with entries of 2^40 or more or of another length than most; null and repeated ids and repeated
vectors are rows of their own; a component without variance (up to rounding) has no
whitened value and is not returned, so a table of equal vectors gives no rows; deviations that
no long can hold are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

SCALE, OFFSET = 1024, 100_000
MOST = float(1 << 40)  # entries
COMPONENTS = 8
FAN_IN = 16
BLOCK_BYTES = 4 << 20  # of rows that a reduction works on
EPS = float(np.finfo(np.float64).eps)
NEAR = 1e-6  # values whose relative distance is less are found together


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x (array of longs) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ok)
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("n")).limit(1).first()
    rows = rows.filter(F.size("v") == (length.n if length else 0))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and exact sums per dimension: one row per task is added up in Spark."""
    schema = "n long, s array<decimal(38,0)>"
    types = C.pa_schema(rows.sparkSession, schema)

    def run(batches):
        n, s = 0, None
        for b in batches:
            if b.num_rows:
                part = matrix(b.column("x")).sum(axis=0).astype(object)  # below 2^63 in a batch
                n, s = n + b.num_rows, part if s is None else s + part
        if n:
            yield C.to_batch({"n": [n], "s": [[int(v) for v in s]]}, types)

    parts = C.cut(C.arrow_stream(rows.select("x"), run, schema))
    n = parts.agg(F.sum("n")).first()[0] or 0
    each = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return n, [int(r.v) for r in each]


@dataclass
class Centre:
    """Exact mean S / n: whole part and rest of each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: exact up to the last rounding while n x fits a long."""
        return ((x - self.whole) * float(self.n) - self.rest) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        d = x - self.whole
        if float(np.abs(d).max(initial=0) + 1) * self.n < 2.0**31 / np.sqrt(x.shape[1]):
            return (((d * self.n - self.rest) ** 2).sum(axis=1)).tolist()
        out = [sum(v * v for v in row) for row in d.astype(object) * self.n - self.rest.astype(object)]
        return [v if v < 1 << 63 else None for v in map(int, out)]


def reduced(held: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(held), mode="r")


def triangle(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    schema = "r array<double>"
    types = C.pa_schema(rows.sparkSession, schema)
    d = len(centre.whole)
    block = max(2 * d, BLOCK_BYTES // (8 * d))

    def reduce(batches, column, of):
        held, n = [], 0
        for b in batches:
            for part in of(b.column(column)):
                held.append(part)
                n += len(part)
                if n >= block:
                    held = [reduced(held)]
                    n = len(held[0])
        if held:
            yield C.to_batch({"r": [reduced(held).ravel()]}, types)

    def of_rows(column):
        return [centre.deviations(matrix(column))] if len(column) else []

    def of_triangles(column):
        return [np.asarray(r.values.to_numpy(zero_copy_only=False)).reshape(-1, d) for r in column]

    left = C.cut(C.arrow_stream(rows.select("x"), lambda b: reduce(b, "x", of_rows), schema))
    n = left.count()
    while n > FAN_IN:
        dealt = left.repartition(-(-n // FAN_IN))
        left = C.cut(C.arrow_stream(dealt, lambda b: reduce(b, "r", of_triangles), schema))
        n = left.count()
    return reduced([np.array(r.r).reshape(-1, d) for r in left.collect()])


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha): x - 2 v (v.x) = (alpha, 0, 0, ...), v of length 1 or 0."""
    alpha = -np.copysign(np.linalg.norm(x), x[0])
    v = x.copy()
    v[0] -= alpha
    norm = np.linalg.norm(v)
    return (v / norm, float(alpha)) if norm else (v, float(x[0]))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): r = u B w^T for some orthogonal u, B with diagonal a and b above it."""
    d = r.shape[1]
    m, w = np.zeros((max(d, r.shape[0]), d)), np.eye(d)
    m[: r.shape[0]] = r
    a, b = np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        v, a[k] = reflector(m[k:, k])
        m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < d - 1:
            v, b[k] = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return a, b, w


def pass_of(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds pass: the quotients and differences of the shifted matrix, and its d; None if the
    shift is past the least value."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        qk = d + e[k]
        t = q[k + 1] / qk if qk else 0.0
        qs.append(qk)
        es.append(e[k] * t)
        d = d * t - shift
    if d < 0:
        return None
    return [*qs, d], es, [*ds, d]


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling."""
    found = []
    floor = (EPS * max(np.abs(a).max(), np.abs(b).max(initial=0))) ** 2 * 1e-6  # in place of zeros
    todo = [([max(float(x) ** 2, floor) for x in a], [float(x) ** 2 for x in b], 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= (EPS / 8) ** 2 * q[k] or e[k] <= EPS / 16 * EPS * shifted), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[-1] > q[0]:  # graded the wrong way: turned round, the least comes out last
                q, e = turned(q, e)
            q, e, d = pass_of(q, e, 0.0)
            # 1 / d are the diagonal of the inverse: their sum bounds the least value from below,
            # the least d from above
            inverse = sum(1 / x if x else np.inf for x in d)
            for shift in (min(d) * (1 - min(1.0, 4 * np.sqrt(e[-1] / q[-1]) if q[-1] else 1.0)), (1 - 4 * EPS * len(q)) / inverse):
                if shift > 0 and (passed := pass_of(q, e, shift)):
                    q, e, _ = passed
                    shifted += shift
                    break
        found.append(shifted + q[0])
    return np.sort(np.array(found))[::-1]


def turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same values, from the matrix read from its other end: of L U with U(k,k) = q, the
    product of subdiagonal and superdiagonal stays, so do all values."""
    # B^T B has diagonal q[k] + e[k-1] and off-diagonal squares q[k] e[k]; factor it from the end
    n = len(q)
    diagonal = [q[k] + (e[k - 1] if k else 0.0) for k in range(n)]
    off = [q[k] * e[k] for k in range(n - 1)]
    qs, es = [diagonal[-1]], []
    for k in range(n - 2, -1, -1):
        es.append(off[k] / qs[-1])
        qs.append(max(diagonal[k] - es[-1], 0.0))
    return qs, es


class Twisted:
    """Factorisation of B^T B - value from both ends, meeting where the pivot is least."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        tiny = EPS * EPS * max(value, 1e-300)
        diagonal = a * a
        self.low = b / a[:-1] if n > 1 else np.zeros(0)  # B^T B = L D L^T
        s, p = np.empty(n), np.empty(n)
        self.from_top, self.from_end = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
        self.top, self.end = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):  # stationary
            self.top[i] = diagonal[i] + s[i] or tiny
            self.from_top[i] = diagonal[i] * self.low[i] / self.top[i]
            s[i + 1] = self.from_top[i] * self.low[i] * s[i] - value
        self.top[n - 1] = diagonal[n - 1] + s[n - 1] or tiny
        p[n - 1] = diagonal[n - 1] - value
        for i in range(n - 2, -1, -1):  # progressive
            self.end[i + 1] = diagonal[i] * self.low[i] ** 2 + p[i + 1] or tiny
            t = diagonal[i] / self.end[i + 1]
            self.from_end[i] = self.low[i] * t
            p[i] = p[i + 1] * t - value
        self.end[0] = p[0] or tiny
        pivots = s + p + value
        self.at = int(np.argmin(np.abs(pivots)))
        self.pivot = pivots[self.at] or tiny

    def direction(self) -> np.ndarray:
        """The solution that the least pivot leaves over."""
        z = np.zeros(len(self.top))
        z[self.at] = 1
        return self.outwards(z)

    def outwards(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.from_top[i] * z[i + 1]
        for i in range(self.at + 1, len(z)):
            z[i] -= self.from_end[i - 1] * z[i - 1]
        return z

    def solve(self, y: np.ndarray) -> np.ndarray:
        y, k = y.copy(), self.at
        for i in range(1, k):
            y[i] -= self.from_top[i - 1] * y[i - 1]
        for i in range(len(y) - 2, k, -1):
            y[i] -= self.from_end[i] * y[i + 1]
        if k:
            y[k] -= self.from_top[k - 1] * y[k - 1]
        if k < len(y) - 1:
            y[k] -= self.from_end[k] * y[k + 1]
        y[:k] /= self.top[:k]
        y[k + 1 :] /= self.end[k + 1 :]
        y[k] /= self.pivot
        return self.outwards(y)


def rotated(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The columns of z turned among themselves until those of B z are orthogonal, longest first."""
    y = a[:, None] * z
    y[:-1] += b[:, None] * z[1:]
    for _ in range(30):
        worst = 0.0
        for i in range(z.shape[1]):
            for j in range(i + 1, z.shape[1]):
                p, q, r = y[:, i] @ y[:, i], y[:, j] @ y[:, j], y[:, i] @ y[:, j]
                if abs(r) <= EPS * np.sqrt(p * q):
                    continue
                worst = max(worst, abs(r) / np.sqrt(p * q))
                tau = (q - p) / (2 * r)
                t = np.copysign(1.0, tau) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                for m in (y, z):
                    m[:, i], m[:, j] = c * m[:, i] - c * t * m[:, j], c * t * m[:, i] + c * m[:, j]
        if worst == 0:
            break
    return z[:, np.argsort(-(y * y).sum(axis=0), kind="stable")]


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Unit right singular vectors (columns) of B for the first ``wanted`` of its falling values."""
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) < EPS * EPS * scale, EPS * EPS * scale, a)
    out, k = [], 0
    while k < wanted:
        end = k + 1
        while end < len(values) and values[end - 1] - values[end] <= NEAR * values[end - 1]:
            end += 1
        if end == k + 1:
            z = Twisted(a, b, values[k]).direction()
            out.append((z / np.linalg.norm(z))[:, None])
        else:
            z = np.random.default_rng(k).normal(size=(len(a), end - k))
            for _ in range(4):
                f = [Twisted(a, b, v) for v in values[k:end]]
                z = np.linalg.qr(np.stack([x.solve(c) for x, c in zip(f, z.T)], axis=1))[0]
            out.append(rotated(z, a, b))
        k = end
    return np.concatenate(out, axis=1)[:, :wanted]


@dataclass
class Whitening:
    """mean, whitening directions (columns), and each component's share of the variance."""

    centre: Centre
    columns: np.ndarray
    values: np.ndarray  # eigenvalues of the covariance
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.deviations(x) @ self.columns


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From all rows (id, x); None if there are none, or none that differ."""
    n, s = sums(rows)
    if not n or not s:
        return None
    centre = Centre(n, np.array([v // n for v in s]), np.array([v % n for v in s]))
    a, b, w = bidiagonal(triangle(rows, centre))
    if not np.abs(a).max() and not np.abs(b).max(initial=0):
        return None
    squares = dqds(a, b)
    wanted = int((np.sqrt(squares[:components]) > 8 * EPS * len(a) * np.sqrt(squares[0])).sum())
    values = squares[:wanted] / n
    return Whitening(centre, w @ directions(a, b, squares, wanted) / np.sqrt(values), values,
                     values / (squares.sum() / n))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    schema = "m array<double>"
    types = C.pa_schema(rows.sparkSession, schema)

    def run(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                v = model.apply(matrix(b.column("x")))
                v = np.concatenate([v, np.ones((len(v), 1))], axis=1)
                total = total + v.T @ v
        if not np.isscalar(total):
            yield C.to_batch({"m": [total.ravel()]}, types)

    parts = C.arrow_stream(rows.select("x"), run, schema)
    each = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    k = model.columns.shape[1]
    m = np.array([r.v for r in each]).reshape(k + 1, k + 1) / model.centre.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component, components by falling variance from 1."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(rows, model)
    k = model.columns.shape[1]

    def values(b: pa.RecordBatch) -> dict:
        x = matrix(b.column("x"))
        return {"id": b.column("id"), "deviation": model.centre.squares(x), "w": list(model.apply(x))}

    out = C.arrow_map(rows, values, "id long, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    out = out.select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("id", (F.col("i") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation",
                      "whitened", shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
