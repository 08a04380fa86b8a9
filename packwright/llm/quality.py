"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts (lengths, shares of character classes, repetition of words and lines)
are cut into bins at quantiles. Cyclic gradient boosting of the logistic loss fits, feature by
feature in turn, a shallow tree on the feature's bins; the trees of a feature add up to one
lookup table. Then the pairs that explain most of what is left get tables over a coarser grid
in the same way, from trees of two levels. A score is the logistic function of the sum of the
entries: bin numbers and additions on whole arrays.

Fitting uses at most ``max_rows`` labelled rows (those of smallest id hash), on the driver:
a documented bound, some MB of features. Features and scores of all rows are computed in
parallel; the tables (kB) are broadcast.

Defined cases: null text counts as empty, which has features and a score of its own; labels
that are null or whose id is null, or that are given twice with different values, teach
nothing; without any usable labels the score is 0.5 everywhere, with one class only it is near
that class; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

FEATURES = ("log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "again_next", "upper", "digit",
            "punct", "comma_dot", "odd_symbol", "pipe", "space", "non_ascii", "log_lines", "distinct_lines", "line_words",
            "words_a_stop")
_CLASS = np.zeros((256, 8), dtype=np.uint8)  # upper, digit, punct, comma or dot, odd, pipe, space, non-ASCII
for _i in range(256):
    _c = chr(_i)
    if _i >= 0x80:
        _CLASS[_i, 7] = 1
    elif _c.isupper():
        _CLASS[_i, 0] = 1
    elif _c.isdigit():
        _CLASS[_i, 1] = 1
    elif _c.isspace():
        _CLASS[_i, 6] = 1
    elif not _c.isalnum() and _i > 32:
        _CLASS[_i, 2] = 1
        _CLASS[_i, 3] = _c in ",."
        _CLASS[_i, 4] = _c in "#$%&*@^~<>{}[]=\\/_+"
        _CLASS[_i, 5] = _c == "|"
_BITS = (_CLASS * (1 << np.arange(8)).astype(np.uint8)).sum(axis=1).astype(np.uint8)
_SUM_STEP = 1 << 18


def class_counts(raw: np.ndarray) -> np.ndarray:
    counts = np.zeros(8)
    for i in range(0, len(raw), _SUM_STEP):  # counts of byte values, then of classes
        counts += np.bincount(raw[i : i + _SUM_STEP], minlength=256) @ _CLASS
    return counts


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, _, h, s, e, bounds in C.words_of(texts):
        for k in range(len(bounds) - 1):
            text, lo, hi = texts[first + k], int(bounds[k]), int(bounds[k + 1])
            if not text:
                continue
            size, n = len(text), hi - lo
            lines = text.split(b"\n")
            c = class_counts(np.frombuffer(text, dtype=np.uint8))
            word = (0.0, 0.0, 0.0, 0.0)
            if n:
                own = h[lo:hi]
                ordered = np.sort(own)
                cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
                word = (float((e[lo:hi] - s[lo:hi]).mean()), (len(cuts) - 1) / n, int(np.diff(cuts).max()) / n,
                        float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0)
            out[first + k] = (np.log1p(size), np.log1p(n), *word, *(c / size), np.log1p(len(lines)),
                              len(set(lines)) / len(lines), n / len(lines), n / (1 + c[3]))
    return out


@dataclass
class Model:
    edges: list = field(default_factory=list)  # of bins, by feature
    single: list = field(default_factory=list)  # table by feature
    pairs: list = field(default_factory=list)  # (feature, feature, edges, edges, table)
    start: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (edges, t) in enumerate(zip(self.edges, self.single)):
            out += t[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, ei, ej, t in self.pairs:
            out += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _cut_point(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of one run of bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf value of every bin: a best-first tree on ordered bins."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        best = max(((*_cut_point(g[a:b], h[a:b], ridge), a, b) for a, b in runs), key=lambda x: x[0])
        if best[0] <= 1e-9 or not best[1]:
            break
        _, k, a, b = best
        runs.remove((a, b))
        runs += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of a two-level tree on a grid: one cut of either feature, then a
    cut of the other one on each side."""
    best, table = -1.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for cut in range(1, gg.shape[0]):
            got, t = 0.0, np.zeros_like(gg)
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[side].sum(axis=0), hh[side].sum(axis=0)
                value = tree(sg, sh, 2, ridge)
                got += float((value * sg).sum())
                t[side] = value
            if got > best:
                best, table = got, t.T if turn else t
    return best, table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 40,
        n_pairs: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 1.0) -> Model:
    m = Model()
    if not len(y):
        return m
    p = (y.sum() + 1) / (len(y) + 2)
    m.start = float(np.log(p / (1 - p)))
    f = x.shape[1]
    m.edges = [quantile_edges(x[:, j], bins) for j in range(f)]
    m.single = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    logit = np.full(len(y), m.start)

    def slopes():
        q = 1 / (1 + np.exp(-logit))
        return y - q, q * (1 - q)

    for _ in range(rounds):  # cyclic: one small tree for each feature in turn
        for j in range(f):
            g, h = slopes()
            n = len(m.single[j])
            step = rate * tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), leaves, ridge)
            m.single[j] += step
            logit += step[at[j]]
    grid = [quantile_edges(x[:, j], pair_bins) for j in range(f)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(grid)]

    def sums(i, j):
        g, h = slopes()
        shape = (len(grid[i]) + 1, len(grid[j]) + 1)
        flat = cell[i] * shape[1] + cell[j]
        size = shape[0] * shape[1]
        return flat, np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape)

    gains = sorted(((pair_tree(*sums(i, j)[1:], ridge)[0], i, j) for i in range(f) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    tables = {ij: np.zeros((len(grid[ij[0]]) + 1, len(grid[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            flat, g, h = sums(i, j)
            step = rate * pair_tree(g, h, ridge)[1]
            tables[i, j] += step
            logit += step.ravel()[flat]
    m.pairs = [(i, j, grid[i], grid[j], t) for (i, j), t in tables.items()]
    return m


def held_out(id_col) -> F.Column:
    """Rows that never teach: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = 30_000, **options) -> Model:
    """Fit on the labelled rows that are not held out, at most ``max_rows`` of them."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    one = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2")
    one = one.select("id", F.col("y").cast("double").alias("y"))
    chosen = C.sample(one, ["id"], ["id"], one.count(), max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    # bounded: max_rows pairs of numbers; a repeated id teaches once
    rows = texts.join(F.broadcast(chosen), "id")

    def extract(b: pa.RecordBatch) -> dict:
        x = features(C.text_bytes(b.column("t")))
        return {"id": b.column("id"), "y": b.column("y"), "x": list(x)}

    got = C.arrow_map(rows, extract, "id long, y double, x array<double>").groupBy("id").agg(
        F.first("y").alias("y"), F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy(), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.edges, model.single, model.pairs, model.start))  # plain arrays, a few kB
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("t"))

    def run(b: pa.RecordBatch) -> dict:
        x = features(C.text_bytes(b.column("t")))
        return {"id": b.column("id"), "th": b.column("th"), "score": Model(*sent.value).score(x)}

    return C.arrow_map(src, run, "id long, th long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.edges, model.single, model.pairs, model.start))
    C.ready(docs.sparkSession)

    def run(t: pa.Array) -> pa.Array:
        return pa.array(Model(*sent.value).score(features(C.text_bytes(t))), type=pa.float64())

    return docs.filter(F.arrow_udf(run, "double")(F.col(text_col)) >= threshold)
