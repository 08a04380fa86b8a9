"""Language identification: segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability for each piece of a public byte-level vocabulary (its pieces of
lower-case ASCII letters and non-ASCII bytes, with or without a leading space, and all single
bytes). The probability of a word is the sum over all ways to
write it with pieces of the product of their probabilities: the forward algorithm. A text's
score for a language adds up the log probabilities of its words and the log share of the
language; the prediction is the largest, its score the posterior probability.

Words: runs of letters of the lower-cased text (ASCII letters and all non-ASCII bytes), each
with a leading space. Every word of the text counts, whole; equal words of a batch are summed up
once. The forward algorithm runs on all words of a batch of up to ``SHORT`` bytes at once, byte by
byte; longer ones (runs without spaces) go one by one in logarithms, over a window of the longest
piece that moves through blocks of ``BLOCK`` bytes.

Learning: expected piece counts (forward-backward) on at most ``docs_per_language`` labelled
documents of each language, those of smallest id hash (a documented bound), a few EM steps from
equal probabilities; smoothed with the mean of all languages. Shares of the languages count all
labelled documents. What returns to the driver is vocabulary x languages numbers.

Defined cases: text that is null or has no letter (Unicode category L) is ``und`` with score 0; without labelled
documents every text is ``und``; ties go to the smaller language name; repeated rows get equal
results; labels that are null teach nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import common as C
from packwright.llm.byte_bpe import ranks_of
from packwright.llm.quality import held_out

UND = "und"
SHORT = 32  # bytes: products of so many probabilities are far from underflow
BLOCK = 1 << 16
LETTER = regex.compile(r"\p{L}")
_PIECE = re.compile(rb" ?[a-z\x80-\xff]+\Z")
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[0x80:] = True
_MULT = np.uint64(0xD6E8FEB86659FD93)


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file that can occur in words, with all single bytes."""
    found = {t for t in ranks_of(Path(path).read_bytes()) if _PIECE.match(t)}
    return sorted(found | {bytes([b]) for b in range(256)})


@dataclass
class Pieces:
    """A vocabulary as an open-addressing table of 64-bit hashes."""

    hashes: np.ndarray = field(default=None)
    slots: np.ndarray = field(default=None)
    size: int = 0
    lengths: tuple[int, ...] = ()  # that pieces have

    @staticmethod
    def of(pieces: list[bytes]) -> Pieces:
        h = np.array([_hash_bytes(p) for p in pieces], dtype=np.uint64)
        bits = max(4, int(np.ceil(np.log2(4 * len(pieces)))))
        hashes, slots = np.zeros((1 << bits) + PROBES, np.uint64), np.zeros((1 << bits) + PROBES, np.int32)
        for i, x in enumerate(h.tolist()):
            at = x >> (64 - bits)
            while slots[at]:
                at += 1
            hashes[at], slots[at] = x, i + 1
        return Pieces(hashes, slots, len(pieces), tuple(sorted({len(p) for p in pieces})))

    @property
    def longest(self) -> int:
        return self.lengths[-1]

    def find(self, h: np.ndarray) -> np.ndarray:
        """1 + number of the piece, 0 if there is none."""
        at = (h >> np.uint64(64 - int(np.log2(len(self.slots) - PROBES)))).astype(np.int64)
        out = np.zeros(len(h), dtype=np.int32)
        todo = np.arange(len(h))
        while len(todo):
            slot = self.slots[at[todo]]
            same = self.hashes[at[todo]] == h[todo]
            out[todo[same]] = slot[same]
            todo = todo[~same & (slot > 0)]
            at[todo] += 1
        return out


PROBES = 64


def _step(h, byte):
    return (h ^ (byte + np.uint64(1))) * _MULT


def _end(h, size):
    return C.mix64(h + np.uint64(size))


def _hash_bytes(piece: bytes) -> int:
    h = np.zeros(1, dtype=np.uint64)
    for b in piece:
        h = _step(h, np.array([b], dtype=np.uint64))
    return int(_end(h, len(piece))[0])


def words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, and for each (text, word) met: text and word numbers."""
    number: dict[bytes, int] = {}
    doc, word = [], []
    for i, t in enumerate(texts):
        low = (t or "").lower().encode("utf-8", "replace")
        own = [number.setdefault(w, len(number)) for w in low.translate(_SPLIT).split()]
        word += own
        doc += [i] * len(own)
    return list(number), np.array(doc, dtype=np.int64), np.array(word, dtype=np.int64)


_SPLIT = bytes(b if _WORD_BYTE[b] else 32 for b in range(256))


class Lattice:
    """All segmentations of words. Up to ``SHORT`` bytes: sorted by falling length, bytes in a
    matrix, piece numbers by piece length. ``long``: (number of the word, its bytes) of others."""

    def __init__(self, distinct: list[bytes], pieces: Pieces):
        self.pieces = pieces
        wide_words = [b" " + w for w in distinct]
        self.long = [(i, np.frombuffer(w, dtype=np.uint8)) for i, w in enumerate(wide_words) if len(w) > SHORT]
        self.of = [i for i, w in enumerate(wide_words) if len(w) <= SHORT]
        parts = [wide_words[i] for i in self.of]
        length = np.array([len(p) for p in parts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        self.of = np.array(self.of, dtype=np.int64)[order]
        self.length, n = length[order], len(parts)
        self.width = int(length.max()) if n else 0
        wide = np.zeros((n, self.width), dtype=np.uint64)
        flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        first = np.cumsum(length) - length
        rows = np.repeat(np.arange(n), length)
        wide[rows, np.arange(len(flat)) - np.repeat(first, length)] = flat
        wide = wide[order]
        #: words of at least so many bytes come first
        self.active = np.searchsorted(-self.length, -np.arange(self.width + 1), side="right")
        # arcs by end: (words, start, 1 + piece)
        self.arcs: list[list] = [[] for _ in range(self.width + 1)]
        for start in range(self.width):
            h = np.zeros(n, dtype=np.uint64)
            for size in range(1, min(pieces.longest, self.width - start) + 1):
                live = self.active[start + size]
                h = _step(h[:live], wide[:live, start + size - 1])
                if size not in pieces.lengths:
                    continue
                piece = pieces.find(_end(h, size))
                rows = np.flatnonzero(piece)
                if len(rows):
                    self.arcs[start + size].append((rows, start, piece[rows] - 1))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language]; p: piece x language."""
        a = np.zeros((self.width + 1, len(self.length), p.shape[1]))
        a[0] = 1
        for end, arcs in enumerate(self.arcs):
            for rows, start, piece in arcs:
                a[end, rows] += a[start, rows] * p[piece]
        return a

    def log_likelihood(self, p: np.ndarray, n_words: int) -> np.ndarray:
        a = self.forward(p)
        out = np.zeros((n_words, p.shape[1]))
        out[self.of] = np.log(a[self.length, np.arange(len(self.length))])
        if self.long:
            log_p = np.log(p)
            for i, raw in self.long:
                out[i] = long_forward(raw, log_p, self.pieces)[-1]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts under one language (p: piece x 1), words weighted."""
        a = self.forward(p)[:, :, 0]
        b = np.zeros_like(a)
        b[self.length, np.arange(len(self.length))] = 1
        total = a[self.length, np.arange(len(self.length))]
        share = weight[self.of] / total
        counts = np.zeros(len(p))
        for end in range(self.width, 0, -1):
            for rows, start, piece in self.arcs[end]:
                inner = p[piece, 0] * b[end, rows]
                b[start, rows] += inner
                np.add.at(counts, piece, share[rows] * a[start, rows] * inner)
        for i, raw in self.long:
            long_expected(raw, np.log(p[:, 0]), self.pieces, weight[i], counts)
        return counts


def long_arcs(raw: np.ndarray, lo: int, hi: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, piece, bounds) of the pieces of a word that end in (lo, hi], by end: those that end
    at lo + 1 + k are bounds[k]:bounds[k + 1]. Every byte is a piece, so none is empty."""
    first = max(0, lo + 1 - pieces.longest)
    seg = raw[first:hi].astype(np.uint64)
    h, found = np.zeros(len(seg), dtype=np.uint64), []
    for size in range(1, min(pieces.longest, len(seg)) + 1):
        h = _step(h[: len(seg) - size + 1], seg[size - 1 :])
        if size in pieces.lengths:
            piece = pieces.find(_end(h, size))
            at = np.flatnonzero(piece[max(0, lo + 1 - size - first) :]) + max(0, lo + 1 - size - first)
            found.append((at + first, at + first + size, piece[at] - 1))
    start, end, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(end, kind="stable")
    return start[order], piece[order], np.searchsorted(end[order], np.arange(lo + 1, hi + 2))


def long_forward(raw: np.ndarray, log_p: np.ndarray, pieces: Pieces, keep: bool = False) -> np.ndarray:
    """Log alpha of the last positions of a word (all of them with ``keep``) by language."""
    back = pieces.longest
    a, base = np.zeros((1, log_p.shape[1])), 0  # rows: positions from base on
    for lo in range(0, len(raw), BLOCK):
        hi = min(lo + BLOCK, len(raw))
        start, piece, bounds = long_arcs(raw, lo, hi, pieces)
        if not keep and len(a) > back:
            base += len(a) - back
            a = a[-back:]
        a = np.concatenate([a, np.empty((hi - lo, a.shape[1]))])
        weight = log_p[piece]
        for k in range(hi - lo):
            i, j = bounds[k], bounds[k + 1]
            a[lo + 1 + k - base] = np.logaddexp.reduce(a[start[i:j] - base] + weight[i:j], axis=0)
    return a


def long_expected(raw: np.ndarray, log_p: np.ndarray, pieces: Pieces, weight: float, counts: np.ndarray) -> None:
    """Adds a word's expected piece counts under one language."""
    a = long_forward(raw, log_p[:, None], pieces, keep=True)[:, 0]
    b = np.full(len(raw) + 1, -np.inf)
    b[-1] = 0
    for lo in reversed(range(0, len(raw), BLOCK)):
        hi = min(lo + BLOCK, len(raw))
        start, piece, bounds = long_arcs(raw, lo, hi, pieces)
        for k in reversed(range(hi - lo)):
            at = slice(bounds[k], bounds[k + 1])
            inner = log_p[piece[at]] + b[lo + 1 + k]
            b[start[at]] = np.logaddexp(b[start[at]], inner)
            counts[piece[at]] += weight * np.exp(a[start[at]] + inner - a[-1])


@dataclass
class Model:
    pieces: Pieces
    langs: list[str]
    p: np.ndarray  # piece x language
    log_share: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        distinct, doc, word = words(texts)
        total = np.tile(self.log_share, (len(texts), 1))
        if len(distinct) and self.langs:
            ll = Lattice(distinct, self.pieces).log_likelihood(self.p, len(distinct))
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(doc, ll[word, j], len(texts))
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([t is not None and LETTER.search(t) is not None for t in texts], dtype=bool)
        return [self.langs[k] if ok else UND for k, ok in zip(best, known)], np.where(known, post, 0.0)


def smooth(counts: np.ndarray, mass: float = 500.0) -> np.ndarray:
    """piece x language counts -> probabilities, all above 0."""
    total = counts.sum(axis=0, keepdims=True)
    mean = (counts / np.maximum(total, 1e-9)).mean(axis=1, keepdims=True)
    back = 0.9 * mean + 0.1 / len(counts)
    back /= back.sum()
    return (counts + mass * back) / (total + mass)


def train(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = 1000, steps: int = 2) -> Model:
    spark = docs.sparkSession
    pieces = Pieces.of(vocabulary(vocabulary_path))
    learn = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    share = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model(pieces, [], np.ones((pieces.size, 0)), np.zeros(0))
    w = Window.partitionBy("lang").orderBy("r", "id", "th")
    # a bound on the hash leaves about twice the sample of each language for the ranking
    limits = F.create_map(*[F.lit(x) for lang in langs for x in (lang, C.low_limit(share[lang], docs_per_language))])
    ranked = learn.select("lang", "id", C.low_hash("id").alias("r"), F.xxhash64("t").alias("th"))
    ranked = ranked.filter(F.col("r") < limits[F.col("lang")])
    chosen = ranked.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= docs_per_language)
    # bounded by docs_per_language rows of ids a language
    picked = F.broadcast(chosen.select(F.col("id").alias("cid"), F.col("th").alias("cth")).distinct())
    sample = C.cut(learn.join(picked, F.col("id").eqNullSafe(F.col("cid")) & (F.xxhash64("t") == F.col("cth")),
                              "left_semi").select("lang", "t"))
    p = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    types = C.pa_schema(spark, "lang string, piece int, n double")
    for _ in range(steps):
        sent = spark.sparkContext.broadcast((pieces, langs, p))

        def count(batches):
            pieces, langs, p = sent.value
            sums = {}
            for b in batches:
                lang, texts = b.column("lang").to_pylist(), b.column("t").to_pylist()
                for one in sorted(set(lang)):
                    distinct, _, word = words([t for t, x in zip(texts, lang) if x == one])
                    if distinct:
                        j = langs.index(one)
                        got = Lattice(distinct, pieces).expected(p[:, j : j + 1], np.bincount(word).astype(float))
                        sums[one] = sums.get(one, 0) + got
            for one, n in sums.items():
                at = np.flatnonzero(n)
                yield C.to_batch({"lang": [one] * len(at), "piece": at.astype(np.int32), "n": n[at]}, types)

        found = C.arrow_stream(sample, count, "lang string, piece int, n double").groupBy("lang", "piece").agg(
            F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(p)
        lang_no = {x: j for j, x in enumerate(langs)}
        counts[found.column("piece").to_numpy(), [lang_no[x] for x in found.column("lang").to_pylist()]] = \
            found.column("n").to_numpy()
        p = smooth(counts)
    n = np.array([share[x] for x in langs], dtype=float)
    return Model(pieces, langs, p, np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.p, model.log_share))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("t"))

    def run(b: pa.RecordBatch) -> dict:
        lang, score = Model(*sent.value).predict(b.column("t").to_pylist())
        return {"id": b.column("id"), "th": b.column("th"), "lang_pred": lang, "score": score}

    return C.arrow_map(src, run, "id long, th long, lang_pred string, score double")
