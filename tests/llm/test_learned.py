"""Quality classifier and language identification: held-out accuracy, brute force of the
forward algorithm, and defined cases."""

import random
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from packwright.llm import language_id as L
from packwright.llm import quality as Q

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    got = Q.score(docs, model).join(labels, F.col("id") == F.col("doc_id")).filter(Q.held_out("id")).toPandas()
    assert len(got) > 50 and auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.single, b.single)) and a.start == b.start


def test_trees_and_interactions_learn_what_they_should():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature says anything
    m = Q.fit(x, y, rounds=20, pair_rounds=80, n_pairs=2)
    assert auc(m.score(x), y) > 0.95 and (1, 0) in [(i, j) for i, j, *_ in m.pairs]
    g, h = np.array([1.0, 1, -1, -1, 5]), np.ones(5)
    assert Q.tree(g, h, 3, 0.0).tolist() == [1, 1, -1, -1, 5]
    gain, t = Q.pair_tree(np.array([[1.0, -1], [-1, 1]]), np.ones((2, 2)), 0.0)
    assert t.tolist() == [[1, -1], [-1, 1]] and gain == 4


def test_features_by_hand():
    f = dict(zip(Q.FEATURES, Q.features([b"", "Aa b, b | 1\né!".encode()])[1]))
    size = len("Aa b, b | 1\né!".encode())
    assert f["log_bytes"] == np.log1p(size) and f["log_words"] == np.log1p(5) and f["distinct_words"] == 4 / 5
    assert f["top_word"] == 2 / 5 and f["again_next"] == 1 / 4 and f["upper"] == 1 / size and f["digit"] == 1 / size
    assert f["pipe"] == 1 / size and f["comma_dot"] == 1 / size and f["punct"] == 3 / size and f["non_ascii"] == 2 / size
    assert f["log_lines"] == np.log1p(2) and f["distinct_lines"] == 1 and f["line_words"] == 2.5
    assert (Q.features([b""])[0] == 0).all()
    long = ("word " * 700_000).encode()
    assert np.allclose(Q.features([long])[0][3:6], [1 / 700_000, 1, 1])


def test_quality_defined_cases(spark, make_docs):
    docs = make_docs([(1, "good text here"), (2, None), (3, ""), (None, "x"), (2, "other"), (4, "||| |||")]).withColumn("score", F.lit(9))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, Q.train(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (4, 1), (3, 1)], "doc_id long, quality int")
    model = Q.train(docs, odd)
    out = Q.score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    kept = Q.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    empty = make_docs([])
    assert Q.score(empty, Q.train(empty, none)).count() == 0


def plain_forward(word, table):
    """Log of the sum over all segmentations, position by position."""
    a = [None] * (len(word) + 1)
    a[0] = np.zeros(len(next(iter(table.values()))))
    longest = max(map(len, table))
    for end in range(1, len(word) + 1):
        ways = [a[s] + table[word[s:end]] for s in range(max(0, end - longest), end) if word[s:end] in table]
        a[end] = np.logaddexp.reduce(ways, axis=0)
    return a[-1]


def test_words_of_any_length_are_whole(monkeypatch):
    vocabulary = L.vocabulary(VOCAB)
    assert max(map(len, vocabulary)) > 12
    pieces, p = L.Pieces.of(vocabulary), np.random.default_rng(4).random((len(vocabulary), 2)) * 1e-3
    table = dict(zip(vocabulary, np.log(p)))
    long_piece = max(vocabulary, key=len)
    words = [b"donaudampfschifffahrtsgesellschaftskapitaen", "汉语没有空格".encode() * 9, b"a", b"internationalization",
             long_piece.strip() * 3, "สวัสดีชาวโลก".encode() * 40]
    assert sum(len(w) >= L.SHORT for w in words) >= 4
    want = [plain_forward(b" " + w, table) for w in words]
    assert np.allclose(L.Lattice(words, pieces).log_likelihood(p, len(words)), want, rtol=1e-9)
    monkeypatch.setattr(L, "BLOCK", 37)  # windows that move over many blocks
    assert np.allclose(L.Lattice(words, pieces).log_likelihood(p, len(words)), want, rtol=1e-9)


def test_expected_counts_of_long_words(monkeypatch):
    """Against the derivative of the log likelihood, which they are."""
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abab", b"ba", b"bab"})
    pieces = L.Pieces.of(vocabulary)
    rng = np.random.default_rng(2)
    p = (rng.random((len(vocabulary), 1)) + 0.1) / 100
    words, weight = [b"abab" * 20, b"abba", b"b" * 50], np.array([2.0, 3.0, 0.5])
    monkeypatch.setattr(L, "BLOCK", 29)
    got = L.Lattice(words, pieces).expected(p, weight)
    for piece in (b"a", b"ab", b"abab", b" a", b"b", b"bab"):
        k, step = vocabulary.index(piece), 1e-6
        up, down = p.copy(), p.copy()
        up[k] *= 1 + step
        down[k] *= 1 - step
        ll = [weight @ L.Lattice(words, pieces).log_likelihood(x, 3)[:, 0] for x in (up, down)]
        assert got[k] == pytest.approx((ll[0] - ll[1]) / (2 * step), abs=1e-3)


def test_texts_without_letters():
    model = L.Model(L.Pieces.of(L.vocabulary(VOCAB)), ["de", "en"], np.full((len(L.vocabulary(VOCAB)), 2), 1e-4), np.zeros(2))
    lang, score = model.predict(["½", "² 12", "Ⅳ ①", "__ 3", "é", "ª", "汉", "", None, "x"])
    assert [x == L.UND for x in lang] == [True] * 4 + [False] * 3 + [True, True, False]
    assert [s == 0 for s in score] == [True] * 4 + [False] * 3 + [True, True, False]


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b" ", b"ab", b" a", b"aba", b"ba"]
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2))
    table = dict(zip(pieces, p))

    def total(w):
        out = np.zeros(2)
        for cuts in product((0, 1), repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            parts = [w[x:y] for x, y in zip(at, at[1:])]
            if all(x in table for x in parts):
                out += np.prod([table[x] for x in parts], axis=0)
        return out

    words = [b"a", b"ab", b"abab", b"babaab", b"aaaa"]
    lat = L.Lattice(words, L.Pieces.of(pieces))
    assert np.allclose(lat.log_likelihood(p, len(words)), [np.log(total(b" " + w)) for w in words])
    # expected counts: the derivative of the log likelihood by the log of each probability
    weight = np.array([1.0, 2, 3, 0.5, 1])
    q = p[:, :1]
    base = weight @ lat.log_likelihood(q, len(words))[:, 0]
    got = lat.expected(q, weight)
    for k in range(len(pieces)):
        up = q.copy()
        up[k] *= 1 + 1e-6
        assert abs((weight @ lat.log_likelihood(up, len(words))[:, 0] - base) / 1e-6 - got[k]) < 1e-3


def test_long_words_are_modelled_in_parts_and_counted_whole():
    pieces = L.Pieces.of(L.vocabulary(VOCAB))
    p = np.full((pieces.size, 1), 1 / pieces.size)
    one = L.Lattice([b"x" * 100_000], pieces).log_likelihood(p, 1)
    assert np.isfinite(one).all() and one[0, 0] < L.Lattice([b"x" * 50_000], pieces).log_likelihood(p, 1)[0, 0]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, VOCAB)
    got = L.predict(docs, model).join(docs.select("doc_id", "lang"), F.col("id") == F.col("doc_id")).filter(Q.held_out("id")).toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_defined_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the cat", "of this", "and"]) for _ in range(9)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(["der hund", "und das", "ist"]) for _ in range(9)), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 -- !", "de"), (None, "der hund ist", None), (203, "THE CAT", None),
             (203, "THE CAT", None), (204, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("th", F.lit("x")).repartition(3)
    out = [(r.id, r.lang_pred, r.score) for r in L.predict(docs, L.train(docs, VOCAB)).collect()]
    got = {i: (lang, s) for i, lang, s in out}
    assert len(out) == len(rows)
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[None][0] == "de" and got[203][0] == "en" and got[204][0] in ("en", "de")
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.predict(untaught, L.train(untaught, VOCAB)).collect()} == {"und"}
    empty = docs.limit(0)
    assert L.predict(empty, L.train(empty, VOCAB)).count() == 0


@pytest.mark.parametrize("piece", [b"a", b" the", "é".encode()])
def test_piece_table_finds_every_piece(piece):
    v = L.vocabulary(VOCAB)
    t = L.Pieces.of(v)
    h = np.array([L._hash_bytes(piece), 12345], dtype=np.uint64)
    assert t.find(h).tolist() == [v.index(piece) + 1, 0]
