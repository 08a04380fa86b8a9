"""Near-duplicate classes against all pairs by brute force, and the parts by themselves."""

import random
from itertools import combinations

import numpy as np

from packwright.llm import common as C
from packwright.llm import near_dup as N


def idf_of(docs):
    return N.document_frequencies(docs, "text", 5, N.IDF_SHARE)


def brute(texts, idf, similarity=0.8):
    """Smallest number of the class of each text, by exact similarity of all pairs."""
    bags = [N.weights(C.hash_words((t or "").encode())[0], idf, 5) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if texts[i] is None or texts[j] is None:
            continue
        if texts[i] == texts[j] or N.weighted_jaccard(*bags[i], *bags[j]) >= similarity:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def make_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(20, 200))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def run(docs, **options):
    return {r.id: r for r in N.near_duplicates(docs, **options).collect()}


def test_classes_match_brute_force(make_docs):
    texts = make_texts(1) + [None, None, "", "", "!!!", "???", "!!!", "One two", "one, TWO", "a b c d", "a b c e"]
    docs = make_docs(texts, 4)
    want = brute(texts, idf_of(docs))
    got = run(docs)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = {c: want.count(c) for c in want}
    assert all(got[i].class_size == sizes[want[i]] and got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_large_group_of_near_copies(make_docs):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(150)] = f"x{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 50 + [" ".join(f"y{rng.randrange(10**6)}" for _ in range(120)) for _ in range(200)]
    got = run(make_docs(texts, 6))
    assert {got[i].class_id for i in range(450)} == {0} and got[0].class_size == 450
    assert all(got[i].class_size == 1 for i in range(450, 650))


def test_hub_in_the_centre_joins_copies_that_are_not_alike(make_docs):
    """Copies that are near the original, but not near each other: each differs elsewhere."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}.{j}" for j in range(20)] + base[k + 20:]) for k in range(0, 360, 36)] + [" ".join(base)]
    docs = make_docs(texts, 3)
    idf = idf_of(docs)
    assert len(set(brute(texts, idf))) == 1 and len(set(brute(texts[:-1], idf))) == 10
    assert len({r.class_id for r in run(docs).values()}) == 1


def template_texts(pages=200, planted=60, seed=11):
    """Pages that share three quarters of their shingles, and near copies of some of them whose
    similarity is little over the bound: most of their common samples are the template's."""
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    template = own(174)
    bases = [template + own(18) for _ in range(pages)]
    return [" ".join(b) for b in bases] + [" ".join(b[:-12] + own(12)) for b in bases[:planted]]


def test_pairs_of_a_template_that_are_no_hubs(make_docs):
    texts = template_texts()
    docs = make_docs(texts, 4)
    want = brute(texts, idf_of(docs))
    assert len(set(want)) == 200
    got = run(docs)
    assert [got[i].class_id for i in range(len(texts))] == want


def test_prefixes_lose_no_similar_pair(spark, make_docs):
    """Also pairs at the bound, of unlike lengths, and with repeated shingles."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 120))]
        texts += [" ".join(base), " ".join(base + base[: rng.randint(0, len(base) // 3)]), " ".join(base[rng.randint(0, len(base) // 4):])]
    docs = make_docs(texts)
    idf = idf_of(docs)
    rows = [(i, i - i % 2 if i < 20 else i, t) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "key long, root long, text string")
    first = N.prefixes(members.select("key", "root"), members.select("key", "text"), spark.sparkContext.broadcast(idf), 5, 0.8)
    got = {(r.key, r.hub) for r in N.possible_pairs(first, 0.8).collect()}
    bags = [N.weights(C.hash_words(t.encode())[0], idf, 5) for t in texts]
    alike = {(j, i) for i, j in combinations(range(len(texts)), 2)
             if rows[i][1] != rows[j][1] and N.weighted_jaccard(*bags[i], *bags[j]) >= 0.8}
    assert len(alike) > 10 and alike <= got
    assert all(rows[i][1] != rows[j][1] for i, j in got) and len(got) < 200


def test_icws_agrees_with_weighted_similarity():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = h[:240], h[60:]
    wa, wb = rng.random(240) + 0.5, rng.random(240) + 0.5
    wb[:180] = wa[60:] * rng.choice([1.0, 1.5], 180)
    want = N.weighted_jaccard(a, wa, b, wb)
    got = (N.icws(a, wa, 2000) == N.icws(b, wb, 2000)).mean()
    assert abs(got - want) < 0.05
    assert (N.icws(a, wa, 48) == N.icws(a, wa, 48)).all()
    x = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64))  # more than one step
    assert len(np.unique(N.icws(x, np.ones(5000), 48))) > 40


def test_template_pages_below_the_bound_do_not_meet(spark, make_docs):
    """Pages alike at 0.73: own parts weigh less than a prefix, so template shingles stand in all
    prefixes; no page holds them in the shorter prefix of a lighter text."""
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    template = own(204)
    texts = [" ".join(template + own(25)) for _ in range(150)]
    docs = make_docs(texts, 4)
    idf = idf_of(docs)
    members = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, root long, text string")
    first = N.prefixes(members.select("key", "root"), members.select("key", "text"), spark.sparkContext.broadcast(idf), 5, 0.8)
    assert first.groupBy("token").count().filter("count = 150").count() > 0
    assert N.possible_pairs(first, 0.8).count() == 0
    assert len({r.class_id for r in run(docs).values()}) == 150


def test_weights_are_tf_idf(make_docs, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", "a b", "a b"]
    sets = [set(map(tuple, bag)) for bag in (
        [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else [] for w in ((t or "").split() for t in texts))]
    of_all = sum(map(len, sets))
    for most in (1 << 16, 40):
        monkeypatch.setattr(N, "FREQUENT", most)
        least = max(2, -(-of_all // most))
        idf = N.document_frequencies(make_docs(texts, 5), "text", 5, 0.5)
        assert len(idf.hashes) <= most
        for shingle in set().union(*sets):
            df = max(least, sum(shingle in s for s in sets))
            want = 1 + 0.5 * np.log((len(texts) + 1) / (df + 1)) / np.log((len(texts) + 1) / (least + 1))
            words = C.hash_words(" ".join(shingle * 2).encode())[0][: len(shingle)]
            s, w = N.weights(words, idf, 5)
            assert len(s) == 1 and abs(w[0] - want) < 1e-5


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(25)] + [(7, 7)]
    got = {r.key: r.root for r in N.components(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root if find(i) != i}


def test_one_row_of_each_class_stays(spark, make_docs):
    texts = [(5, "same text here"), (5, "same text here"), (3, "Same, text here!"), (None, "null id"), (None, "null id"), (8, None),
             (8, None), (9, "other words"), (4, ""), (2, "")]
    docs = make_docs(texts).selectExpr("*", "1 AS id", "2 AS row", "3 AS key", "4 AS again", "5 AS rth")
    out = N.one_of_each(docs, N.near_duplicates(docs))
    assert out.columns == docs.columns
    got = sorted(str(r.doc_id) + "|" + str(r.text) for r in out.collect())
    assert got == ["2|", "3|Same, text here!", "8|None", "9|other words", "None|null id"]


def test_empty_table(make_docs):
    assert run(make_docs([])) == {}
    assert N.one_of_each(make_docs([]), N.near_duplicates(make_docs([]))).count() == 0
