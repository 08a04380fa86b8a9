"""Decontamination against a plain search for every window in every document."""

import random
import re

from packwright.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, size, one_in=20):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q:q + n] == v[p:p + n]:
                        hit |= set(range(q, q + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and one_in * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, make_docs, docs, items, **options):
    b = spark.createDataFrame(items, "item_id long, text string")
    out = D.contamination(make_docs(docs, 4), b, **options)
    return sorted([(r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect()], key=str)


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "é", "x1", "ß"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(0, 9))) for k in range(25)] + [(3, "a b c"), (90, None), (91, "..."), (92, "É")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "A, B! c"), (None, "a b c"),
                                                                    (5, "a b"), (5, "a b")]
    for size, shingle in ((13, 4), (4, 2), (3, 3), (1, 1)):
        assert run(spark, make_docs, docs, items, size=size, shingle=shingle) == brute(docs, items, size)


def test_long_document_and_planted_passage(spark, make_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(30))
    long = " ".join(word() for _ in range(400_000))
    docs = [(1, long + " " + passage.upper() + " tail"), (2, "start " + passage), (3, " ".join(passage.split()[:12]))]
    got = run(spark, make_docs, docs, [(7, passage)])
    assert got == [(1, 400_031, 30, ["7"], False), (2, 31, 30, ["7"], True), (3, 12, 0, [], False)]


def test_empty_tables(spark, make_docs):
    assert run(spark, make_docs, [], [(1, "a b")]) == []
    assert run(spark, make_docs, [(1, "a b")], []) == [(1, 2, 0, [], False)]


def test_contaminated_boundary(spark, make_docs):
    filler = " ".join(f"w{k}" for k in range(57))
    docs = [(1, filler + " p q r"), (2, filler + " extra p q r")]
    assert [r[4] for r in run(spark, make_docs, docs, [(1, "p q r")])] == [True, False]  # 20 * 3 against 60 and 61


def test_stage_keeps_clean_rows_whole(spark, make_docs):
    docs = make_docs([(1, "p q r"), (2, "clean text"), (3, None), (None, "p q r"), (2, "clean text")]).selectExpr("*", "1 AS id", "2 AS row")
    out = D.clean_documents(docs, spark.createDataFrame([(1, "p q r")], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) + str(r.text) for r in out.collect()) == ["2clean text", "2clean text", "3None"]
