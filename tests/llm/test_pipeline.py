"""The pipeline's stages against their operators by brute force, and the registry."""

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as CP
from packwright.llm import quality as Q
from tests.llm.test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_names_and_registration():
    assert [n for n, _ in CP.STAGES] == ["quality", "line_dedup", "near_dup", "decontamination", "byte_bpe"]
    names = set(E.queries())
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for k, (name, stage) in enumerate(CP.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
        if name != "byte_bpe":
            assert steps[-1].columns == columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert all(set(b) <= set(a) for a, b in zip(rows, rows[1:]))

    model = Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.id: r.score for r in Q.score(docs, model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s >= 0.3} and rows[1] == {i: rows[0][i] for i in rows[1]}

    want = brute_lines([(i, r.text) for i, r in rows[1].items()], 10, 1)
    assert {i: t for i, t, *_ in want} == {i: r.text for i, r in rows[2].items()}
    assert all(r.n_chars == len(r.text) for r in rows[2].values())

    # of texts that are the same one stays, the first; none goes without a like one that stays
    first = {}
    for i in sorted(rows[2]):
        first.setdefault(rows[2][i].text, i)
    assert set(rows[3]) <= set(first.values())
    shingles = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in
                ((i, r.text.lower().split()) for i, r in rows[2].items())}
    for i in set(rows[2]) - set(rows[3]):
        assert any(len(shingles[i] & shingles[j]) > 0.6 * len(shingles[i] | shingles[j]) for j in shingles if j != i)

    lib = tiktoken.Encoding("x", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))})
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        ids = lib.encode_ordinary(rows[4][i].text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(rows[4][i].text.encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = CP.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.agg(F.countDistinct("doc_id"), F.count("*")).first()[0] == out.count() > 100


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(CP.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_messy_documents_pass_through_every_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns with odd names."""
    good = [(i, f"A plain document number {i} with words of its own, {i * 7} and {i * 13}.\nIt has a second line, {i}.", "en", "s", 1)
            for i in range(40)]
    odd = [(None, None, None, None, None), (None, None, None, None, None), (50, "", "en", None, 0), (51, None, None, "s", None),
           (52, "\n\n\n", "de", "s", 3), (53, "| | | ### %%%", "en", "s", 1), (54, "word " * 60_000, "en", "s", 5),
           (55, "x" * 200_000, "en", "s", 5), (None, "null id but a text of its own", "en", "s", 2), good[3], good[3], (3, "same id, other text", "en", "s", 1)]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = {n: i for i, n in enumerate(("id", "th", "row", "kept", "key", "score", "ids", "rid", "rth", "again", "t", "n_words"))}
    docs = docs.selectExpr("*", *[f"{i} AS {n}" for n, i in names.items()])
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(CP.STAGES):
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name == "near_dup":
            kept = docs.groupBy("doc_id", "text").count().collect()
            assert all(r["count"] == 1 or r.text is None for r in kept)
    assert all(b <= a for a, b in zip(counts, counts[1:])) and counts[-1] > 0
