"""Packing by batches with one exchange equals packing by numbered groups."""

import random
import re

import pytest

from packwright.operators import packing as P
from packwright.operators.tokens import build_vocab
from packwright.params import Params


def docs(spark, n=900):
    rng = random.Random(6)
    rows = []
    for k in rng.sample(range(10**6), n):
        source = rng.choice(["hot", "hot", "a", "b", "ç", None])
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20)))
        rows.append(("train" if k % 9 else "validation", source, k, rng.choice([text, text, text, None])))
    return spark.createDataFrame(rows, "split string, source string, doc_id long, text string").repartition(7)


def got(df):
    return sorted(((r.split, r.source, r.pack_group, r.chunk, tuple(r.input_ids), tuple(r.attention_mask)) for r in df.collect()), key=str)


@pytest.mark.parametrize("group_rows, parts", [(10, 8), (1, 8), (100, 3), (5000, 8)])
def test_equal_to_numbered_groups(spark, group_rows, parts):
    p = Params(max_length=8, vocab_size=50, group_rows=group_rows)
    d = docs(spark).filter("source IS NOT NULL AND text IS NOT NULL")
    v = build_vocab(d, "text", p)
    numbered = P.with_pack_group(d, ["split", "source"], "doc_id", p)
    want = got(P.pack_text(numbered, "text", ["split", "source", "pack_group"], "doc_id", v, p))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got(P.pack_text_in_batches(d, "text", ["split", "source"], "doc_id", v, p)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) > (10 if group_rows > 1 else 0)


def test_one_exchange_of_the_texts(spark):
    p = Params(max_length=8, vocab_size=50, group_rows=10)
    d = docs(spark)
    plan = P.pack_text_in_batches(d, "text", ["split", "source"], "doc_id", build_vocab(d, "text", p), p)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("BroadcastExchange")[0]
    assert len(re.findall(r"shufflepartitionidpassthrough", plan)) == 1
    assert not re.findall(r"Exchange hashpartitioning", top)


def test_empty_and_many_groups(spark, monkeypatch):
    p = Params(max_length=4, vocab_size=50, group_rows=10)
    d = docs(spark, 200).filter("source IS NOT NULL")
    v = build_vocab(d, "text", p)
    assert P.pack_text_in_batches(d.limit(0), "text", ["split", "source"], "doc_id", v, p).count() == 0
    whole = got(P.pack_text_in_batches(d, "text", ["split", "source"], "doc_id", v, p))
    monkeypatch.setattr(P, "MOST_GROUPS", 2)
    assert got(P.pack_text_in_batches(d, "text", ["split", "source"], "doc_id", v, p)) == whole
