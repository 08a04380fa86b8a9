"""Plan-shape guards for the properties the design depends on at scale."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from packwright.operators import examples as X
from packwright.operators import instruct as I
from packwright.operators.packing import pack_text
from packwright.operators.tokens import build_vocab
from packwright.params import Params


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _docs(spark):
    rows = [(k, f"s{k % 3}", f"word{k % 17} and more text {k}.<|endoftext|>") for k in range(400)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8)


def test_packing_has_one_hash_exchange_and_a_broadcast_vocabulary(spark):
    d = _docs(spark).withColumn("pack_group", F.expr("doc_id div 100"))
    v = build_vocab(d, "text", Params(vocab_size=50))
    p = plan(pack_text(d, "text", ["source", "pack_group"], "doc_id", v, Params(max_length=16, vocab_size=50)))
    main = p.split("BroadcastExchange")[0]
    assert p.count("Exchange hashpartitioning(source") == 1
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "ObjectHashAggregate" in main


def test_sft_gather_reuses_the_conversation_partitioning(spark):
    rows = [(c, t, f"q{c}{t}", "", f"a{c}{t}", []) for c in range(20) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, instruction string, input string, output string, "
                                     "history array<array<string>>").repartition(4, "conv_id")
    v = build_vocab(df.select(F.col("output").alias("text")), "text")
    p = plan(X.sft_examples(df, ["conv_id", "turn"], v, Params(max_length=128)))
    assert p.count("Exchange hashpartitioning") == 1  # the input's own; the gather adds none


def test_dedup_reduces_before_the_shuffle(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", "", []) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, instruction string, input string, history array<array<string>>")
    out = I.dedup_first(df, I.dedup_key(), "idx")
    p = plan(out)
    assert "partial_min_by" in p and p.count("Exchange") == 1
    kept = {r.idx for r in out.collect()}
    assert 0 in kept and 3 not in kept and len(kept) == 201


def test_hot_source_spreads_over_bounded_pack_groups(spark):
    from packwright.operators.packing import pack_ids, with_pack_group

    # source "hot" holds a third of the rows
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 7}", [k % 50 + 3] * (k % 5 + 1) + [2]) for k in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ids array<int>")
    g = with_pack_group(df, ["source"], "doc_id", Params(group_rows=1000))
    sizes = g.groupBy("source", "pack_group").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1000
    hot_groups = sizes.filter("source = 'hot'").count()
    assert hot_groups >= 10
    # the hot source's groups land on many hash partitions of the packing exchange
    n = 16
    parts = g.filter("source = 'hot'").select(F.pmod(F.hash("source", "pack_group"), F.lit(n)).alias("p")).distinct().count()
    assert parts >= hot_groups // 2
    # and packing per group equals the per-group loop
    out = pack_ids(g, "ids", ["source", "pack_group"], "doc_id", Params(max_length=8))
    got = {(r.source, r.pack_group, r.chunk): r.input_ids for r in out.collect()}
    want = {}
    by = {}
    seen = {}
    for k, s, ids in rows:  # ascending keys
        seen[s] = seen.get(s, -1) + 1
        by.setdefault((s, seen[s] // 1000), []).append((k, ids))
    for (s, grp), docs in by.items():
        flat = [t for _, ids in sorted(docs) for t in ids]
        for c in range(len(flat) // 8):
            want[(s, grp, c)] = flat[c * 8:(c + 1) * 8]
    assert got == want


def test_counting_plans_do_not_encode(spark):
    from packwright.operators import examples as X

    df = spark.createDataFrame([(1, "q", "", "r", [["a", "b"]])],
                               "k int, instruction string, input string, output string, history array<array<string>>")
    pairs = df.drop("output", "history").withColumn("output", F.array(F.lit("a"), F.lit("b")))
    for p in (plan(X.sft_lengths(df, ["k"])), plan(X.overlength_report(X.sft_lengths(df, []), X.dpo_lengths(pairs, [])))):
        assert "Join" not in p and "posexplode" not in p and "collect_list" not in p


def test_index_moves_keys_only(spark):
    from packwright.operators.ordering import global_index

    df = spark.createDataFrame([(k, "x" * 50) for k in range(100)], "k long, payload string").repartition(4)
    out = global_index(df, ["k"])
    scans = [line for line in plan(out).split("\n") if "Scan ExistingRDD" in line and "payload" in line and "__" in line]
    assert not scans
    assert [(r.k, r.idx, len(r.payload)) for r in out.orderBy("k").collect()] == [(k, k, 50) for k in range(100)]
