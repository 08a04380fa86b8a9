"""Operator properties: packing invariants, repartition invariance, exact split,
global index, first-occurrence dedup, preference arity, example builders."""

import pytest
from pyspark.sql import functions as F

from packwright.operators import examples as X
from packwright.operators import instruct as I
from packwright.operators.ordering import exact_split, global_index, seeded_order, sequential_index
from packwright.operators.packing import pack_ids, pack_text, running_offsets
from packwright.operators.tokens import build_vocab, decode_tokens, encode, encode_with_arrow
from packwright.params import Params
from packwright.sources.readers import read_jsonl

P4 = Params(max_length=4)


def test_pack_fixture_lists_3_4_2(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4, 5, 6, 7]), (0, 3, [8, 9])], "g int, k int, ids array<int>")
    rows = pack_ids(df, "ids", ["g"], "k", P4).orderBy("chunk").collect()
    assert [r["input_ids"] for r in rows] == [[1, 2, 3, 4], [5, 6, 7, 8]]  # token 9 dropped


def _brute_pack(docs, L):
    flat = [t for _, ids in sorted(docs) for t in ids]
    return [flat[i * L:(i + 1) * L] for i in range(len(flat) // L)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_pack_equals_loop_and_ignores_partitioning(spark, parts):
    import random

    rnd = random.Random(parts)
    docs = [(k, [rnd.randrange(3, 50) for _ in range(rnd.randrange(0, 30))] + [2]) for k in range(200)]
    df = spark.createDataFrame([(0, k, ids) for k, ids in docs], "g int, k int, ids array<int>").repartition(parts)
    got = [r["input_ids"] for r in pack_ids(df, "ids", ["g"], "k", Params(max_length=16)).orderBy("chunk").collect()]
    assert got == _brute_pack(docs, 16)
    masks = pack_ids(df, "ids", ["g"], "k", Params(max_length=16)).select("attention_mask").collect()
    assert all(m[0][0] == 1 and all(b >= a for a, b in zip(m[0], m[0][1:])) for m in masks)


def test_two_level_offsets_equal_single_window(spark):
    df = spark.createDataFrame([(k % 3, k, (k * 7) % 11) for k in range(500)], "g int, k int, n int")
    a = {(r.g, r.k): r.start for r in running_offsets(df, ["g"], "k", "n").collect()}
    b = {(r.g, r.k): r.start for r in running_offsets(df, ["g"], "k", "n", corpus_wide=True).collect()}
    assert a == b


def test_pack_text_equals_pack_of_encoded_ids(spark):
    texts = [(0, i, f"word{i} and more words, number {i}.<|endoftext|>") for i in range(60)]
    df = spark.createDataFrame(texts, "g int, k int, text string")
    v = build_vocab(df, "text", Params(vocab_size=40))
    p = Params(max_length=8, vocab_size=40)
    a = [r["input_ids"] for r in pack_text(df, "text", ["g"], "k", v, p).orderBy("chunk").collect()]
    e = encode_with_arrow(df, "text", v, p)
    c = [r["input_ids"] for r in pack_ids(e, "ids", ["g"], "k", p).orderBy("chunk").collect()]
    assert a == c and len(a) > 0


def test_encoders_agree(spark):
    df = spark.createDataFrame([(1, "Ab c1 <unk>é!"), (2, "x<|startoftext|>yy")], "k int, text string")
    v = build_vocab(df, "text")
    j = {r.k: r.ids for r in encode(df, "text", ["k"], v).collect()}
    a = {r.k: r.ids for r in encode_with_arrow(df, "text", v).collect()}
    assert j == a
    assert j[2][1] == 1  # the bos marker is one special token


def test_exact_split_and_global_index(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 1001)], "k long")
    s = exact_split(df, "k", 0.1, 42)
    assert s.filter("split = 'test'").count() == 100
    idx = [r.idx for r in seeded_order(df, "k", 42).collect()]
    assert sorted(idx) == list(range(1000))
    g = global_index(df, ["k"])
    assert all(r.idx == r.k - 1 for r in g.collect())


def test_global_index_with_clustered_keys_and_partitions(spark):
    # a third of the keys sit in a narrow range; positions stay exact per partition value
    keys = [(e, k) for e in range(3) for k in list(range(300)) + [10_000_000 + i for i in range(150)]]
    df = spark.createDataFrame(keys, "e int, k long").repartition(7)
    g = global_index(df, ["k"], partition_cols=["e"], total="n")
    rows = g.collect()
    for e in range(3):
        got = sorted((r.idx, r.k) for r in rows if r.e == e)
        assert [i for i, _ in got] == list(range(450)) and [k for _, k in got] == sorted(k for ee, k in keys if ee == e)
        assert all(r.n == 450 for r in rows if r.e == e)
    s = sequential_index(df.filter("e = 0"), ["k"], out="i")
    assert sorted(r.i for r in s.collect()) == list(range(450))


def test_dedup_keeps_first_and_compat_key_collides(spark):
    rows = [(1, "ab", "c", []), (2, "a", "bc", []), (3, "ab", "c", []), (4, "q", "", [["h", "i"]])]
    df = spark.createDataFrame(rows, "idx int, instruction string, input string, history array<array<string>>")
    kept = sorted(r.idx for r in I.dedup_first(df, I.dedup_key(), "idx").collect())
    assert kept == [1, 2, 4]
    compat = sorted(r.idx for r in I.dedup_first(df, I.dedup_key(Params(dedup_compat=True)), "idx").collect())
    assert compat == [1, 4]


def test_preference_arity(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "k int, output array<string>")
    ok, bad = X.validate_preferences(df)
    assert [r.k for r in ok.collect()] == [1] and [r.k for r in bad.collect()] == [2]
    strict, _ = X.validate_preferences(df, strict=True)
    with pytest.raises(Exception):
        strict.collect()


def test_sft_example_drops_exact_length_and_masks_prompt(spark):
    df = spark.createDataFrame([(1, "hi", "", "yo", [])],
                               "k int, instruction string, input string, output string, history array<array<string>>")
    v = build_vocab(df.select(F.concat_ws(" ", "instruction", "output").alias("text")), "text")
    full = X.sft_examples(df, ["k"], v, Params(max_length=4096), keep_overlength=True).first()
    n = full["n_tokens"]
    assert full["labels"][-2:] != [-100, -100] and full["labels"][0] == -100
    assert X.sft_examples(df, ["k"], v, Params(max_length=n)).count() == 0
    kept = X.sft_examples(df, ["k"], v, Params(max_length=n + 1)).first()
    assert len(kept["input_ids"]) == n + 1 and kept["attention_mask"][-1] == 0 and kept["labels"][-1] == -100


def test_sample_rows_exact_n(spark, tmp_path):
    p = str(tmp_path / "rows")
    spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k int, text string").write.json(p)
    assert read_jsonl(spark, p, "k int, text string", order_col="k", num_samples=3).count() == 3


def test_map_batches_may_change_row_count(spark):
    import pandas as pd

    from packwright.operators.batch_map import map_batches

    df = spark.createDataFrame([(i, [i] * (i % 3)) for i in range(2500)], "k int, ids array<int>").coalesce(1)

    def pack(batch):  # flatten a batch and cut rows of 4, dropping the tail (per batch)
        flat = [t for ids in batch["ids"] for t in ids]
        return pd.DataFrame({"row": [flat[i:i + 4] for i in range(0, len(flat) // 4 * 4, 4)]})

    out = map_batches(df, pack, "row array<int>", batch_rows=1000)
    assert all(len(r.row) == 4 for r in out.collect()) and out.count() > 0


def test_sentencepiece_provider(spark, tmp_path):
    import sentencepiece as spm

    from packwright.operators.tokens import encode_with_sentencepiece

    lines = [f"the quick brown fox {i} jumps over the lazy dog number {i}" for i in range(200)]
    corpus = tmp_path / "c.txt"
    corpus.write_text("\n".join(lines))
    prefix = str(tmp_path / "m")
    spm.SentencePieceTrainer.train(input=str(corpus), model_prefix=prefix, vocab_size=60, bos_piece="<|startoftext|>",
                                   eos_piece="<|endoftext|>", unk_piece="<unk>", pad_id=-1, minloglevel=2)
    sp = spm.SentencePieceProcessor(model_file=prefix + ".model")
    specials = {"<|startoftext|>": sp.piece_to_id("<|startoftext|>"), "<|endoftext|>": sp.piece_to_id("<|endoftext|>")}
    df = spark.createDataFrame([(1, "the lazy fox<|endoftext|>"), (2, "<|startoftext|>dog 7")], "k int, text string")
    got = {r.k: r.ids for r in encode_with_sentencepiece(df, "text", prefix + ".model", specials).collect()}
    assert got[1] == sp.encode("the lazy fox") + [specials["<|endoftext|>"]]
    assert got[2] == [specials["<|startoftext|>"]] + sp.encode("dog 7")


def test_decoder_gives_one_result_for_known_unknown_and_negative_ids(spark):
    v = spark.createDataFrame([("<unk>", 0), ("a", 1), ("b", 5)], "token string, id int")
    df = spark.createDataFrame([(1, [1, 5, 0]), (2, [-100, -1, 1, 4, 6, 10_000, None]), (3, []), (4, None)], "k int, ids array<int>")
    got = {r.k: r.tokens for r in decode_tokens(df, "ids", ["k"], v).collect()}
    assert got == {1: ["a", "b", "<unk>"], 2: ["<unk>", "<unk>", "a"] + ["<unk>"] * 4, 3: [], 4: None}


def test_encoder_keeps_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "k int, text string")
    v = build_vocab(df, "text")
    got = {r.k: r.ids for r in encode(df, "text", ["k"], v).collect()}
    assert got[2] == [] and got[3] is None and len(got[1]) == 3
    assert got == {r.k: r.ids for r in encode_with_arrow(df, "text", v).collect()}


def test_a_vocabulary_beyond_the_bound_is_refused(spark):
    import pytest

    df = spark.createDataFrame([(1, "ab")], "k int, text string")
    with pytest.raises(ValueError, match="broadcast_limit_rows"):
        encode(df, "text", ["k"], build_vocab(df, "text"), Params(vocab_size=101, broadcast_limit_rows=100))


def test_an_outlying_key_keeps_the_offset_ranges(spark):
    from packwright.operators.packing import offset_buckets

    df = spark.createDataFrame([(0, k, 1) for k in [*range(1000), 2**61]], "g int, k long, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in offset_buckets(df, ["g"], "k").groupBy("__bucket").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 1001 and len(sizes) >= 4 and max(sizes) < 500
    assert {r.k: r.start for r in running_offsets(df, ["g"], "k", "n", corpus_wide=True).collect()}[2**61] == 1000


def test_every_rank_gets_rows(spark):
    from packwright.operators.loading import rank_shards

    df = spark.createDataFrame([(k,) for k in range(3)], "k long")
    r = rank_shards(df, "k", Params(world_size=8)).collect()
    assert sorted((x["rank"], x.position) for x in r) == [(i, 0) for i in range(8)]
    order = [x.k for x in sorted(r, key=lambda x: x["rank"])]
    assert order[3:6] == order[:3] and order[6:] == order[:2] and set(order[:3]) == {0, 1, 2}


def test_lengths_equal_those_of_encoded_examples(spark):
    from packwright.operators import examples as X

    rows = [(1, "hi there", "", "reply one", [["u", "v w"]]), (2, "q", "more", "", []), (3, "x y z", "", "r" * 5, None)]
    df = spark.createDataFrame(rows, "k int, instruction string, input string, output string, history array<array<string>>")
    v = build_vocab(df.selectExpr("output as text"), "text")
    p = Params(max_length=200)
    full = {r.k: (r.n_tokens, sum(x != -100 for x in r.labels)) for r in X.sft_examples(df, ["k"], v, p, keep_overlength=True).collect()}
    assert full == {r.k: (r.n_tokens, r.n_trained) for r in X.sft_lengths(df, ["k"], p).collect()}
    d = df.drop("history", "output").withColumn("output", F.array(F.lit("a b"), F.lit("c")))
    pairs = {r.k: (len(r.chosen_ids), len(r.rejected_ids)) for r in X.dpo_examples(d, ["k"], v, p, keep_overlength=True).collect()}
    assert pairs == {r.k: (r.n_chosen, r.n_rejected) for r in X.dpo_lengths(d, ["k"], p).collect()}


def test_split_is_the_sorted_hash_order(spark):
    import hashlib
    import math

    from packwright.operators import ordering as O

    keys = list(range(2500))
    df = spark.createDataFrame([(k, "payload") for k in keys], "k long, x string")
    for fraction in (0.0, 0.1, 0.5, 1.0):
        got = {r.k for r in O.exact_split(df, "k", fraction, 42).filter("split = 'test'").collect()}
        order = sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
        assert got == set(order[: math.ceil(len(keys) * fraction)])


def test_two_level_pack_text_equals_single_window(spark):
    texts = [(k % 2, k, f"w{k % 13} x{k % 5} and text {k}.<|endoftext|>") for k in range(400)]
    df = spark.createDataFrame(texts, "g int, k long, text string")
    v = build_vocab(df, "text", Params(vocab_size=60))
    p = Params(max_length=16, vocab_size=60)
    a = {(r.g, r.chunk): r.input_ids for r in pack_text(df, "text", ["g"], "k", v, p).collect()}
    b = {(r.g, r.chunk): r.input_ids for r in pack_text(df, "text", ["g"], "k", v, p, corpus_wide=True).collect()}
    assert a == b and len(a) > 10


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_and_decoding_make_no_row_per_token(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, ""), (3, None), (4, "ab"), (4, "c ab"), (None, "c")], "k int, text string")
    v = build_vocab(df, "text")
    e = encode(df, "text", ["k"], v)
    d = decode_tokens(e, "ids", ["k"], v)
    for p in (_plan(e), _plan(d)):
        assert "posexplode" not in p and "Generate" not in p.split("Subquery")[0]
    ids = {r.token: r.id for r in v.collect()}
    got = {r.k: r.ids for r in e.collect()}
    merged = sorted([(0, ids["ab"]), (0, ids["c"]), (1, ids[" "]), (2, ids["ab"])])  # rows of one key, by place
    assert got[4] == [i for _, i in merged] and got[None] == [ids["c"]] and got[2] == [] and got[3] is None
    assert {r.k: r.tokens for r in d.collect()}[1] == ["ab", " ", "c"]


def test_packing_sorts_slices_not_tokens(spark):
    rows = [(g, k, "ab c, " * (k * 7 % 23) + "z") for g in range(2) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, k int, text string")
    v = build_vocab(df, "text")
    want = pack_ids(encode(df, "text", ["g", "k"], v), "ids", ["g"], "k", Params(max_length=16))
    for wide in (False, True):
        p = pack_text(df, "text", ["g"], "k", v, Params(max_length=16), corpus_wide=wide)
        assert "posexplode" not in _plan(p)
        key = lambda r: (r.g, r.chunk)
        assert sorted(p.collect(), key=key) == sorted(want.select(*p.columns).collect(), key=key)


def test_pretokens_and_their_count_by_the_fast_patterns(spark):
    from pyspark.sql import functions as F

    from packwright.operators.tokens import JVM_PATTERN, pretoken_count, pretokens
    from packwright.params import PRETOKEN_PATTERN

    texts = ["", "ab c1 22", "<unk", "<unk>x<|endoftext|><|startoftext|>", "<<unk>> <|endoftext>|", "a\nb\r\n\u2028\x85é", "e\u0301ß中文", "😀𝒳𝒴𐐀1²Ⅷ", "\x00 <|", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert JVM_PATTERN != PRETOKEN_PATTERN
    rows = df.select("text", pretokens("text").alias("got"), F.regexp_extract_all("text", F.lit(PRETOKEN_PATTERN), 0).alias("want"),
                     pretoken_count("text").alias("n")).collect()
    assert all(r.got == r.want and r.n == (None if r.want is None else len(r.want)) for r in rows)
    # no list of tokens is made to count them
    assert "extract_all" not in _plan(df.select(pretoken_count("text")))


def test_decoding_finds_tokens_by_place(spark):
    v = spark.createDataFrame([("a", 3), ("c", 3), ("b", 5), ("far", 10**9), ("low", -7), ("nil", None)], "token string, id int")
    df = spark.createDataFrame([(1, [3, 5, 4, 10**9, -7, None, -100, 2**31 - 1])], "k int, ids array<int>")
    p = Params(vocab_size=8)
    want = ["a", "b", "<unk>", "far", "low", "<unk>", "<unk>", "<unk>"]
    d = decode_tokens(df, "ids", ["k"], v, p)
    assert d.first().tokens == want
    assert "__dense" in d._jdf.queryExecution().analyzed().toString()
    wide = decode_tokens(df.selectExpr("k", "cast(ids as array<bigint>) ids"), "ids", ["k"], v.selectExpr("token", "cast(id as bigint) id"), p)
    assert wide.first().tokens == want


def test_corpus_wide_packing_counts_tokens_once(spark, monkeypatch):
    from packwright.operators import packing

    seen, real = [], packing.running_offsets
    monkeypatch.setattr(packing, "running_offsets", lambda df, *a, **b: (seen.append(_plan(df)), real(df, *a, **b))[1])
    df = spark.createDataFrame([(0, k, f"w{k} x") for k in range(40)], "g int, k int, text string")
    p = pack_text(df, "text", ["g"], "k", build_vocab(df, "text"), Params(max_length=16), corpus_wide=True)
    assert p.count() == 11 and len(seen) == 1 and "regexp" not in seen[0]
