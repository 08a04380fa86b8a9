"""End-to-end jobs on small files written by the tests."""

import json

from pyspark.sql import functions as F

from packwright import jobs
from packwright.params import Params


def _write_pile(spark, base, n_docs, n_files):
    rows = [(f"doc {i} " + " ".join(f"w{j}" for j in range(i % 7 + 1)),) for i in range(n_docs)]
    spark.createDataFrame(rows, "text string").repartition(n_files).write.parquet(base)


def test_pretrain_job_packs_every_row_to_length(spark, tmp_path):
    tr, va, out = str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "out")
    _write_pile(spark, tr, 300, 3)
    _write_pile(spark, va, 40, 1)
    p = Params(max_length=16, vocab_size=100)
    jobs.pretrain(spark, "pile", tr, va, out, p, vocab_out=str(tmp_path / "vocab"))
    res = spark.read.parquet(out)
    assert res.filter(F.size("input_ids") != 16).count() == 0
    assert set(r.split for r in res.select("split").distinct().collect()) == {"train", "validation"}
    # only the short tail of each packing batch is dropped
    v = spark.read.parquet(str(tmp_path / "vocab"))
    assert v.count() <= 100


def test_pretrain_job_num_files_takes_sorted_shards(spark, tmp_path):
    tr, va, out = str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "out")
    _write_pile(spark, tr, 300, 3)
    _write_pile(spark, va, 40, 2)
    raw = jobs.read_pretraining(spark, "pile", tr, va, num_files=1)
    first = sorted(p for p in __import__("os").listdir(tr) if p.endswith(".parquet"))[0]
    n_first = spark.read.parquet(f"{tr}/{first}").count()
    assert raw.filter("split = 'train'").count() == n_first


def test_combine_and_sft_and_dpo_jobs(spark, tmp_path):
    def dump(name, recs):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(recs, ensure_ascii=False))
        return str(p)

    a = dump("a", [{"instruction": f"q{i}", "input": "", "output": f"answer {i}"} for i in range(30)])
    dup = dump("dup", [{"instruction": "same", "input": "", "output": f"o{i}", "history": [["u", "v"]]} for i in range(5)]
               + [{"instruction": "other", "input": "x", "output": "o", "history": []}])
    ph = dump("ph", [{"instruction": "who", "input": "", "output": "I am <NAME> by <AUTHOR>"}])
    out = str(tmp_path / "combined")
    jobs.combine(spark, [a], dup, ph, out, Params(placeholder_values=(("<NAME>", "N"), ("<AUTHOR>", "A"))))
    res = spark.read.schema(jobs.SCHEMAS["sft"] + ", split string").json(out)
    assert res.count() == 30 + 2 + 1
    assert res.filter("split = 'test'").count() == 4  # ceil(0.1 * 33)
    assert res.filter("output = 'I am N by A'").count() == 1
    assert res.filter("instruction = 'same'").first()["output"] == "o0"

    ex = str(tmp_path / "sft")
    jobs.examples(spark, "sft", f"{out}/split=train", f"{out}/split=test", ex, Params(max_length=64))
    s = spark.read.parquet(ex)
    assert s.count() > 0 and s.filter(F.size("labels") != 64).count() == 0

    pref = dump("pref", [{"instruction": f"q{i}", "input": "", "output": [f"good {i}", f"bad {i}"]} for i in range(6)])
    dp = str(tmp_path / "dpo")
    jobs.examples(spark, "dpo", pref, pref, dp, Params(max_length=64), array=True)
    d = spark.read.parquet(dp)
    assert d.count() == 12 and d.filter(F.size("rejected_labels") != 64).count() == 0


def test_pretraining_does_not_depend_on_input_splits(spark, tmp_path):
    """Packing batches are runs of rows in file order, however the files are cut among tasks."""
    lines = [json.dumps({"id": str(i), "content": f"doc {i} " + "w " * (i % 9)}) for i in range(700)]
    for name, of in (("train", [lines[:300], lines[300:650]]), ("valid", [lines[650:]])):
        (tmp_path / name).mkdir()
        for k, part in enumerate(of):
            (tmp_path / name / f"part-{k}.json").write_text("\n".join(part))
    conf = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before, got = [spark.conf.get(c) for c in conf], []
    try:
        for k, size in enumerate(("1000000", "900")):
            spark.conf.set(conf[0], size)
            spark.conf.set(conf[1], "0")
            out = jobs.pretrain(spark, "wanjuan", str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / f"out{k}"),
                                Params(max_length=16, vocab_size=200, group_rows=100))
            got.append(sorted((r.split, r.input_ids) for r in spark.read.parquet(out).collect()))
        raw = jobs.read_pretraining(spark, "wanjuan", str(tmp_path / "train"), str(tmp_path / "valid"))
        assert [r.id for r in raw.filter("split = 'train'").orderBy(jobs.ORDER).collect()] == [str(i) for i in range(650)]
        assert sorted(r[0] for r in raw.filter("split = 'train'").select(jobs.ORDER).collect()) == list(range(650))
    finally:
        for c, v in zip(conf, before):
            spark.conf.set(c, v)
    assert got[0] == got[1] and len(got[0]) > 50


def test_cli_entry(spark, tmp_path):
    tr, va, out = str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "out")
    _write_pile(spark, tr, 100, 2)
    _write_pile(spark, va, 20, 1)
    jobs.main(["--task", "pretrain", "--dataset", "pile", "--train_dir", tr, "--valid_dir", va,
               "--output_path", out, "--max_length", "8", "--vocab_size", "64"])
    assert spark.read.parquet(out).filter(F.size("input_ids") != 8).count() == 0


def test_pretrain_job_nested_encyclopedia_json_and_code_filter(spark, tmp_path):
    rows = [{"title": f"T{i}", "summary": None if i % 2 else f"summary number {i} long enough",
             "sections": [{"title": "S", "content": f" body {i} " * 10}, {"title": "截图", "content": "x"}],
             "tags": [], "url": f"u{i}"} for i in range(50)]
    for name in ("train", "valid"):
        d = tmp_path / name
        d.mkdir()
        (d / "part.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    out = str(tmp_path / "out")
    jobs.pretrain(spark, "baidubaike", str(tmp_path / "train"), str(tmp_path / "valid"), out,
                  Params(max_length=32, vocab_size=200))
    res = spark.read.parquet(out)
    assert res.count() > 0 and res.filter(F.size("input_ids") != 32).count() == 0

    code = tmp_path / "code"
    spark.createDataFrame([(f"print({i})", "r", "p", "Python" if i % 3 else "Go", "mit", 10) for i in range(90)],
                          jobs.SCHEMAS["code"]).write.parquet(str(code / "train"))
    spark.createDataFrame([(f"print({i})", "r", "p", "Python", "mit", 10) for i in range(9)],
                          jobs.SCHEMAS["code"]).write.parquet(str(code / "valid"))
    raw = jobs.read_pretraining(spark, "code", str(code / "train"), str(code / "valid"))
    kept = jobs.corpus_text(raw, "code", Params(code_language="Python"))
    assert kept.filter("split = 'train'").count() == 60


def test_pretrain_job_with_sentencepiece_model(spark, tmp_path):
    import sentencepiece as spm

    lines = [f"doc {i} " + " ".join(f"w{j}" for j in range(i % 7 + 1)) for i in range(300)]
    corpus = tmp_path / "c.txt"
    corpus.write_text("\n".join(lines))
    prefix = str(tmp_path / "m")
    spm.SentencePieceTrainer.train(input=str(corpus), model_prefix=prefix, vocab_size=40, bos_piece="<|startoftext|>",
                                   eos_piece="<|endoftext|>", unk_piece="<unk>", pad_id=-1, minloglevel=2)
    tr, va, out = str(tmp_path / "train"), str(tmp_path / "valid"), str(tmp_path / "out")
    _write_pile(spark, tr, 300, 2)
    _write_pile(spark, va, 30, 1)
    sp = spm.SentencePieceProcessor(model_file=prefix + ".model")
    p = Params(max_length=16, eos_id=sp.piece_to_id("<|endoftext|>"), bos_id=sp.piece_to_id("<|startoftext|>"))
    jobs.pretrain(spark, "pile", tr, va, out, p, tokenizer_model=prefix + ".model")
    res = spark.read.parquet(out)
    assert res.count() > 0 and res.filter(F.size("input_ids") != 16).count() == 0
    # every packed row's segment numbers step after the model's eos id
    eos = p.eos_id
    for r in res.limit(20).collect():
        cur = 1
        for t, m in zip(r.input_ids, r.attention_mask):
            assert m == cur
            cur += t == eos


def test_combined_split_is_the_same_for_any_cluster_size(spark, tmp_path):
    src = tmp_path / "d.jsonl"
    src.write_text("\n".join(json.dumps({"instruction": f"q{i % 900}", "input": "", "output": f"o{i}", "history": [["u", "v"]]})
                             for i in range(1000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")}
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for parts, split in (("8", "128m"), ("16", "8k")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            out = jobs.combine(spark, [], str(src), None, str(tmp_path / f"out{parts}"), array=False)
            res = spark.read.schema(jobs.SCHEMAS["sft"] + ", split string").json(out)
            got.append(sorted(r.output for r in res.filter("split = 'test'").collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got[0]) == 90 and got[0] == got[1]


def test_code_corpus_keeps_its_rows_by_default(spark):
    raw = spark.createDataFrame([(0, "train", "x = 1", "Python"), (1, "train", "int x;", "C")],
                                "__order long, split string, code string, language string")
    assert [r.text for r in jobs.corpus_text(raw, "code").collect()] == ["x = 1<|endoftext|>"]
