"""End-to-end jobs with the reference's task vocabulary, as Spark jobs:

* ``pretrain``: shard folders -> corpus rule -> encode -> pack -> parquet by split
* ``sft`` / ``dpo``: instruction / preference records -> padded examples -> parquet by split
* ``combine``: instruction sources -> union, repeat removal within one source,
  placeholder rewrite, exact seeded split -> JSON lines

Run ``python -m packwright.jobs --help``. Each stage boundary that is reused is a
written table (never a local checkpoint), so a lost executor only recomputes its
own partitions.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.functions import text as T
from packwright.operators import examples as X
from packwright.operators import instruct as I
from packwright.operators.packing import pack_ids, pack_text
from packwright.operators.tokens import build_vocab, encode_with_sentencepiece
from packwright.params import BOS_TOKEN, DEFAULT, EOS_TOKEN, Params
from packwright.sources import readers as R

# Record schemas of the corpora and instruction data (explicit, never inferred).
SCHEMAS = {
    "code": "code string, repo_name string, path string, language string, license string, size bigint",
    "wikipedia": "id string, url string, title string, text string",
    "baidubaike": "title string, summary string, sections array<struct<title:string,content:string>>, tags array<string>, url string",
    "wanjuan": "id string, content string",
    "pile": "text string",
    "sft": "instruction string, input string, output string, history array<array<string>>",
    "dpo": "instruction string, input string, output array<string>",
}
# The reference reads these corpora as JSON, the others as parquet.
JSON_CORPORA = ("baidubaike", "wanjuan")
ORDER = "__order"


def corpus_text(df: DataFrame, dataset: str, params: Params = DEFAULT) -> DataFrame:
    """Filter + text rule of one corpus (the reference's per-dataset dispatch)."""
    eos = F.lit(EOS_TOKEN)
    if dataset == "code":
        return df.filter(F.col("language") == params.code_language).select(ORDER, "split", T.assemble_plain("code").alias("text"))
    if dataset == "wikipedia":
        return df.select(ORDER, "split", T.assemble_wikipedia("title", "text").alias("text"))
    if dataset == "baidubaike":
        d = df.filter(T.content_length("summary", "sections") > 50)
        d = T.with_baike_text(d, out="__t")
        text = F.col("__t") if params.single_eos else F.concat(F.col("__t"), eos)
        return d.select(ORDER, "split", text.alias("text"))
    if dataset == "wanjuan":
        return df.select(ORDER, "split", T.assemble_plain("content").alias("text"))
    if dataset == "pile":
        return df.select(ORDER, "split", T.assemble_plain("text").alias("text"))
    raise ValueError(f"unknown dataset {dataset!r}")


PLACE = ["__file", "__at", "__row"]
MOST_RANGES = 500_000  # byte ranges whose offsets are broadcast


def placed(df: DataFrame, fmt: str) -> DataFrame:
    """PLACE columns of a file scan: file, byte range (Parquet: the whole file), and a number that
    goes up by one from row to row of a range. They follow from the files alone, so a second scan
    gives the same."""
    if fmt == "parquet":
        at, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        at, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.select("*", *[c.alias(n) for c, n in zip((F.col("_metadata.file_path"), at, row), PLACE)])


def in_file_order(df: DataFrame, out: str, within: list[str] | None = None) -> DataFrame:
    """Rows of :func:`placed` with their position in the source (file path, place in the file),
    from 0 in each value of ``within``: the same for any cluster size and any input splits. Rows
    stay where they are: only the counts of byte ranges, one row each, are put in order."""
    keys = [*(within or []), "__file", "__at"]
    ranges = df.groupBy(*keys).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*keys, (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first")).alias("__shift"))
    path = R.new_location(df.sparkSession, "range-offsets")
    before.write.parquet(path)
    before = df.sparkSession.read.parquet(path)
    if before.count() <= MOST_RANGES:
        before = F.broadcast(before)
    return df.join(before, keys).withColumn(out, F.col("__row") + F.col("__shift")).drop(*PLACE, "__shift")


def read_pretraining(spark: SparkSession, dataset: str, train_dir: str, valid_dir: str,
                     num_files: int | None = None, file_type: str | None = None) -> DataFrame:
    """The records of both splits, in file order within each."""
    fmt = file_type or ("json" if dataset in JSON_CORPORA else "parquet")
    frames = []
    for name, where in (("train", train_dir), ("validation", valid_dir)):
        shards = R.list_shards(spark, where)
        shards = shards if num_files is None else shards[:num_files]
        frames.append(placed(spark.read.schema(SCHEMAS[dataset]).format(fmt).load(shards), fmt).withColumn("split", F.lit(name)))
    return in_file_order(frames[0].unionByName(frames[1]), ORDER, ["split"])


def encoder_inputs(spark: SparkSession, params: Params, vocab_path: str | None, build_from: DataFrame | None,
                   vocab_out: str | None):
    """The vocabulary table: read from ``vocab_path``, or built from the corpus and
    written once (to ``vocab_out`` or the shared checkpoint folder)."""
    if vocab_path:
        return spark.read.parquet(vocab_path)
    out = vocab_out or R.new_location(spark, "vocab")
    build_vocab(build_from, "text", params).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def pretrain(spark: SparkSession, dataset: str, train_dir: str, valid_dir: str, output_path: str,
             params: Params = DEFAULT, num_files: int | None = None, file_type: str | None = None,
             vocab_path: str | None = None, tokenizer_model: str | None = None, vocab_out: str | None = None) -> str:
    raw = read_pretraining(spark, dataset, train_dir, valid_dir, num_files, file_type)
    docs = corpus_text(raw, dataset, params).withColumn(
        "pack_group", F.expr(f"{ORDER} div {params.group_rows}")).withColumn("source", F.lit(dataset))
    group = ["split", "source", "pack_group"]
    if tokenizer_model:
        specials = {BOS_TOKEN: params.bos_id, EOS_TOKEN: params.eos_id}
        ids = encode_with_sentencepiece(docs, "text", tokenizer_model, specials)
        rows = pack_ids(ids, "ids", group, ORDER, params)
    else:
        v = encoder_inputs(spark, params, vocab_path, docs, vocab_out)
        rows = pack_text(docs, "text", group, ORDER, v, params)
    R.write_splits(rows.select("split", "input_ids", "attention_mask"), output_path, mode="overwrite")
    return output_path


def read_records(spark: SparkSession, path: str, task: str, file_type: str = "json", array: bool = False) -> DataFrame:
    """Records with their position in the source."""
    if file_type == "json" and array:
        rows = R.read_json_array(spark, path, SCHEMAS[task], PLACE)
    else:
        rows = placed(spark.read.schema(SCHEMAS[task]).format(file_type).load(path), file_type)
    return in_file_order(rows, ORDER)


def examples(spark: SparkSession, task: str, train_file: str, valid_file: str, output_path: str,
             params: Params = DEFAULT, file_type: str = "json", array: bool = False, vocab_path: str | None = None,
             vocab_out: str | None = None) -> str:
    """SFT or preference examples for both splits, written partitioned by split."""
    frames = []
    for name, path in (("train", train_file), ("validation", valid_file)):
        frames.append(read_records(spark, path, task, file_type, array).withColumn("split", F.lit(name)))
    recs = frames[0].unionByName(frames[1])
    if vocab_path is None:
        text = F.concat_ws("\n", "instruction", "input", F.array_join(F.flatten(F.coalesce(
            F.col("history"), F.array().cast("array<array<string>>"))), "\n"), "output") if task == "sft" else \
            F.concat_ws("\n", "instruction", "input", F.array_join("output", "\n"))
        v = encoder_inputs(spark, params, None, recs.select(text.alias("text")), vocab_out)
    else:
        v = spark.read.parquet(vocab_path)
    key = ["split", ORDER]
    if task == "sft":
        out = X.sft_examples(recs, key, v, params).select("split", "input_ids", "attention_mask", "labels")
    elif task == "dpo":
        valid, _ = X.validate_preferences(recs, strict=True)
        out = X.dpo_examples(valid, key, v, params).drop(ORDER)
    else:
        raise ValueError(f"unknown task {task!r}")
    R.write_splits(out, output_path, mode="overwrite")
    return output_path


def combine(spark: SparkSession, sources: list[str], dedup_source: str | None, placeholder_source: str | None,
            output_dir: str, params: Params = DEFAULT, array: bool = True) -> str:
    """Concatenate instruction sources in order, drop repeats of the first occurrence
    inside ``dedup_source`` only, rewrite placeholders in ``placeholder_source``, give
    every record a history, split exactly (test fraction, seed), write JSON lines."""
    def records(path):
        return read_records(spark, path, "sft", array=array)

    frames = [records(path) for path in sources]
    if dedup_source:
        frames.append(I.dedup_first(records(dedup_source), I.dedup_key(params), ORDER))
    if placeholder_source:
        frames.append(I.rewrite_placeholders(records(placeholder_source), "output", params))
    # the split rests on (source, position in it), both fixed before anything is shuffled
    u = I.union_sources(frames).withColumn(ORDER, F.shiftleft(F.col("source_rank").cast("long"), 40) + F.col(ORDER))
    s = I.split_train_test(u, ORDER, params)
    cols = ["instruction", "input", "output", "history"]
    R.write_jsonl(s.select(*cols, "split"), output_dir, partition_by=["split"], mode="overwrite")
    return output_dir


def _params(args) -> Params:
    kw = {f.name: getattr(args, f.name) for f in fields(Params) if getattr(args, f.name, None) is not None}
    return DEFAULT.with_(**kw)


def main(argv=None):
    ap = argparse.ArgumentParser(description="packwright jobs")
    ap.add_argument("--task", default="pretrain", choices=["pretrain", "sft", "dpo", "combine"])
    ap.add_argument("--dataset", default="pile", choices=sorted(k for k in SCHEMAS if k not in ("sft", "dpo")))
    ap.add_argument("--file_type", default=None)
    ap.add_argument("--train_dir")
    ap.add_argument("--valid_dir")
    ap.add_argument("--num_files", type=int, default=None)
    ap.add_argument("--train_filename")
    ap.add_argument("--valid_filename")
    ap.add_argument("--json_array", action="store_true", help="inputs are whole JSON arrays")
    ap.add_argument("--output_path", required=True)
    ap.add_argument("--vocab_path", default=None, help="vocabulary table (token, id); built from the input if absent")
    ap.add_argument("--tokenizer_model", default=None, help="SentencePiece model file (pretrain)")
    ap.add_argument("--sources", nargs="*", default=[])
    ap.add_argument("--dedup_source", default=None)
    ap.add_argument("--placeholder_source", default=None)
    ap.add_argument("--max_length", type=int)
    ap.add_argument("--vocab_size", type=int)
    ap.add_argument("--eos_id", type=int)
    ap.add_argument("--pad_id", type=int)
    ap.add_argument("--code_language", default="Python")
    ap.add_argument("--group_rows", type=int)
    ap.add_argument("--test_fraction", type=float)
    ap.add_argument("--seed", type=int)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"packwright-{args.task}").getOrCreate()
    from packwright.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    p = _params(args)
    if args.task == "pretrain":
        pretrain(spark, args.dataset, args.train_dir, args.valid_dir, args.output_path, p, args.num_files,
                 args.file_type, args.vocab_path, args.tokenizer_model)
    elif args.task in ("sft", "dpo"):
        examples(spark, args.task, args.train_filename, args.valid_filename, args.output_path, p,
                 args.file_type or "json", args.json_array, args.vocab_path)
    else:
        combine(spark, args.sources, args.dedup_source, args.placeholder_source, args.output_path, p, args.json_array)


if __name__ == "__main__":
    main()
