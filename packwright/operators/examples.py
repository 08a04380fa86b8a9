"""Chat template, supervised and preference example builders.

Text is laid out as an ordered list of blocks ``(text, trained)``; every block is
pre-tokenized on its own (tokens never merge across blocks), ids come from the
broadcast vocabulary, and one gather per example rebuilds ids and loss labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.arrays import ones_like, right_pad
from packwright.functions.text import prompt_text
from packwright.operators.tokens import lookup_ids, pretoken_count, pretokens
from packwright.params import BOS_TOKEN, DEFAULT, EOS_TOKEN, ROLE_ASSISTANT, ROLE_SYSTEM, ROLE_USER, Params

BLOCK = "struct<text:string,trained:boolean,side:int>"


def system_block(params: Params = DEFAULT) -> str:
    return f"{BOS_TOKEN}{ROLE_SYSTEM}\n{params.system_prompt}{EOS_TOKEN}"


def user_block(text: Column) -> Column:
    return F.concat(F.lit(f"\n{BOS_TOKEN}{ROLE_USER}\n"), text, F.lit(f"{EOS_TOKEN}\n{BOS_TOKEN}{ROLE_ASSISTANT}\n"))


def _blk(text: Column, trained: bool, side: int = 0) -> Column:
    return F.struct(text.alias("text"), F.lit(trained).alias("trained"), F.lit(side).alias("side"))


def chat_blocks(params: Params = DEFAULT, history: str = "history", query: Column | None = None,
                reply: str = "output") -> Column:
    """System block before the first user block only; each history pair is
    (user block, reply + eos); then the query's user block and the reply."""
    sys_ = F.lit(system_block(params))
    h = F.coalesce(F.col(history), F.array().cast("array<array<string>>"))
    pairs = F.flatten(
        F.transform(
            h,
            lambda p, i: F.array(
                _blk(F.concat(F.when(i == 0, sys_).otherwise(F.lit("")), user_block(F.get(p, 0))), False),
                _blk(F.concat(F.get(p, 1), F.lit(EOS_TOKEN)), True),
            ),
        )
    )
    q = query if query is not None else prompt_text("instruction", "input")
    query_blk = _blk(F.concat(F.when(F.size(h) == 0, sys_).otherwise(F.lit("")), user_block(q)), False)
    return F.concat(pairs, F.array(query_blk, _blk(F.col(reply), True)))


def encode_blocks(df: DataFrame, key: list[str], blocks: str, vocab: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(key..., blocks) -> (key..., toks: array<struct<b,pos,id,trained,side>>) in order."""
    b = df.select(*key, F.posexplode_outer(blocks).alias("__b", "__blk"))
    t = b.select(*key, "__b", F.col("__blk.trained").alias("trained"), F.col("__blk.side").alias("side"),
                 F.posexplode_outer(pretokens(F.col("__blk.text"))).alias("__pos", "__tok"))
    t = lookup_ids(t, vocab, params, token="__tok")
    # rows without any token stay, with an empty list
    placed = F.when(F.col("__pos").isNotNull(), F.struct("__b", "__pos", "id", "trained", "side"))
    return t.groupBy(*key).agg(F.sort_array(F.collect_list(placed)).alias("toks"))


def sft_examples(df: DataFrame, key: list[str], vocab: DataFrame, params: Params = DEFAULT,
                 keep_overlength: bool = False) -> DataFrame:
    """ids = all block ids + eos; labels = ignore on prompt blocks, ids on replies;
    examples with ``len >= max_length`` are dropped, the rest right-padded."""
    d = df.select(*key, chat_blocks(params).alias("__blocks"))
    e = encode_blocks(d, key, "__blocks", vocab, params)
    eos = F.array(F.lit(params.eos_id))
    ids = F.concat(F.transform("toks", lambda t: t["id"]), eos)
    labels = F.concat(
        F.transform("toks", lambda t: F.when(t["trained"], t["id"]).otherwise(F.lit(params.ignore_index))), eos
    )
    e = e.select(*key, ids.alias("ids"), labels.alias("labels")).withColumn("n_tokens", F.size("ids"))
    if keep_overlength:
        return e
    return pad_example(e.filter(F.col("n_tokens") < params.max_length), params)


def pad_example(df: DataFrame, params: Params = DEFAULT, ids: str = "ids", labels: str = "labels",
                prefix: str = "") -> DataFrame:
    L = params.max_length
    return (
        df.withColumn(f"{prefix}attention_mask", right_pad(ones_like(ids), L, 0))
        .withColumn(f"{prefix}labels" if prefix else "labels", right_pad(labels, L, params.ignore_index))
        .withColumn(f"{prefix}ids" if prefix else "input_ids", right_pad(ids, L, params.pad_id))
    )


def dpo_examples(df: DataFrame, key: list[str], vocab: DataFrame, params: Params = DEFAULT,
                 keep_overlength: bool = False) -> DataFrame:
    """Prompt (system + query block, no history) is encoded once and shared by the
    chosen and rejected sides; a pair is kept only if both sides are < max_length."""
    q = F.concat(F.lit(system_block(params)), user_block(prompt_text("instruction", "input")))
    blocks = F.array(_blk(q, False, 0), _blk(F.get(F.col("output"), 0), True, 1),
                     _blk(F.get(F.col("output"), 1), True, 2))
    d = df.filter(F.size("output") == 2).select(*key, blocks.alias("__blocks"))
    e = encode_blocks(d, key, "__blocks", vocab, params)
    eos = F.array(F.lit(params.eos_id))
    ign = params.ignore_index

    def side(s: int):
        return F.filter("toks", lambda t: t["side"] == s)

    prompt = F.transform(side(0), lambda t: t["id"])
    out = e.select(*key, prompt.alias("__p"), F.transform(side(1), lambda t: t["id"]).alias("__c"),
                   F.transform(side(2), lambda t: t["id"]).alias("__r"))
    out = out.select(
        *key,
        F.concat("__p", "__c", eos).alias("chosen_ids"),
        F.concat(F.array_repeat(F.lit(ign), F.size("__p")), "__c", eos).alias("chosen_labels"),
        F.concat("__p", "__r", eos).alias("rejected_ids"),
        F.concat(F.array_repeat(F.lit(ign), F.size("__p")), "__r", eos).alias("rejected_labels"),
    )
    if keep_overlength:
        return out
    L = params.max_length
    out = out.filter((F.size("chosen_ids") < L) & (F.size("rejected_ids") < L))
    return out.select(
        *key,
        right_pad("chosen_ids", L, params.pad_id).alias("chosen_ids"),
        right_pad(ones_like("chosen_ids"), L, 0).alias("chosen_attention_mask"),
        right_pad("chosen_labels", L, ign).alias("chosen_labels"),
        right_pad("rejected_ids", L, params.pad_id).alias("rejected_ids"),
        right_pad(ones_like("rejected_ids"), L, 0).alias("rejected_attention_mask"),
        right_pad("rejected_labels", L, ign).alias("rejected_labels"),
    )


def block_tokens(blocks: Column, keep=None) -> Column:
    """Tokens of all blocks (of those that ``keep`` admits), counted without encoding."""
    chosen = F.filter(blocks, keep) if keep else blocks
    return F.aggregate(chosen, F.lit(0), lambda n, b: n + F.coalesce(pretoken_count(b["text"]), F.lit(0)))


def sft_lengths(df: DataFrame, key: list[str], params: Params = DEFAULT) -> DataFrame:
    """key, n_tokens (with the end), n_trained (labels that count: replies and the end), as
    :func:`sft_examples` would give them."""
    d = df.select(*key, chat_blocks(params).alias("__b"))
    return d.select(*key, (block_tokens(F.col("__b")) + 1).alias("n_tokens"),
                    (block_tokens(F.col("__b"), lambda b: b["trained"]) + 1).alias("n_trained"))


def dpo_lengths(df: DataFrame, key: list[str], params: Params = DEFAULT) -> DataFrame:
    """key, n_chosen, n_rejected of the pairs that :func:`dpo_examples` encodes."""
    prompt = pretoken_count(F.concat(F.lit(system_block(params)), user_block(prompt_text("instruction", "input"))))
    side = lambda i: F.coalesce(pretoken_count(F.get(F.col("output"), i)), F.lit(0))
    prompt = F.coalesce(prompt, F.lit(0))
    return df.filter(F.size("output") == 2).select(*key, (prompt + side(0) + 1).alias("n_chosen"),
                                                   (prompt + side(1) + 1).alias("n_rejected"))


def overlength_report(sft: DataFrame, dpo: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Dropped examples by kind, from :func:`sft_lengths` and :func:`dpo_lengths`: SFT by full
    length; preference pairs report the chosen side first and the rejected side only when the
    chosen side fits."""
    L = params.max_length
    s = sft.filter(F.col("n_tokens") >= L).select(F.lit("sft").alias("kind"), F.col("n_tokens").alias("length"))
    c, r = F.col("n_chosen"), F.col("n_rejected")
    p = dpo.filter((c >= L) | (r >= L)).select(
        F.when(c >= L, F.lit("chosen")).otherwise(F.lit("rejected")).alias("kind"),
        F.when(c >= L, c).otherwise(r).alias("length"),
    )
    return s.unionByName(p).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_dropped"), F.max("length").cast("bigint").alias("max_length")
    )


def validate_preferences(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) by output arity 2; strict mode fails the job instead."""
    if strict:
        # assert_true yields NULL when the check passes; a filter keeps it evaluated.
        checked = df.filter(F.assert_true(F.size("output") == 2, "preference output must hold 2 items").isNull())
        return checked, df.limit(0)
    return df.filter(F.size("output") == 2), df.filter(F.size("output") != 2)


def preference_status(df: DataFrame, out: str = "status") -> DataFrame:
    """Both in one pass: every row with its status."""
    return df.withColumn(out, F.when(F.size("output") == 2, "valid").otherwise("quarantined"))
