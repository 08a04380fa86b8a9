"""Encoder, vocabulary and decoder.

The default encoder is set-based: pre-tokens come from one regular expression
(special tokens first), ids from a corpus-built vocabulary that is broadcast. The
vocabulary is bounded by ``vocab_size`` rows, which is what makes broadcasting it
safe at any data size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions.arrays import _let as let
from packwright.params import (
    BOS_ID,
    BOS_TOKEN,
    DEFAULT,
    EOS_ID,
    EOS_TOKEN,
    PRETOKEN_PATTERN,
    SPECIAL_TOKENS,
    UNK_ID,
    UNK_TOKEN,
    Params,
)

SPECIAL_IDS = ((UNK_TOKEN, UNK_ID), (BOS_TOKEN, BOS_ID), (EOS_TOKEN, EOS_ID))

# PRETOKEN_PATTERN as Java's matcher runs it fastest: no special token starts with a letter, so letter
# runs are tried first, and any code point left is a token of its own.
_SPECIAL = r"<(?:\|startoftext\|>|\|endoftext\|>|unk>)"
JVM_PATTERN = rf"\p{{L}}+|{_SPECIAL}|(?s:.)"
LONG_TOKEN = rf"\p{{L}}{{2,}}|{_SPECIAL}"  # the tokens of more than one code point


def pretokens(text) -> Column:
    """Split text into pre-tokens; special tokens stay single units."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(JVM_PATTERN), 0)


def pretoken_count(text) -> Column:
    """Number of pre-tokens, counted without materialising them: code points once each longer token is one."""
    t = F.col(text) if isinstance(text, str) else text
    return F.length(F.regexp_replace(t, F.lit(LONG_TOKEN), F.lit("a"))).cast("int")


def build_vocab(df: DataFrame, text_col: str = "text", params: Params = DEFAULT) -> DataFrame:
    """Corpus vocabulary: token counts (map-side combined), the ``vocab_size - 3`` most
    frequent tokens ranked by (count desc, token asc) get ids 3.., specials get 0..2.

    The counts table (one row per distinct token) is written once to the shared
    checkpoint folder. A histogram of count values (one row per distinct count) gives
    the k-th largest count c*; only tokens with count >= c* enter the final top-k, so
    its single merge task receives about k rows instead of k rows per partition. The
    numbering window runs over those k rows only."""
    from packwright.session import cut_lineage

    specials = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
    counts = cut_lineage(
        df.select(F.explode(pretokens(text_col)).alias("token"))
        .filter(~F.array_contains(specials, F.col("token")))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    k = params.vocab_size - len(SPECIAL_IDS)
    hist = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("m"))
    running = hist.withColumn("at_least", F.sum("m").over(
        Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)))
    cut = running.filter(F.col("at_least") >= k).agg(F.max("cnt")).first()[0]  # one number
    cand = counts if cut is None else counts.filter(F.col("cnt") >= cut)
    top = cand.orderBy(F.desc("cnt"), F.asc("token")).limit(k)
    ranked = top.select(
        "token",
        (F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("token"))) + F.lit(len(SPECIAL_IDS) - 1))
        .cast("int")
        .alias("id"),
        "cnt",
    )
    spark = df.sparkSession
    sp = spark.createDataFrame(list(SPECIAL_IDS), "token string, id int").withColumn("cnt", F.lit(0).cast("bigint"))
    return sp.unionByName(ranked)


def bounded_broadcast(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Broadcast side made from the vocabulary, at most ``vocab_size`` rows by construction.
    Every lookup takes this one plan; a vocabulary beyond ``broadcast_limit_rows`` is an error."""
    if params.vocab_size > params.broadcast_limit_rows:
        raise ValueError(f"vocab_size {params.vocab_size} is above broadcast_limit_rows {params.broadcast_limit_rows}")
    return F.broadcast(df)


def vocab_for_join(vocab: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return bounded_broadcast(vocab.select("token", "id"), params)


def explode_tokens(df: DataFrame, text_col: str, keep: list[str], pos: str = "pos", token: str = "token") -> DataFrame:
    """One row per pre-token with its 0-based position; narrow (no shuffle)."""
    return df.select(*keep, F.posexplode(pretokens(text_col)).alias(pos, token))


def lookup_ids(tokens: DataFrame, vocab: DataFrame, params: Params = DEFAULT, token: str = "token") -> DataFrame:
    """token -> id via broadcast hash join, unknown tokens -> unk id."""
    v = vocab_for_join(vocab, params).withColumnRenamed("token", "__vtok")
    out = tokens.join(v, tokens[token] == F.col("__vtok"), "left")
    return out.withColumn("id", F.coalesce(F.col("id"), F.lit(params.unk_id)).cast("int")).drop("__vtok")


def lookup_table(pairs: DataFrame, key: str, value: str, params: Params = DEFAULT) -> Column:
    """The vocabulary as one value that rows look up in place (see :func:`looked_up`): an array of
    small maps, each with the keys of one hash value. A scalar subquery, so it is made once a query
    and sent to the tasks, at most ``vocab_size`` entries as for a broadcast join."""
    n = _slots(params)
    entries = pairs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    filled = entries.groupBy(_slot(F.col("k"), n).alias("slot")).agg(F.collect_list(F.struct("k", "v")).alias("of"))
    slots = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("slot"))
    table = slots.join(bounded_broadcast(filled, params), "slot", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "of"))), lambda s: F.map_from_entries(s["of"])).alias("t"))
    return table.scalar()


def _slots(params: Params) -> int:
    return 1 << int(params.vocab_size).bit_length()


def _slot(key: Column, n: int) -> Column:
    return F.hash(key).bitwiseAND(F.lit(n - 1))


def looked_up(df: DataFrame, table: Column, out: str, of, dense: Column | None = None) -> DataFrame:
    """``df`` with ``out``, which ``of`` makes with a function that replaces a list's entries by what
    ``table`` (of :func:`lookup_table`) holds for them, else by a default, within the row: no row per
    token is made, joined or gathered. The table is a column of its own only until the optimizer
    merges the two steps (a subquery may not stand in a higher-order function as written).
    ``dense`` (of :func:`token_list`) is asked first: a place in an array, where the table is searched."""
    def body(first):
        return let(F.col("__table"), lambda t: of(lambda keys, default, n: F.transform(
            keys, lambda k: F.coalesce(*first(k), F.get(t, _slot(k, n))[k], F.lit(default)))))

    d = df.withColumn("__table", table)
    if dense is None:
        return d.select(*df.columns, body(lambda k: []).alias(out))
    return d.withColumn("__dense", dense).select(
        *df.columns, let(F.col("__dense"), lambda a: body(lambda k: [F.get(a, k)])).alias(out))


def token_list(pairs: DataFrame, params: Params = DEFAULT) -> Column:
    """The tokens of ids 0 to ``vocab_size`` and a little more, each at its id's place in one array (null
    for ids without a token): a scalar subquery, as :func:`lookup_table`."""
    n = _slots(params)
    entries = pairs.filter((F.col("id") >= 0) & (F.col("id") < n)).groupBy(F.col("id").cast("int").alias("id")).agg(F.min("token").alias("token"))
    ids = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("id"))
    return ids.join(bounded_broadcast(entries, params), "id", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "token"))), lambda s: s["token"]).alias("t")).scalar()


def with_token_ids(df: DataFrame, text_col: str, vocab: DataFrame, params: Params = DEFAULT, out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text's pre-tokens; a null text has null."""
    table = lookup_table(vocab, "token", "id", params)
    return looked_up(df, table, out, lambda found: found(pretokens(text_col), params.unk_id, _slots(params)))


def by_key(df: DataFrame, key: list[str], col: str, table: Column, split, default, params: Params = DEFAULT,
           lookup=None) -> DataFrame:
    """key, __null, __list: what ``table`` holds for the list that ``split`` makes of ``col``, one row
    per key. ``lookup`` (as :func:`looked_up`) adds a list's values in another way. Rows are gathered before they are split, within the clustering of ``df``. Where rows
    share a key, their entries come in order of (place, entry)."""
    g = df.groupBy(*key, F.col(col).isNull().alias("__null")).agg(F.collect_list(col).alias("__rows"))
    g = (lookup or looked_up)(g, table, "__lists", lambda found: F.transform("__rows", lambda c: found(split(c), default, _slots(params))))
    placed = F.sort_array(F.flatten(F.transform("__lists", lambda a: F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))))))
    merged = F.when(F.size("__lists") == 1, F.get("__lists", 0)).otherwise(F.transform(placed, lambda s: s["x"]))
    return g.select(*key, "__null", merged.alias("__list"))


def encode(df: DataFrame, text_col: str, key: list[str], vocab: DataFrame, params: Params = DEFAULT,
           out: str = "ids") -> DataFrame:
    """Per-row id arrays, looked up in place.

    Rows without pre-tokens stay: an empty text has an empty list, a null text a null.
    The only exchange moves each text once, to its row key (which must name a row); what is
    gathered there is one text a row."""
    table = lookup_table(vocab, "token", "id", params)
    e = by_key(df.select(*key, text_col).repartition(*key), key, text_col, table, pretokens, params.unk_id, params)
    return e.select(*key, F.when(~F.col("__null"), F.col("__list")).alias(out))


_BROADCASTS: dict = {}


def encode_with_arrow(df: DataFrame, text_col: str, vocab: DataFrame, params: Params = DEFAULT,
                      out: str = "ids") -> DataFrame:
    """Same ids as :func:`encode`, computed per Arrow batch in Python without a
    shuffle. The vocabulary (<= ``vocab_size`` rows) is shipped once as a broadcast
    variable. This is the form an external tokenizer plugs into."""
    from pyspark.sql.functions import pandas_udf

    sc = df.sparkSession.sparkContext
    files = tuple(sorted(vocab.inputFiles()))  # a saved vocabulary table is shipped once
    key = (sc.applicationId, files) if files else None
    bvocab = _BROADCASTS.get(key) if key else None
    if bvocab is None:
        rows = vocab.select("token", "id").collect()  # bounded by params.vocab_size
        bvocab = sc.broadcast({r["token"]: r["id"] for r in rows})
        if key:
            _BROADCASTS[key] = bvocab
    unk = params.unk_id
    pattern = PRETOKEN_PATTERN

    @pandas_udf("array<int>")
    def _enc(texts: pd.Series) -> pd.Series:
        import numpy as np
        import regex  # the module caches compiled patterns per worker

        findall = regex.compile(pattern).findall
        get = bvocab.value.get
        return pd.Series([None if t is None else np.fromiter((get(p, unk) for p in findall(t)), np.int32) for t in texts], dtype=object)

    return df.withColumn(out, _enc(F.col(text_col)))


def encode_with_sentencepiece(df: DataFrame, text_col: str, model_path: str, specials: dict[str, int] | None = None,
                              out: str = "ids") -> DataFrame:
    """External-model provider: the SentencePiece model file (one small file, read
    through Spark's ``binaryFile`` source so any filesystem works) travels as a
    broadcast variable and is loaded once per Python worker; special tokens are split
    out first and kept as single ids (special tokens are never added automatically)."""
    import re

    from pyspark.sql.functions import pandas_udf

    spark = df.sparkSession
    blob = spark.read.format("binaryFile").load(model_path).select("content").first()["content"]  # one file
    model = spark.sparkContext.broadcast(bytes(blob))
    specials = dict(specials or {})
    split_rx = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    @pandas_udf("array<int>")
    def _enc(batches: "Iterator[pd.Series]") -> "Iterator[pd.Series]":
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_proto=model.value)
        for texts in batches:
            rows = []
            for t in texts:
                if t is None:
                    rows.append(None)
                    continue
                parts = split_rx.split(t) if split_rx else [t]
                ids: list[int] = []
                for part in parts:
                    if not part:
                        continue
                    if part in specials:
                        ids.append(specials[part])
                    else:
                        ids.extend(sp.encode(part))
                rows.append(ids)
            yield pd.Series(rows)

    return df.withColumn(out, _enc(F.col(text_col)))


def decode_tokens(df: DataFrame, ids_col: str, key: list[str], vocab: DataFrame, params: Params = DEFAULT,
                  out: str = "tokens") -> DataFrame:
    """Ids back to tokens, one list per row, looked up in place after the one exchange of the id
    lists by the row key (which must name a row). An id outside the vocabulary, negative ids such as
    ignored labels included, is the unknown token; null ids decode to null, an empty list to an
    empty one."""
    pairs = vocab.select("id", "token")
    lookup = None
    if dict(df.dtypes)[ids_col] == "array<int>":  # a place in an array is an int
        dense, pairs = token_list(pairs, params), pairs.filter((F.col("id") < 0) | (F.col("id") >= _slots(params)))
        lookup = lambda g, table, out, of: looked_up(g, table, out, of, dense)
    table = lookup_table(pairs, "id", "token", params)
    d = by_key(df.select(*key, ids_col).repartition(*key), key, ids_col, table, lambda x: x, UNK_TOKEN, params, lookup)
    return d.select(*key, F.when(~F.col("__null"), F.col("__list")).alias(out))


def tokens_to_string(tokens) -> Column:
    """Join decoded tokens; a space goes before a special token unless it is first or
    the previous token was special too."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(
        F.transform(
            t,
            lambda tok, i: F.when(
                tok.isin(*SPECIAL_TOKENS) & (i > 0) & ~F.get(t, i - 1).isin(*SPECIAL_TOKENS),
                F.concat(F.lit(" "), tok),
            ).otherwise(tok),
        ),
        "",
    )


def strip_specials(tokens) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(t, lambda x: ~x.isin(*SPECIAL_TOKENS))
