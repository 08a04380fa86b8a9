"""Sequence packing: concatenate the token lists of a packing group in order, cut
fixed-length rows, drop the group's short tail, number segments.

Plan shape (default, ``group_rows`` consecutive keys per group):

* one exchange, hash-partitioned by the group columns, feeds a window that gives
  every document its running token offset inside the group;
* the chunk aggregation groups by (group columns, chunk); that clustering is already
  satisfied by the window's hash partitioning, so there is no second exchange;
* no task ever holds more than one group's documents; a group is a bounded number of
  documents, so a hot source is spread over many groups and tasks.

Corpus-wide packing (``corpus_wide=True``) cannot bound a group by rows; it uses
two-level offsets instead: token sums per (group, key range), a window over that small
table, then a window inside each range. No single task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions.arrays import segment_mask
from packwright.operators.ordering import global_index
from packwright.operators.tokens import by_key, lookup_table, pretoken_count, pretokens, with_token_ids
from packwright.params import DEFAULT, Params

CHUNK = "chunk"


def key_div(col: str, n: int) -> Column:
    """Exact integer division of a named 64-bit key column (SQL ``div``; no double
    round trip, so keys beyond 2**53 stay exact)."""
    return F.expr(f"`{col}` div {int(n)}")


def pos_div(x: Column, n: int) -> Column:
    """Floor division of a token position; positions stay far below 2**53, where the
    double division is exact."""
    return F.floor(x / F.lit(n)).cast("bigint")


def with_pack_group(df: DataFrame, group_cols: list[str], order_col: str, params: Params = DEFAULT,
                    name: str = "pack_group") -> DataFrame:
    """Packing batch number: each group's rows, in key order, in batches of ``group_rows``
    (1000 by default, as map batches are built). Independent of worker count. ``group_cols``
    and ``order_col`` together must name a row."""
    d = global_index(df, [order_col], out="__i", partition_cols=group_cols)
    return d.withColumn(name, key_div("__i", params.group_rows)).drop("__i")


def offset_buckets(keys: DataFrame, group_cols: list[str], order_col: str, out: str = "__bucket") -> DataFrame:
    """The rows dealt out to key ranges of about equal row counts (Spark samples the keys, so
    an outlying key widens no other range), fixed by a checkpoint."""
    from packwright.session import cut_lineage

    s = cut_lineage(keys.repartitionByRange(*group_cols, order_col))
    return s.withColumn(out, F.shiftright(F.monotonically_increasing_id(), 33))


def running_offsets(df: DataFrame, group_cols: list[str], order_col: str, n_col: str, corpus_wide: bool = False,
                    out: str = "start") -> DataFrame:
    """Exclusive running sum of ``n_col`` per group in ``order_col`` order.

    By default one window per group (groups must be bounded). ``corpus_wide``: the small
    (group, key, n) table is written once in key ranges; token sums per (group, range), a
    window over those sums (one row per range), a window inside each range; the offsets
    are joined back by (group, key), which must name a row. No task holds a whole group."""
    if not corpus_wide:
        w = Window.partitionBy(*group_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, (F.sum(n_col).over(w) - F.col(n_col)).cast("bigint"))
    b = "__bucket"
    d = offset_buckets(df.select(*group_cols, order_col, n_col), group_cols, order_col, b)
    sums = d.groupBy(*group_cols, b).agg(F.sum(n_col).alias("__bn"))
    wb = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)
    offs = sums.select(*group_cols, b, (F.sum("__bn").over(wb) - F.col("__bn")).alias("__boff"))
    wi = Window.partitionBy(*group_cols, b).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    starts = d.join(offs, on=[*group_cols, b]).select(
        *group_cols, order_col, (F.col("__boff") + F.sum(n_col).over(wi) - F.col(n_col)).cast("bigint").alias(out))
    return df.join(starts, on=[*group_cols, order_col])


def _finish(rows: DataFrame, params: Params, ids: str = "input_ids") -> DataFrame:
    rows = rows.filter(F.size(ids) == params.max_length)
    return rows.withColumn("attention_mask", segment_mask(ids, params.eos_id))


def pack_text(df: DataFrame, text_col: str, group_cols: list[str], order_col: str, vocab: DataFrame,
              params: Params = DEFAULT, corpus_wide: bool = False, counted: str | None = None) -> DataFrame:
    """Encode + pack in one pass on the JVM. ``counted``: a column with the texts' pre-token counts.

    The only shuffle moves each document once, as raw text and token count. After it each row's
    pre-tokens are looked up in place in the broadcast vocabulary, and slices of at most
    ``max_length`` ids go to their chunks: what is sorted is texts and slices, never tokens."""
    if corpus_wide:
        return _pack_text_two_level(df, text_col, group_cols, order_col, vocab, params)
    n = F.col(counted) if counted else pretoken_count(text_col)
    d = df.select(*group_cols, order_col, F.col(text_col).alias("__text"), n.alias("__n"))
    d = running_offsets(d, group_cols, order_col, "__n", out="__start").select(*group_cols, "__start", "__text")
    d = with_token_ids(d, "__text", vocab, params, "__ids")
    return _assemble(d, group_cols, "__ids", "__start", params)


MOST_PARTS = 10_000  # of :func:`pack_text_in_batches`: borders that meet on the driver
MOST_GROUPS = 10_000  # values of the group columns whose borders are broadcast


def _borders(keys: DataFrame, group_cols: list[str], order_col: str, params: Params) -> DataFrame | None:
    """group_cols, base (borders of smaller groups), keys and at (the group's borders: order key of the
    row, and its place in the group), one row a group; a border is the first row of a packing batch.
    None if there are more than MOST_GROUPS groups. What is sorted is keys only."""
    from packwright.session import cut_lineage

    spark = keys.sparkSession
    indexed = global_index(keys.select(*group_cols, order_col), [order_col], out="__i", partition_cols=group_cols)
    starts = cut_lineage(indexed.filter(F.col("__i") % params.group_rows == 0))
    groups = starts.filter("__i = 0").select(*group_cols)
    if groups.count() > MOST_GROUPS:
        return None
    parts = min(MOST_PARTS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = max(1, -(-starts.count() // parts))
    numbered = global_index(starts, [*group_cols, order_col], out="__no")
    some = F.col("__no") % every == 0
    of = numbered.groupBy(*group_cols).agg(
        F.sort_array(F.collect_list(F.when(some, F.struct(F.col(order_col).alias("k"), F.col("__i").alias("i"))))).alias("__b"))
    w = Window.orderBy(*group_cols).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    return cut_lineage(of.select(*group_cols, F.coalesce(F.sum(F.size("__b")).over(w), F.lit(0)).cast("int").alias("__base"),
                                 F.transform("__b", lambda b: b["k"]).alias("__keys"), F.transform("__b", lambda b: b["i"]).alias("__at")))


def _below(keys: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``keys`` (up to ``most``) are at or below ``value``: halving."""
    steps = max(1, int(most).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi"))  # keys before lo are, from hi on are not

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        return F.when(acc["lo"] < acc["hi"], F.when(F.get(keys, mid) <= value, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                      .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))).otherwise(acc)

    return F.aggregate(F.array_repeat(F.lit(0), steps), start, halve, lambda acc: acc["lo"])


def pack_text_in_batches(df: DataFrame, text_col: str, group_cols: list[str], order_col: str, vocab: DataFrame,
                         params: Params = DEFAULT, name: str = "pack_group") -> DataFrame:
    """Encode + pack by batches of ``group_rows`` rows of each group in key order (as
    :func:`with_pack_group` numbers them), with one exchange of the texts.

    Tasks are ranges of whole batches in (group, key) order. Their borders come from a sort of the
    keys alone; each row finds its range among its group's borders (broadcast, at most MOST_PARTS
    of them), goes there, and gets its batch and offset from its place in the range. The windows
    and the chunk aggregation keep that partitioning."""
    keyed = df.select(*group_cols, order_col)
    borders = _borders(keyed, group_cols, order_col, params)
    if borders is None:
        docs = with_pack_group(df.select(*group_cols, order_col, text_col), group_cols, order_col, params, name)
        return pack_text(docs, text_col, [*group_cols, name], order_col, vocab, params)
    size = borders.agg(F.max(F.size("__keys")), F.sum(F.size("__keys"))).first()
    most, parts = size[0] or 1, size[1] or 1
    b = borders.withColumnsRenamed({c: f"__b_{c}" for c in group_cols})
    same = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in group_cols]
    d = df.select(*group_cols, order_col, F.col(text_col).alias("__text"), pretoken_count(text_col).alias("__n"))
    on = same[0]
    for x in same[1:]:
        on = on & x
    d = d.join(F.broadcast(b), on).withColumn("__below", _below(F.col("__keys"), F.col(order_col), most))
    d = d.select(*group_cols, order_col, "__text", "__n", (F.col("__base") + F.col("__below") - 1).cast("int").alias("__part"),
                 F.when(F.col("__below") > 0, F.get("__at", F.col("__below") - 1)).otherwise(0).alias("__first"))
    d = d.repartitionById(parts, "__part")
    place = F.row_number().over(Window.partitionBy("__part", *group_cols).orderBy(order_col))
    d = d.withColumn("__i", F.col("__first") + place - 1).withColumn(name, key_div("__i", params.group_rows)).drop("__i", "__first")
    return pack_text(d, "__text", ["__part", *group_cols, name], order_col, vocab, params, counted="__n").drop("__part")


def _pack_text_two_level(df: DataFrame, text_col: str, group_cols: list[str], order_col: str, vocab: DataFrame,
                         params: Params) -> DataFrame:
    """Corpus-wide packing. The join of the offsets clusters rows by (group, document), which
    the gather of each document's ids uses too; only L-sized id slices are shuffled to assemble
    the chunks."""
    from packwright.session import cut_lineage

    table = lookup_table(vocab, "token", "id", params)
    # written first: to sample the ranges and to deal the rows out to them reads the counts twice
    counted = cut_lineage(df.select(*group_cols, order_col, pretoken_count(text_col).alias("__n")))
    starts = running_offsets(counted, group_cols, order_col, "__n", corpus_wide=True, out="__start").drop("__n")
    d = df.select(*group_cols, order_col, F.col(text_col).alias("__text")).join(starts, on=[*group_cols, order_col])
    docs = by_key(d, [*group_cols, order_col, "__start"], "__text", table, pretokens, params.unk_id, params)
    return _assemble(docs.withColumnRenamed("__list", "__ids"), group_cols, "__ids", "__start", params)


def _assemble(d: DataFrame, group_cols: list[str], ids: str, start: str, params: Params) -> DataFrame:
    """Per document (ids, start) -> L-sized slices -> rows of L tokens per chunk. A slice is cut from
    the ids after the chunks are told apart, so a long document is not walked once a chunk."""
    L = params.max_length
    n = F.size(ids)
    chunks = F.when(n > 0, F.sequence(pos_div(F.col(start), L), pos_div(F.col(start) + n - F.lit(1), L)))
    s = d.select(*group_cols, F.col(start).alias("__start"), F.col(ids).alias("__ids"), F.explode(chunks).alias(CHUNK))
    lo = F.greatest(F.col(CHUNK) * L - F.col("__start"), F.lit(0))
    hi = F.least((F.col(CHUNK) + 1) * L - F.col("__start"), F.size("__ids"))
    s = s.select(*group_cols, CHUNK, (F.col("__start") + lo).cast("bigint").alias("__g"),
                 F.slice("__ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("__ids_of"))
    rows = s.groupBy(*group_cols, CHUNK).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__g", "__ids_of"))), lambda x: x["__ids_of"])).alias("input_ids"))
    return _finish(rows, params)


def pack_ids(df: DataFrame, ids_col: str, group_cols: list[str], order_col: str, params: Params = DEFAULT,
             corpus_wide: bool = False) -> DataFrame:
    """Pack rows that already carry id arrays: only L-sized slices reach the chunk
    aggregation, each chunk gathers at most L tokens (bounded memory)."""
    L = params.max_length
    d = df.select(*group_cols, order_col, F.col(ids_col).alias("__ids")).withColumn("__n", F.size("__ids"))
    d = running_offsets(d, group_cols, order_col, "__n", corpus_wide, out="__start")
    return _assemble(d, group_cols, "__ids", "__start", params)


N_TOKENS = "__n_tokens"


def token_counts(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the number of pre-tokens of each text: what goes on to be ordered, grouped and
    counted is a few bytes a row."""
    return df.select(*keep, pretoken_count(text_col).alias(N_TOKENS))


def packed_counts(counts: DataFrame, group_cols: list[str], params: Params = DEFAULT) -> DataFrame:
    """Rows and tokens that packing will produce, without packing, from :func:`token_counts`: a
    group of n tokens yields exactly n div L rows of L tokens (the tail is dropped). An
    aggregation (map-side combined), no exchange of texts or token data."""
    L = params.max_length
    g = counts.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(N_TOKENS).cast("bigint").alias("n_tokens"))
    return g.withColumn("n_rows", F.expr(f"n_tokens div {L}")).withColumn(
        "packed_tokens", F.col("n_rows") * F.lit(L)).withColumn("dropped_tokens", F.expr(f"n_tokens % {L}"))
