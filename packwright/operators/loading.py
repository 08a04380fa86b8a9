"""Training-side data layout: union of prepared corpora, seeded epoch order, rank
shards, fixed-size batches, collation, preference stacking, step plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.arrays import ones_like, right_pad
from packwright.operators.ordering import permutation_keys, permuted, seeded_order
from packwright.params import DEFAULT, Params


def union_corpora(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union of prepared corpora; every row keeps its corpus name."""
    out = None
    for name, f in frames.items():
        f = f.withColumn("corpus", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


def epoch_order(df: DataFrame, key: str, params: Params = DEFAULT, epochs: int | None = None) -> DataFrame:
    """Random order per epoch (seeded md5 of seed:epoch:key), exact positions; the
    epoch copies come from a generator, not a join."""
    e = params.epochs if epochs is None else epochs
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(e - 1))))
    return seeded_order(d, key, params.seed, F.col("epoch"), out="position", partition_cols=["epoch"])


def rank_shards(df: DataFrame, key: str, params: Params = DEFAULT, epoch: int = 0) -> DataFrame:
    """Distributed-sampler layout: seeded order, padded to a multiple of the world size
    by repeating rows from the start as often as needed (more than once if there are fewer
    rows than ranks), position p goes to rank p % world."""
    w = params.world_size
    d = seeded_order(df, key, params.seed, F.lit(epoch), out="__p", total="__n")
    last = F.ceil(F.col("__n") / F.lit(w)) * w - 1
    # row p stands at p, p + n, p + 2n, ...; a generator, so the input is computed once
    both = d.withColumn("__p", F.explode(F.sequence(F.col("__p"), last.cast("bigint"), F.col("__n"))))
    return both.withColumn("rank", (F.col("__p") % w).cast("int")).withColumn(
        "position", F.expr(f"__p div {w}")).drop("__p", "__n")


def write_rank_shards(ranked: DataFrame, path: str) -> str:
    """Rows of :func:`rank_shards` as one set of sorted files for each rank. Ranges of (rank,
    position), so a rank is written by as many tasks as its share asks for, and its files follow
    one another."""
    ranked.repartitionByRange("rank", "position").sortWithinPartitions("rank", "position").write.partitionBy("rank").parquet(path)
    return path


def read_rank(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """One rank's rows; the other ranks' files are not opened. Rows within a file are in order of
    ``position``."""
    return spark.read.parquet(path).filter(F.col("rank") == rank)


def permuted_epochs(df: DataFrame, index: str, n: int, params: Params = DEFAULT, epochs: int | None = None) -> DataFrame:
    """A row for each epoch with its ``position`` in it, by arithmetic on the row's number
    ``index`` (0 to n - 1): no epoch is sorted, and any epoch can be had by itself."""
    e = params.epochs if epochs is None else epochs
    places = F.array(*[F.struct(F.lit(k).alias("epoch"), permuted(F.col(index), n, permutation_keys(params.seed, k)).alias("position"))
                       for k in range(e)])
    return df.withColumn("__e", F.explode(places)).select(*df.columns, "__e.*")


def fixed_batches(df: DataFrame, idx: str, batch_size: int) -> DataFrame:
    """Batch number = position div batch size; the last batch may be short."""
    return df.withColumn("batch", F.expr(f"{idx} div {batch_size}"))


def collate(df: DataFrame, group_cols: list[str], pos: str, cols: list[str], out_prefix: str = "") -> DataFrame:
    """Rows -> one matrix per batch, rows in position order (a batch is bounded by the
    batch size, so the gather is bounded too)."""
    s = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("__pos"), *[F.col(c) for c in cols])))
    g = df.groupBy(*group_cols).agg(s.alias("__rows"))
    return g.select(*group_cols, F.size("__rows").alias("n_rows"),
                    *[F.transform("__rows", _field(c)).alias(out_prefix + c) for c in cols])


def _field(name: str):
    return lambda r: r[name]


#: Columns of a batch by task.
LM_COLUMNS = ["input_ids", "attention_mask"]
SFT_COLUMNS = ["input_ids", "attention_mask", "labels"]
PREFERENCE_COLUMNS = [f"{side}_{c}" for side in ("chosen", "rejected") for c in ("ids", "attention_mask", "labels")]


def pad_batch(batch: DataFrame, params: Params = DEFAULT, ids: str = "ids", labels: str = "labels", prefix: str = "") -> DataFrame:
    """Matrices of a batch whose rows were gathered without padding: ids, masks and labels of
    ``max_length`` columns. Padding comes last, so no exchange carries it."""
    L = params.max_length
    rows = lambda c, fn: F.transform(F.col(c), fn)
    return batch.select(
        *[c for c in batch.columns if c not in (ids, labels)],
        rows(ids, lambda x: right_pad(x, L, params.pad_id)).alias(f"{prefix}ids" if prefix else "input_ids"),
        rows(ids, lambda x: right_pad(ones_like(x), L, 0)).alias(f"{prefix}attention_mask"),
        rows(labels, lambda x: right_pad(x, L, params.ignore_index)).alias(f"{prefix}labels"))


def stack_preference(batch: DataFrame) -> DataFrame:
    """Preference batch: chosen rows stacked above rejected rows, for ids, masks and labels."""
    for out, c in (("input_ids", "ids"), ("attention_mask", "attention_mask"), ("labels", "labels")):
        batch = batch.withColumn(out, F.concat(F.col(f"chosen_{c}"), F.col(f"rejected_{c}")))
    return batch.drop(*PREFERENCE_COLUMNS)


def matrix_str(m) -> Column:
    c = F.col(m) if isinstance(m, str) else m
    return F.array_join(F.transform(c, lambda r: F.array_join(r, " ")), ";")


def step_plan(counts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per task: rows per rank, batches per epoch, total steps, warm-up steps, and the
    global batch (batch x accumulation x ranks)."""
    w, b = params.world_size, params.batch_size
    per_rank = F.ceil(F.col("n_rows") / F.lit(w))
    batches = F.ceil(per_rank / F.lit(b))
    total = batches * F.lit(params.epochs)
    return counts.select(
        "task",
        "n_rows",
        per_rank.cast("bigint").alias("rows_per_rank"),
        batches.cast("bigint").alias("batches_per_epoch"),
        total.cast("bigint").alias("total_steps"),
        F.round(total * F.lit(params.warmup_fraction), 6).alias("warmup_steps"),
        F.lit(b * params.grad_accumulation * w).cast("bigint").alias("global_batch"),
    )
