"""Loading-side queries: union of packed corpora, epoch order, rank shards, batches,
collation, preference stacking, step plan, row sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwright.operators import examples as X
from packwright.operators import loading as LD
from packwright.operators.batch_map import map_batches
from packwright.operators.ordering import MULTIPLIER, PRIME, STEPS, permutation_keys, sequential_index
from packwright.plans.common import L, P, ids_str, vocab
from packwright.plans.corpus import GROUP, counted_groups, packed_sql_cte, saved_packed
from packwright.plans.instruct import KEY, dpo_encoded_sql, ones_sql, pad_sql, sft_encoded_sql
from packwright.sources import adapters as A
from packwright.sources import readers as R

QUERIES: dict = {}
ORACLES: dict = {}
B = P.batch_size
W = P.world_size


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _packed_rows_sql(corpus: str) -> str:
    return f"""(WITH {packed_sql_cte(corpus)}
SELECT split, source, pack_group, chunk, md5(array_to_string(list(id ORDER BY g), ' ')) AS ids_md5 FROM m GROUP BY ALL)"""


@q("corpus_union", f"""SELECT 'plain' AS corpus, * FROM {_packed_rows_sql('plain')}
UNION ALL SELECT 'wikipedia' AS corpus, * FROM {_packed_rows_sql('wikipedia')}""")
def corpus_union(spark, sf_dir):
    frames = {c: saved_packed(spark, sf_dir, c).select(*GROUP, "chunk", F.md5(ids_str("input_ids")).alias("ids_md5"))
              for c in ("plain", "wikipedia")}
    u = LD.union_corpora(frames)
    return u.select("corpus", *GROUP, "chunk", "ids_md5")


ROWKEY_SQL = "source || ':' || CAST(pack_group AS VARCHAR) || ':' || CAST(chunk AS VARCHAR)"


@q("epoch_shuffle", f"""SELECT source, pack_group, chunk, epoch::INTEGER AS epoch,
  (row_number() OVER (PARTITION BY epoch ORDER BY md5('{P.seed}:' || CAST(epoch AS VARCHAR) || ':' || rk), rk) - 1)::BIGINT AS position
FROM (SELECT *, unnest(range(0, {P.epochs})) AS epoch FROM (SELECT *, {ROWKEY_SQL} AS rk FROM {_packed_rows_sql('plain')} WHERE split = 'train'))""")
def epoch_shuffle(spark, sf_dir):
    p = saved_packed(spark, sf_dir).filter(F.col("split") == "train")
    p = p.withColumn("rk", F.concat_ws(":", "source", F.col("pack_group").cast("string"), F.col("chunk").cast("string")))
    o = LD.epoch_order(p.select("source", "pack_group", "chunk", "rk"), "rk", P)
    return o.select("source", "pack_group", "chunk", "epoch", "position")


SFT_ROWS_SQL = f"""(WITH {sft_encoded_sql()}
SELECT conv_id, turn, conv_id * 1000 + turn AS idx, {pad_sql('ids', P.pad_id)} AS input_ids,
  {pad_sql(ones_sql('ids'), 0)} AS attention_mask, {pad_sql('labels', P.ignore_index)} AS labels
FROM ex WHERE len(ids) < {L})"""


def _sft_keys(spark, sf_dir):
    """Keys of the kept examples, from token counts: what is only ordered need not be encoded."""
    n = X.sft_lengths(A.sft(spark, sf_dir), KEY, P).filter(F.col("n_tokens") < L)
    return n.select(*KEY, (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"))


RANKED_SQL = f"""(WITH o AS (SELECT *, row_number() OVER (ORDER BY md5('{P.seed}:0:' || CAST(idx AS VARCHAR)), idx) - 1 AS p,
  count(*) OVER () AS n FROM {SFT_ROWS_SQL}),
padded AS (SELECT * EXCLUDE (n, p), unnest(range(p, CAST(ceil(n / {W}) * {W} AS BIGINT), n)) AS p FROM o)
SELECT (p % {W})::INTEGER AS rank, (p // {W})::BIGINT AS position, conv_id, turn, input_ids, attention_mask, labels FROM padded)"""


def _matrix_sql(c: str, order: str) -> str:
    return f"string_agg(array_to_string({c}, ' '), ';' ORDER BY {order})"


@q("rank_shards", f"SELECT rank, position, conv_id, turn FROM {RANKED_SQL}")
def rank_shards(spark, sf_dir):
    r = LD.rank_shards(_sft_keys(spark, sf_dir), "idx", P)
    return r.select("rank", "position", *KEY)


@q("collate_batches", f"""SELECT rank, (position // {B})::BIGINT AS batch, count(*)::INTEGER AS n_rows,
  md5({_matrix_sql('input_ids', 'position')}) AS ids_md5, md5({_matrix_sql('attention_mask', 'position')}) AS mask_md5,
  md5({_matrix_sql('labels', 'position')}) AS labels_md5
FROM {RANKED_SQL} GROUP BY ALL""")
def collate_batches(spark, sf_dir):
    r = LD.rank_shards(_sft_keys(spark, sf_dir), "idx", P)
    rows = X.sft_examples(A.sft(spark, sf_dir), KEY, vocab(spark, sf_dir), P, keep_overlength=True).filter(F.col("n_tokens") < L)
    b = LD.fixed_batches(r, "position", B).drop("idx").join(rows, KEY)
    c = LD.pad_batch(LD.collate(b, ["rank", "batch"], "position", ["ids", "labels"]), P)
    return c.select("rank", "batch", "n_rows", F.md5(LD.matrix_str("input_ids")).alias("ids_md5"),
                    F.md5(LD.matrix_str("attention_mask")).alias("mask_md5"),
                    F.md5(LD.matrix_str("labels")).alias("labels_md5"))


LM_BATCH = 72  # rows per device of the pretraining run


@q("collate_lm", f"""SELECT (i // {LM_BATCH})::BIGINT AS batch, count(*)::INTEGER AS n_rows,
  md5({_matrix_sql('ids', 'i')}) AS ids_md5, md5({_matrix_sql('segs', 'i')}) AS mask_md5
FROM (WITH {packed_sql_cte()},
      r AS (SELECT source, pack_group, chunk, list(id ORDER BY g) AS ids, list(seg ORDER BY g) AS segs FROM m WHERE split = 'train' GROUP BY ALL)
      SELECT *, row_number() OVER (ORDER BY source, pack_group, chunk) - 1 AS i FROM r) GROUP BY ALL""")
def collate_lm(spark, sf_dir):
    """Batches of packed rows: ids and segment masks."""
    p = saved_packed(spark, sf_dir).filter(F.col("split") == "train")
    s = sequential_index(p, ["source", "pack_group", "chunk"], out="i")
    c = LD.collate(LD.fixed_batches(s, "i", LM_BATCH), ["batch"], "i", LD.LM_COLUMNS)
    return c.select("batch", "n_rows", F.md5(LD.matrix_str("input_ids")).alias("ids_md5"),
                    F.md5(LD.matrix_str("attention_mask")).alias("mask_md5"))


@q("fixed_batches", f"""SELECT (i // {B})::BIGINT AS batch, count(*)::BIGINT AS n_rows, min(idx) AS first_key, max(idx) AS last_key
FROM (SELECT idx, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM {SFT_ROWS_SQL}) GROUP BY ALL""")
def fixed_batches(spark, sf_dir):
    s = sequential_index(_sft_keys(spark, sf_dir), KEY, out="i")
    b = LD.fixed_batches(s, "i", B)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("first_key"),
                                  F.max("idx").alias("last_key"))


PB = 18  # preference batch size of the reference's preference run


_PAIR_MATRICES = {"chosen_ids": pad_sql("chosen_ids", P.pad_id), "chosen_attention_mask": pad_sql(ones_sql("chosen_ids"), 0),
                  "chosen_labels": pad_sql("chosen_labels", P.ignore_index), "rejected_ids": pad_sql("rejected_ids", P.pad_id),
                  "rejected_attention_mask": pad_sql(ones_sql("rejected_ids"), 0),
                  "rejected_labels": pad_sql("rejected_labels", P.ignore_index)}
PAIR_ROWS_SQL = f"""{dpo_encoded_sql()},
r AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _PAIR_MATRICES.items())}, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i
      FROM de WHERE len(chosen_ids) < {L} AND len(rejected_ids) < {L})"""


def _pair_batches(spark, sf_dir):
    n = X.dpo_lengths(A.preference(spark, sf_dir), KEY, P)
    keys = n.filter((F.col("n_chosen") < L) & (F.col("n_rejected") < L)).select(*KEY)
    d = X.dpo_examples(A.preference(spark, sf_dir), KEY, vocab(spark, sf_dir), P, keep_overlength=True)
    b = LD.fixed_batches(sequential_index(keys, KEY, out="i"), "i", PB).join(d, KEY)
    c = LD.collate(b, ["batch"], "i", ["chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"])
    for side in ("chosen", "rejected"):
        c = LD.pad_batch(c, P, f"{side}_ids", f"{side}_labels", f"{side}_")
    return c


@q("collate_preference", f"""WITH {PAIR_ROWS_SQL}
SELECT (i // {PB})::BIGINT AS batch, count(*)::INTEGER AS n_rows, {', '.join(f"md5({_matrix_sql(c, 'i')}) AS {c}_md5" for c in LD.PREFERENCE_COLUMNS)}
FROM r GROUP BY ALL""")
def collate_preference(spark, sf_dir):
    c = _pair_batches(spark, sf_dir)
    return c.select("batch", "n_rows", *[F.md5(LD.matrix_str(x)).alias(f"{x}_md5") for x in LD.PREFERENCE_COLUMNS])


def _stacked_sql(c: str, out: str) -> str:
    return f"md5({_matrix_sql(f'chosen_{c}', 'i')} || ';' || {_matrix_sql(f'rejected_{c}', 'i')}) AS {out}"


@q("stack_preference", f"""WITH {PAIR_ROWS_SQL}
SELECT (i // {PB})::BIGINT AS batch, (2 * count(*))::INTEGER AS n_rows, {_stacked_sql('ids', 'stacked_md5')},
  {_stacked_sql('attention_mask', 'mask_md5')}, {_stacked_sql('labels', 'labels_md5')} FROM r GROUP BY ALL""")
def stack_preference(spark, sf_dir):
    st = LD.stack_preference(_pair_batches(spark, sf_dir))
    return st.select("batch", F.size("input_ids").alias("n_rows"), F.md5(LD.matrix_str("input_ids")).alias("stacked_md5"),
                     F.md5(LD.matrix_str("attention_mask")).alias("mask_md5"), F.md5(LD.matrix_str("labels")).alias("labels_md5"))


def _plan_sql(task: str, n: str) -> str:
    per = f"ceil({n} / {W})"
    bat = f"ceil({per} / {B})"
    return (f"SELECT '{task}' AS task, {n}::BIGINT AS n_rows, {per}::BIGINT AS rows_per_rank, {bat}::BIGINT AS batches_per_epoch, "
            f"({bat} * {P.epochs})::BIGINT AS total_steps, round({bat} * {P.epochs} * {P.warmup_fraction}, 6) AS warmup_steps, "
            f"{B * P.grad_accumulation * W}::BIGINT AS global_batch")


def _pretrain_rows(spark, sf_dir):
    """Packed training rows, counted without packing (n div L per group)."""
    from packwright.operators.packing import packed_counts

    c = packed_counts(counted_groups(A.corpus(spark, sf_dir).filter(F.col("split") == "train")), GROUP, P)
    return c.agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@q("step_plan", f"""{_plan_sql('pretrain', f"(SELECT count(*) FROM {_packed_rows_sql('plain')} WHERE split = 'train')")}
UNION ALL {_plan_sql('sft', f"(SELECT count(*) FROM {SFT_ROWS_SQL})")}
UNION ALL {_plan_sql('dpo', f"(WITH {dpo_encoded_sql()} SELECT count(*) FROM de WHERE len(chosen_ids) < {L} AND len(rejected_ids) < {L})")}""")
def step_plan(spark, sf_dir):
    """Rows are counted from token counts; nothing is encoded."""
    sft = X.sft_lengths(A.sft(spark, sf_dir), [], P).filter(F.col("n_tokens") < L)
    dpo = X.dpo_lengths(A.preference(spark, sf_dir), [], P).filter((F.col("n_chosen") < L) & (F.col("n_rejected") < L))
    counts = (
        _pretrain_rows(spark, sf_dir).withColumn("task", F.lit("pretrain"))
        .unionByName(sft.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("task", F.lit("sft")))
        .unionByName(dpo.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("task", F.lit("dpo")))
    )
    return LD.step_plan(counts, P)


SAMPLE_N = 10


@q("sample_rows", f"SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT {SAMPLE_N}")
def sample_rows(spark, sf_dir):
    """First n rows in key order (the preview is the feature, so the limit stays)."""
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "n_chars").orderBy("doc_id").limit(SAMPLE_N)


def _round_sql(value, key, side):
    x = f"(({value} + {key}) % {PRIME})"
    return f"((({x} * {x}) % {PRIME} * {MULTIPLIER} + {key}) % {PRIME} % {side})"


def permutation_sql(epoch):
    """One epoch's places of the documents, with the same arithmetic: (doc_id, epoch, position)."""
    keys = permutation_keys(P.seed, epoch)
    def once(src):
        q = f"(SELECT doc_id, n, a, b, y // b AS l, y % b AS r FROM {src})"
        for i in range(STEPS):
            q = f"(SELECT doc_id, n, a, b, (l + {_round_sql('r', keys[2 * i], 'a')}) % a AS l, r FROM {q})"
            q = f"(SELECT doc_id, n, a, b, l, (r + {_round_sql('l', keys[2 * i + 1], 'b')}) % b AS r FROM {q})"
        return f"SELECT doc_id, n, a, b, l * b + r AS y FROM {q}"
    return f"""(WITH RECURSIVE sized AS (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id) - 1 AS y FROM documents),
sided AS (SELECT doc_id, n, CAST(floor(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / floor(sqrt(n))) AS BIGINT) AS b, y FROM sized),
walk AS ({once('sided')} UNION ALL {once('(SELECT * FROM walk WHERE y >= n)')})
SELECT doc_id, {epoch}::INTEGER AS epoch, y AS position FROM walk WHERE y < n)"""


@q("epoch_permutation", " UNION ALL ".join(f"SELECT * FROM {permutation_sql(e)}" for e in range(P.epochs)))
def epoch_permutation(spark, sf_dir):
    """Every epoch's order of the documents from one index, by arithmetic: only the index is sorted."""
    d = sequential_index(A.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], out="idx")
    n = d.count()
    return LD.permuted_epochs(d, "idx", n, P).select("doc_id", "epoch", "position")


SINK_RANK = 1


@q("rank_sink", f"SELECT rank, position, conv_id, turn FROM {RANKED_SQL} WHERE rank = {SINK_RANK}")
def rank_sink(spark, sf_dir):
    """All ranks written as sorted file sets of their own; one is read back by pruning."""
    ranked = LD.rank_shards(_sft_keys(spark, sf_dir), "idx", P)
    path = LD.write_rank_shards(ranked.select("rank", "position", "conv_id", "turn"), R.new_location(spark, "ranks"))
    return LD.read_rank(spark, path, SINK_RANK).select("rank", "position", "conv_id", "turn")


MAP_ROWS = 300  # of a batch
CHUNK_CHARS = 5000


@q("batched_map", f"""SELECT batch, chunk, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc, sum(n)::BIGINT AS n_chars
FROM (SELECT *, CAST((sum(n) OVER (PARTITION BY batch ORDER BY idx) - n) // {CHUNK_CHARS} AS BIGINT) AS chunk FROM (
  SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS idx, (row_number() OVER (ORDER BY doc_id) - 1) // {MAP_ROWS} AS batch
  FROM documents)) GROUP BY batch, chunk""")
def batched_map(spark, sf_dir):
    """A user's function on batches of a stated number of rows, which returns fewer: documents of a
    batch, in order, put together to chunks of some characters."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"))
    d = sequential_index(d, ["doc_id"], out="idx")

    def chunks(b):
        b = b.assign(chunk=(b.n.cumsum() - b.n) // CHUNK_CHARS, batch=b.idx // MAP_ROWS)
        return b.groupby(["batch", "chunk"], as_index=False).agg(n_docs=("n", "size"), first_doc=("doc_id", "min"), n_chars=("n", "sum"))

    return map_batches(d, chunks, "batch bigint, chunk bigint, n_docs bigint, first_doc bigint, n_chars bigint", MAP_ROWS, index="idx")
