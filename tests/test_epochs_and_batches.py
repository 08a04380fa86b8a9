"""Permutations by arithmetic, batches of a stated size, rank files, and stored sketches."""

import pytest
from pyspark.sql import functions as F

from packwright.operators import loading as LD
from packwright.operators import ordering as O
from packwright.operators import sketches as K
from packwright.operators.batch_map import map_batches
from packwright.params import Params
from packwright.sources.readers import new_location


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 10_007])
def test_permutation_is_one_to_one(spark, n):
    d = spark.range(n).select(F.col("id"), *[O.permuted(F.col("id"), n, O.permutation_keys(5, e)).alias(f"p{e}") for e in range(2)])
    rows = d.collect()
    for e in range(2):
        assert sorted(r[f"p{e}"] for r in rows) == list(range(n))
    if n >= 1000:
        assert sum(r.p0 == r.id for r in rows) < 20 and sum(r.p0 == r.p1 for r in rows) < 20
        moved = [r.p0 for r in sorted(rows, key=lambda r: r.id)]
        assert abs(sum(moved[: n // 2]) / (n // 2) / n - 0.5) < 0.05  # the first half goes everywhere


def test_permutation_of_a_large_range(spark):
    n = 3_000_000_000_000
    rows = spark.range(0, n, n // 5000).select(O.permuted(F.col("id"), n, O.permutation_keys(1, 0)).alias("p")).collect()
    got = [r.p for r in rows]
    assert len(set(got)) == len(got) and all(0 <= p < n for p in got)


def sums(b):
    import pandas as pd

    return pd.DataFrame({"first": [b.id.iloc[0]], "n": [len(b)], "total": [b.id.sum()]})


@pytest.mark.parametrize("arrow", ["7", "100", "10000"])
def test_batches_do_not_follow_arrow_batches(spark, arrow):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, arrow)
    try:
        one = map_batches(spark.range(0, 1030, 1, 2), sums, "first long, n long, total long", 100).collect()
        whole = map_batches(spark.range(1030).repartition(5), sums, "first long, n long, total long", 100, index="id").collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted((r["first"], r.n) for r in one) == [
        *((f, 100) for f in range(0, 500, 100)), (500, 15), *((f, 100) for f in range(515, 1015, 100)), (1015, 15)]
    assert sorted(tuple(r) for r in whole) == [
        (f, min(100, 1030 - f), sum(range(f, min(f + 100, 1030)))) for f in range(0, 1030, 100)]


def test_a_rank_reads_its_files_only(spark):
    p = Params(world_size=4)
    ranked = LD.rank_shards(spark.range(501).withColumnRenamed("id", "idx"), "idx", p)
    path = LD.write_rank_shards(ranked, new_location(spark, "t-ranks"))
    for rank in range(4):
        part = LD.read_rank(spark, path, rank)
        files = {f for f in (r[0] for r in part.select(F.input_file_name()).distinct().collect())}
        assert files and all(f"rank={rank}/" in f for f in files)
        assert sorted(r.position for r in part.collect()) == list(range(126))
        runs = part.groupBy(F.input_file_name().alias("f")).agg(F.min("position").alias("a"), F.max("position").alias("b")).collect()
        runs = sorted((r.a, r.b) for r in runs)
        assert all(x[1] < y[0] for x, y in zip(runs, runs[1:]))


def test_sketches_merge_to_the_sketch_of_all(spark):
    d = spark.range(60_000).select((F.col("id") % 2).alias("source"), (F.col("id") % 9).alias("shard"),
                                   (F.col("id") % 37_000).cast("string").alias("v")).unionByName(
        spark.sql("SELECT 3L AS source, 0L AS shard, CAST(NULL AS STRING) AS v"))
    path = new_location(spark, "t-sketches")
    K.distinct_sketches(d, ["source", "shard"], "v").write.parquet(path)
    got = {r.source: r for r in K.estimated(K.merged(spark.read.parquet(path), ["source"])).collect()}
    exact = {r.source: r.n for r in d.groupBy("source").agg(F.countDistinct("v").alias("n")).collect()}
    once = {r.source: r.n_distinct for r in K.estimated(K.distinct_sketches(d, ["source"], "v")).collect()}
    assert got.keys() == exact.keys() and (got[3].n_rows, got[3].n_distinct) == (1, 0)
    for s in (0, 1):
        assert abs(got[s].n_distinct - exact[s]) <= K.ERROR * exact[s] and abs(got[s].n_distinct - once[s]) <= 0.01 * once[s]
