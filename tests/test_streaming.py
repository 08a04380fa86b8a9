"""Streaming forms equal their batch forms across several micro-batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from packwright.operators.packing import pack_ids
from packwright.params import Params
from packwright.sources.readers import new_location
from packwright.streaming import incremental as ST
from packwright.streaming import state as SS


@pytest.fixture(autouse=True)
def few_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_carry_over_pack_equals_corpus_wide_packing(spark):
    rnd = random.Random(3)
    rows = [(k, "s" + str(k % 2), [rnd.randrange(3, 40) for _ in range(rnd.randrange(1, 25))] + [2]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ids array<int>").withColumn(
        "unit", F.expr("doc_id div 10"))
    path = ST.land(df, new_location(spark, "t-landing"), "doc_id", unit="unit", files=3)
    stream = ST.source(spark, path, "doc_id long, source string, ids array<int>, unit long")
    p = Params(max_length=16)
    packed = SS.carry_over_pack(stream, ["source"], "doc_id", "ids", p)
    out = ST.run_to_table(packed, new_location(spark, "t-out"), new_location(spark, "t-ckpt"))
    got = {(r.source, r.chunk): r.input_ids for r in spark.read.parquet(out).collect()}
    want = {(r.source, r.chunk): r.input_ids for r in pack_ids(df, "ids", ["source"], "doc_id", p).collect()}
    assert got == want and len(got) > 20


def test_lanes_spread_a_hot_source_over_tasks(spark):
    # "hot" holds a third of the rows; with lanes its packing is many groups, not one
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 5}", [k % 30 + 3] * (k % 7 + 1) + [2]) for k in range(2000)]
    df = ST.with_lane(spark.createDataFrame(rows, "doc_id long, source string, ids array<int>"), "doc_id", 10, 8)
    hot = df.filter("source = 'hot'").groupBy("lane").count().collect()
    assert len(hot) == 8 and max(r["count"] for r in hot) < 120
    path = ST.land(df.withColumn("unit", F.expr("doc_id div 100")), new_location(spark, "t-lanes"), "doc_id", unit="unit", files=4)
    stream = ST.source(spark, path, "doc_id long, source string, ids array<int>, lane string")
    p = Params(max_length=16)
    out = ST.run_to_table(SS.carry_over_pack(stream, ["source", "lane"], "doc_id", "ids", p),
                          new_location(spark, "t-lanes-out"), new_location(spark, "t-lanes-ckpt"))
    got = {(r.source, r.lane, r.chunk): r.input_ids for r in spark.read.parquet(out).collect()}
    want = {(r.source, r.lane, r.chunk): r.input_ids for r in pack_ids(df, "ids", ["source", "lane"], "doc_id", p).collect()}
    assert got == want and len({k[1] for k in got if k[0] == "hot"}) == 8


def test_watermark_dedup_keeps_one_per_key(spark):
    # event times start well after the epoch: Spark counts rows at or below the
    # watermark as late, and the first watermark is 0
    rows = [(i, f"k{i % 7}", 1_000 + i % 7) for i in range(70)]
    df = spark.createDataFrame(rows, "idx long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    path = ST.land(df.select("idx", "key", "ts"), new_location(spark, "t-land2"), "idx", files=3)
    s = ST.source(spark, path, "idx long, key string, ts timestamp", files_per_trigger=1)
    out = ST.run_to_table(ST.dedup_within_watermark(s, ["key"], "ts", "1 hour").select("key"),
                          new_location(spark, "t-out2"), new_location(spark, "t-ckpt2"))
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == [f"k{i}" for i in range(7)]


def test_packing_goes_on_from_its_checkpoint(spark):
    """Stopped after each file: the remainder and the chunk number are those of the state store."""
    rnd = random.Random(8)
    rows = [(k, "s" + str(k % 2), [rnd.randrange(3, 40) for _ in range(rnd.randrange(1, 25))] + [2]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ids array<int>")
    landing, out, ckpt = (new_location(spark, f"t-again-{n}") for n in ("in", "out", "ckpt"))
    p = Params(max_length=16)
    for lo in (0, 70, 120):
        hi = {0: 70, 70: 120, 120: 200}[lo]
        df.filter(F.col("doc_id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(landing)
        stream = ST.source(spark, landing, "doc_id long, source string, ids array<int>")
        ST.run_to_table(SS.carry_over_pack(stream, ["source"], "doc_id", "ids", p), out, ckpt)
    got = {(r.source, r.chunk): r.input_ids for r in spark.read.parquet(out).collect()}
    want = {(r.source, r.chunk): r.input_ids for r in pack_ids(df, "ids", ["source"], "doc_id", p).collect()}
    assert got == want and len(got) > 20


def test_idle_lanes_hand_on_their_remainder(spark):
    """Timers of processing time are looked at by every batch, so this stream goes on until stopped."""
    landing, out, ckpt = (new_location(spark, f"t-idle-{n}") for n in ("in", "out", "ckpt"))
    schema = "doc_id long, source string, ids array<int>"
    spark.createDataFrame([(0, "a", [5, 6, 7, 8, 9]), (1, "b", [1])], schema).coalesce(1).write.parquet(landing)
    packed = SS.carry_over_pack(ST.source(spark, landing, schema), ["source"], "doc_id", "ids", Params(max_length=4), flush_idle_seconds=1)
    with SS.rocksdb(spark):
        query = packed.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(processingTime="1 second").start(out)
    got, end = [], time.time() + 90
    while len(got) < 3 and time.time() < end and query.isActive:
        time.sleep(1)
        got = sorted((r.source, r.chunk, r.input_ids) for r in spark.read.schema(
            "source string, chunk long, input_ids array<int>").parquet(out).collect()) if query.lastProgress else []
    query.stop()
    assert got == [("a", 0, [5, 6, 7, 8]), ("a", 1, [9]), ("b", 0, [1])]


def test_first_occurrence_under_late_arrival(spark):
    """Copies arrive in any order over several micro-batches; the stream stops in between."""
    rnd = random.Random(4)
    rows = [(i, f"k{i % 40}" if i % 40 else None, None if i % 3 == 0 else f"v{i}", i % 40) for i in range(400)]
    order = sorted(rows, key=lambda r: (r[3] // 10, rnd.random()))  # keys come in time, copies do not
    order.append((10**9, "end", "x", 10**6))
    landing, out, ckpt = (new_location(spark, f"t-first-{n}") for n in ("in", "out", "ckpt"))
    schema = "idx long, key string, v string, t long"
    for lo in range(0, 401, 101):
        part = spark.createDataFrame(order[lo : lo + 101], schema).withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
        part.coalesce(1).write.mode("append").parquet(landing)
        s = ST.source(spark, landing, "idx long, key string, v string, ts timestamp")
        ST.run_to_table(SS.first_occurrences(s, "key", "idx", "ts", 30), out, ckpt)
    got = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted(((i, k, v) for i, k, v, _ in rows if i < 40), key=str)


def test_a_lane_hands_on_frames_of_few_rows():
    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    c = SS.Carry(["source"], "doc_id", "ids", 4, None)
    c.tail = State()
    frames = [pd.DataFrame({"doc_id": [2, 1], "ids": [[5] * 1001, [3] * 1002]})]
    out = list(c.handleInputRows(("s",), iter(frames), None))
    assert len(out) > 1 and max(len(f) for f in out) <= SS.FRAME
    flat = [x for f in out for row in f.input_ids for x in row]
    assert flat == [3] * 1002 + [5] * 998 and [k for f in out for k in f.chunk] == list(range(500))
    assert c.tail.value == ([5] * 3, 500)


def test_a_larger_table_makes_more_micro_batches(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(4000).repartition(16).write.parquet(path)
    assert ST.files_a_batch(spark, path) == 4
    assert ST.files_a_batch(spark, path, most_bytes=1) == 1
