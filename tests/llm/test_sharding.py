"""Sharding against plain sums: whole, near equal, gapless, equal texts together."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from packwright.llm import queries as Q
from packwright.llm import sharding as S


def read(spark, docs, **options):
    out = S.read(spark, S.write(docs, S.new_folder(spark), **options)).collect()
    return [(r.row, r["size"], r.shard, r.slot) for r in out]


def check(rows, out, shards, tolerance=S.TOLERANCE):
    assert Counter((r.doc_id, r.text) for r, *_ in out) == Counter(rows)
    sizes, slots = [0] * shards, defaultdict(list)
    for r, size, shard, slot in out:
        assert size == len((r.text or "").encode()) + 8
        sizes[shard] += size
        slots[shard].append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    total = sum(sizes)
    largest = max((len((t or "").encode()) + 8 for _, t in rows), default=0)
    below = 0
    for k, s in enumerate(sizes[:-1]):  # every boundary within the tolerance, or nearest by whole rows
        below += s
        assert abs(below - total * (k + 1) / shards) <= max(tolerance * total / shards, largest / 2 + 1)
    return sizes


@pytest.mark.parametrize("part_mb", [64, 0.002])
def test_whole_and_near_equal(spark, make_docs, part_mb):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 40) + str(i)) for i in range(3000)]
    sizes = check(rows, read(spark, make_docs(rows), shards=6, part_mb=part_mb), 6)
    assert max(sizes) - min(sizes) <= 2 * S.TOLERANCE * sum(sizes) / 6 + 200


def test_equal_texts_stay_together(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, f"text {rng.randint(0, 900)}") for i in range(4000)]
    out = read(spark, make_docs(rows), shards=8)
    places = defaultdict(set)
    for r, _, shard, _ in out:
        places[r.text].add(shard)
    # seven boundaries, each cuts one group at most
    assert sum(len(x) - 1 for x in places.values()) <= 7
    check(rows, out, 8)


def test_hot_texts_and_repeated_rows_are_cut(spark, make_docs):
    rows = [(i, "copy " * 20) for i in range(2000)] + [(7, "one row " * 9)] * 2500 + [(i, f"t{i} " * 5) for i in range(1500)]
    sizes = check(rows, read(spark, make_docs(rows, parts=5), shards=7), 7)
    assert max(sizes) < 1.02 * sum(sizes) / 7


def test_defined_cases(spark, make_docs):
    assert read(spark, make_docs([])) == []
    rows = [(None, None), (None, None), (1, ""), (2, "x" * 300_000), (2, "y"), (3, "é")]
    check(rows, read(spark, make_docs(rows), shards=24), 24)
    clash = make_docs(rows).selectExpr("*", "1 AS part", "2 AS size", "3 AS shard", "'k' AS a", "4 AS at", "5 AS row")
    out = read(spark, clash, shards=3)
    assert {(r.part, r["size"], r.shard, r.a, r.at, r.row) for r, *_ in out} == {(1, 2, 3, "k", 4, 5)}
    assert len(out) == 6


def test_shards_do_not_depend_on_the_partitions(spark, make_docs):
    rng = random.Random(12)
    rows = [(i, f"text {rng.randint(0, 300)} " * 3) for i in range(2000)]
    got = [sorted((r.doc_id, shard) for r, _, shard, _ in read(spark, make_docs(rows, parts=p), shards=5)) for p in (1, 9)]
    assert got[0] == got[1]


def test_splitters_of_chosen_keys(spark):
    # keys close together and far apart; a third of the bytes in one key
    words = [(0, 0, 0)] * 500 + [(0, 0, i) for i in range(1, 50)] + [(0, 5, i) for i in range(300)] + [(-1, i, 0) for i in range(700)]
    rows = [(*w, 10 + i % 7) for i, w in enumerate(words)]
    keys = spark.createDataFrame(rows, "a long, b long, c long, size long").repartition(6)
    total = sum(r[3] for r in rows)
    plain = sorted((sum((x % (1 << 64)) << s for x, s in zip(r, (128, 64, 0))), r[3]) for r in rows)
    for cut in (0.01, 0.3, 0.35, 0.5, 0.77, 0.999):
        (at,) = S.splitters(keys, total, [(cut * total, 0)])
        below = [sum(s for k, s in plain if k < b) for b in {k for k, _ in plain} | {k + 1 for k, _ in plain}]
        assert abs(sum(s for k, s in plain if k < at) - cut * total) == pytest.approx(min(abs(x - cut * total) for x in below))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = Q.op13_sharding(spark, d).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 24
