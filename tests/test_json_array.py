"""Arrays read by byte ranges equal the multi-line read, wherever ranges begin."""

import json
import random

import pytest
from pyspark.sql import functions as F

from packwright.sources import json_array as J
from packwright.sources.readers import new_location

SCHEMA = "id long, text string, tags array<string>, sub struct<a:string,b:array<struct<c:long>>>"
NASTY = ['"', "\\", "\\\\", '\\"', "}", "{", "[", "]", ",", "},{", '"}', "é", "中文", "\n", "\\u007d", "]]", " "]


@pytest.fixture
def ranges(spark):
    """Byte ranges of a chosen size."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def of(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")

    yield of
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def records(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(NASTY + ["word "]) for _ in range(rng.randint(0, 12)))
    return [{"id": i, "text": rng.choice([text(), None]), "tags": [text() for _ in range(rng.randint(0, 3))],
             "sub": {"a": text(), "b": [{"c": rng.randint(0, 9)}] * rng.randint(0, 2)}} for i in range(n)]


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("size", [37, 256, 5000])
def test_equal_to_the_multi_line_read(spark, tmp_path, ranges, size):
    got = records(size, 60)
    got[30]["text"] = "a long one }] " * 400  # over several ranges
    (tmp_path / "a.json").write_text(json.dumps(got, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(records(2, 9), indent=2))
    (tmp_path / "c.json").write_text(" [ ]\n")
    (tmp_path / "d.json").write_text(json.dumps(records(3, 1)[0]))
    (tmp_path / "e.json").write_text(json.dumps(records(4, 1)[0], indent=1) + "\n")
    want = rows(spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path)))
    ranges(size)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (4 if size > 1000 else 30)
    assert rows(J.read_json_array(spark, str(tmp_path), SCHEMA)) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "text": f"t{i}", "tags": [], "sub": None} for i in range(3000)]))
    ranges(4096)
    starts = J.range_starts(spark, str(tmp_path))
    assert len(starts) > 20 and all(depth in (0, 1, 2, 3) for _, depth, _ in starts.values())
    out = J.read_json_array(spark, str(tmp_path), SCHEMA)
    assert sorted(r.id for r in out.collect()) == list(range(3000))


def test_written_arrays_are_whole_documents(spark, ranges):
    df = spark.range(1000).select("id", F.concat(F.lit('q"}'), F.col("id").cast("string")).alias("text"),
                                  F.array().cast("array<string>").alias("tags")).repartition(3)
    path = J.write_json_arrays(df, new_location(spark, "t-arrays"))
    whole = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]
    assert len(whole) == 3 and sum(map(len, whole)) == 1000
    ranges(900)
    schema = "id long, text string, tags array<string>"
    assert rows(J.read_json_array(spark, path, schema)) == rows(df)


def test_a_batch_is_looked_at_in_stretches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "STRETCH", 100)
    files = ["a"] * 500 + ["b"] * 500
    starts = [0] * 300 + [7] * 700  # the files share a start
    values = [f'{{"k": "{i}"' for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"file": files, "start": pa.array(starts, pa.int64()), "value": values})
    got = list(J._ranges([batch]))
    assert max(len(data) for _, _, data in got) < 200
    whole = {}
    for file, start, data in got:
        whole[file, start] = whole.get((file, start), b"") + data
    want = {}
    for f, s, v in zip(files, starts, values):
        want[f, s] = want.get((f, s), b"") + v.encode() + b"}"
    assert whole == want
    parts = pa.Table.from_batches(J._elements({("a", 0): (False, 0, True)}, batch_bytes=50)([pa.RecordBatch.from_pydict(
        {"file": ["a"] * 9, "start": pa.array([0] * 9, pa.int64()), "value": ['[{"k": 1'] + [',{"k": 1'] * 8})]))
    assert parts.num_rows == 9 and max(c.num_chunks for c in parts.columns) >= 2
