"""Readers on small fixtures: audit counts broken lines, shard subset is sorted."""

import json

from pyspark.sql.types import StructType

from packwright.sources import readers as R


def test_json_audit_names_the_broken_file(spark, tmp_path):
    for name, good, bad in (("a", 3, 1), ("b", 2, 0), ("c", 0, 2)):
        lines = [json.dumps({"doc_id": i, "text": f"t{i}"}) for i in range(good)] + ["not json {"] * bad
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    out = R.audit_json(spark, str(tmp_path), StructType.fromDDL("doc_id bigint, text string"))
    got = {r.file.rsplit("/", 1)[1]: (r.n_rows, r.n_valid, r.n_corrupt) for r in out.collect()}
    assert got == {"a.json": (4, 3, 1), "b.json": (2, 2, 0), "c.json": (2, 0, 2)}


def test_parquet_audit_names_the_broken_file(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "sub").mkdir()
    pq.write_table(pa.table({"doc_id": [1, 2, 3]}), tmp_path / "good.parquet")
    pq.write_table(pa.table({"doc_id": [4]}), tmp_path / "sub" / "also.parquet")
    (tmp_path / "torn.parquet").write_bytes((tmp_path / "good.parquet").read_bytes()[:-6])
    (tmp_path / "text.parquet").write_text("not a table")
    out = R.audit_parquet(spark, str(tmp_path), "doc_id bigint")
    got = {r.file.rsplit("/", 1)[1]: (r.n_rows, r.readable) for r in out.collect()}
    assert got == {"good.parquet": (3, True), "also.parquet": (1, True), "torn.parquet": (0, False), "text.parquet": (0, False)}


def test_scratch_folders_are_removed(spark):
    import os

    where = R.new_location(spark, "t-scratch")
    spark.range(3).write.parquet(where)
    local = where.removeprefix("file://")
    assert os.path.isdir(local)
    made, R._MADE[:] = list(R._MADE), [where]
    try:
        assert R.drop_scratch(spark) == 1 and not os.path.isdir(local)
    finally:
        R._MADE[:] = [m for m in made if m != where]


def test_shard_subset_takes_first_shards_in_sorted_order(spark, tmp_path):
    for name in ("c", "a", "b"):
        spark.createDataFrame([(name,)], "v string").write.parquet(str(tmp_path / f"s={name}"))
    got = sorted(r.v for r in R.shard_subset(spark, str(tmp_path), 2).collect())
    assert got == ["a", "b"]
