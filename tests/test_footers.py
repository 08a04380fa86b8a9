"""The footer audit names broken files and files of another schema, and reads footers only."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from packwright.sources import footers as T


def write(path, n, **columns):
    pq.write_table(pa.table({"doc_id": np.arange(n), **columns}), path, row_group_size=1000)


def test_audit(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "a.parquet", 2500, text=pa.array(["x"] * 2500))
    write(tmp_path / "b.parquet", 0, text=pa.array([], pa.string()))
    write(tmp_path / "sub" / "c.parquet", 7, text=pa.array(["y"] * 7))
    write(tmp_path / "d.parquet", 5, text=pa.array([1.5] * 5))
    write(tmp_path / "e f%.parquet", 3)
    (tmp_path / "torn.parquet").write_bytes((tmp_path / "a.parquet").read_bytes()[:-6])
    (tmp_path / "text.parquet").write_text("not a table")
    (tmp_path / "empty.parquet").write_bytes(b"")
    out = {r.file.rsplit("/", 1)[1].replace("%20", " ").replace("%25", "%"): r for r in
           T.audit_footers(spark, str(tmp_path), files_a_task=2).collect()}
    good = {k: (r.n_rows, r.n_row_groups, r.differs) for k, r in out.items() if r.problem is None}
    assert good == {"a.parquet": (2500, 3, False), "b.parquet": (0, 1, False), "c.parquet": (7, 1, False),
                    "d.parquet": (5, 1, True), "e f%.parquet": (3, 1, True)}
    assert out["a.parquet"]["columns"] == "doc_id int64, text string"
    assert all(out[k].n_rows is None and out[k].differs is None and out[k].problem for k in ("torn.parquet", "text.parquet", "empty.parquet"))


def test_bytes_read_do_not_grow_with_rows(tmp_path, monkeypatch):
    read = []

    class Counted:
        def __init__(self, path):
            self.f = pa.OSFile(path)

        def __enter__(self):
            return pa.PythonFile(self, mode="r")

        def __exit__(self, *a):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n=None):
            data = self.f.read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(T, "open_file", lambda uri: Counted(uri))
    sizes = []
    for n in (1000, 900_000):
        pq.write_table(pa.table({"v": np.random.default_rng(1).random(n)}), tmp_path / f"{n}.parquet")
        read.clear()
        assert T.read_footer(str(tmp_path / f"{n}.parquet"))[1] == n
        sizes.append(sum(read))
    assert sizes[1] <= sizes[0] + (64 << 10) < (tmp_path / "900000.parquet").stat().st_size // 50


def test_no_files(spark, tmp_path):
    assert T.audit_footers(spark, str(tmp_path)).count() == 0
