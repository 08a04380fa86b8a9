"""Audit of Parquet files by their footers: rows, row groups and schema of each file, files that
are broken, and files whose schema is not the others'. No row and no column is read: the bytes
read per file are its footer, whatever it holds."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, bytes long, footer_bytes long, n_rows long, n_row_groups int, columns string, problem string"
FILES_A_TASK = 64


def open_file(uri: str):
    """A random-access file of any store that Arrow knows (local, hdfs, s3, gs, abfs), by URI."""
    from pyarrow import fs

    if re.match(r"^file:/+", uri) or "://" not in uri:
        return fs.LocalFileSystem().open_input_file("/" + re.sub(r"^file:/+", "", uri).lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def columns_of(schema: pa.Schema) -> str:
    """Names and types in their order, as one line."""
    return ", ".join(f"{f.name} {f.type}{'' if f.nullable else ' not null'}" for f in schema)


def read_footer(uri: str) -> tuple:
    """footer_bytes, n_rows, n_row_groups, columns, problem."""
    import pyarrow.parquet as pq

    try:
        with open_file(uri) as source, pq.ParquetFile(source) as f:
            m = f.metadata
            return m.serialized_size, m.num_rows, m.num_row_groups, columns_of(f.schema_arrow), None
    except (OSError, pa.ArrowException, ValueError) as e:  # torn, foreign or unreachable: the finding
        return None, None, None, None, str(e).splitlines()[0][:200] if str(e) else type(e).__name__


def audit_footers(spark: SparkSession, path: str, files_a_task: int = FILES_A_TASK) -> DataFrame:
    """One row per file under ``path``: SCHEMA, and ``differs`` (its columns are not those of most
    files; ties go to the first in order; null for files without a footer).

    Spark lists the files (no content is read); tasks of ``files_a_task`` files open the footers;
    one row a file and one a schema are all that moves."""
    types = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("footer_bytes", pa.int64()), ("n_rows", pa.int64()),
                       ("n_row_groups", pa.int32()), ("columns", pa.string()), ("problem", pa.string())])

    def footers(batches):
        for b in batches:
            files = b.column("file").to_pylist()
            found = list(zip(*map(read_footer, files))) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("bytes"), *(pa.array(list(c), type=types.field(i + 2).type) for i, c in enumerate(found))],
                schema=types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"))
    n, listed = files.count(), files.inputFiles()
    if len(listed) > n:  # Spark lists files without a byte, but reads none of them
        jvm = spark.sparkContext._jvm
        paths = [(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString(), 0) for f in listed]
        files = files.unionByName(spark.createDataFrame(paths, "file string, bytes long").join(files, "file", "left_anti"))
        n = len(listed)
    rows = files.repartition(max(1, -(-n // files_a_task))).mapInArrow(footers, SCHEMA)
    from packwright.session import cut_lineage

    rows = cut_lineage(rows)  # footers are opened once
    usual = rows.filter("columns IS NOT NULL").groupBy("columns").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "columns").limit(1).select(F.col("columns").alias("usual"))
    return rows.join(F.broadcast(usual), F.lit(True), "left").select(
        "*", (F.col("columns") != F.col("usual")).alias("differs")).drop("usual")
