"""Shared pieces of the registered queries: parameters, the corpus vocabulary, and
their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright import sql as S
from packwright.operators.tokens import build_vocab
from packwright.params import DEFAULT, EOS_ID, EOS_TOKEN, SPECIAL_TOKENS, Params
from packwright.sources import adapters as A

P: Params = DEFAULT
L = P.max_length


def stamp(spark: SparkSession, sf_dir: str, name: str = "documents") -> tuple:
    """Size and time of a table's files, so that saved tables made from it notice a change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = p.getFileSystem(conf)
    return fs.getContentSummary(p).getLength(), max(s.getModificationTime() for s in fs.listStatus(p))


_VOCABS: dict = {}


def vocab(spark: SparkSession, sf_dir: str, params: Params = P) -> DataFrame:
    """The corpus vocabulary, built once per session and input folder and kept as a
    written table in the shared checkpoint folder (like a saved tokenizer file); later
    queries read it instead of re-scanning the corpus."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), params.vocab_size)
    path = _VOCABS.get(key)
    if path is None:
        from packwright.sources.readers import new_location

        path = new_location(spark, "vocab")
        build_vocab(A.table(spark, sf_dir, "documents"), "text", params).write.parquet(path)
        _VOCABS[key] = path
    return spark.read.parquet(path)


def vocab_sql(params: Params = P) -> str:
    specials = ", ".join(f"({S.lit(t)}, {i}, 0)" for i, t in enumerate(SPECIAL_TOKENS))
    sp = ", ".join(S.lit(t) for t in SPECIAL_TOKENS)
    return (
        "(SELECT token, id, cnt FROM (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token ASC) + 2 AS INTEGER) AS id, cnt "
        f"FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest({S.pretokens('text')}) AS token FROM documents) "
        f"WHERE token NOT IN ({sp}) GROUP BY token)) WHERE id <= {params.vocab_size - 1} "
        f"UNION ALL SELECT * FROM (VALUES {specials}) AS s(token, id, cnt))"
    )


def ids_str(c) -> Column:
    """Arrays leave queries as space-joined strings (engine-neutral comparison)."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


def tokens_sql(list_expr: str) -> str:
    """DuckDB: list of (token, 1-based pos) structs."""
    return f"list_transform({list_expr}, lambda x, i: {{'token': x, 'pos': i}})"


EOS_LIT = S.lit(EOS_TOKEN)
EOS = EOS_ID
