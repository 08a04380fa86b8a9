"""The corpus pipeline: documents -> quality -> line dedup -> near dedup -> decontamination ->
byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from packwright.llm import decontamination, line_dedup, near_dup, quality
from packwright.llm import common as C
from packwright.llm import queries as Q
from packwright.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of this stage's own
    documents that are not held out."""
    model = quality.train(docs, C.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, Q.QUALITY_THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; ``n_chars`` follows the new text."""
    return line_dedup.with_lines_dropped(docs, min_docs=10, min_chars=1)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one of smallest id."""
    return near_dup.one_of_each(docs, near_dup.near_duplicates(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontamination.clean_documents(docs, C.table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes they decode to."""
    return Q.bpe_digests(docs, "ids")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Learnt scores and sampled hashes are beyond SQL; the tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
