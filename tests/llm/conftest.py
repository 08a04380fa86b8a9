import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, over several partitions."""

    def make(texts, parts=3, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)

    return make
