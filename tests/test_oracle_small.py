"""Every registered query with an oracle equals its DuckDB SQL at sf0.001; the
remaining (streaming) queries run and return rows."""

import pytest

import __spark_entry__ as E
from tests.check_oracle import digest, duck, type_diff

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(rows) > 0
        return
    rel = con.sql(ORACLES[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(df.columns) == sorted(dcols)
    assert type_diff(df, rel) == {}
    assert digest(rows, df.columns)[0] == digest(drows, dcols)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and {"input_ids", "attention_mask"} <= set(df.columns)
