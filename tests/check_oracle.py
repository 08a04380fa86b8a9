"""Run registered queries in Spark and their SQL in DuckDB, compare results.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return norm(list(v))
    return repr(v) if v is not None else "NULL"


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def type_diff(df, rel):
    """Columns whose Spark type differs from the DuckDB result type."""
    st = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c)}


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from packwright.session import local_session

    spark = local_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in os_:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            rel = con.sql(os_[name])
            drows = rel.fetchall()
            dcols = rel.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        td = time.time() - t1
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={cols} duck={dcols}")
            bad += 1
            continue
        td_ = type_diff(df, rel)
        if td_:
            print(f"TYPES {name}: {td_}")
        h1, l1 = digest(rows, cols)
        h2, l2 = digest(drows, dcols)
        if h1 == h2:
            print(f"OK   {name}: {len(rows)} rows spark {ts:.1f}s duck {td:.1f}s")
        else:
            bad += 1
            print(f"FAIL {name}: rows spark={len(rows)} duck={len(drows)}")
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:2]:
                print("   spark only:", x[:400])
            for x in sorted(s2 - s1)[:2]:
                print("   duck  only:", x[:400])
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
