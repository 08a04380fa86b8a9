"""Vector search against exact search."""

import numpy as np

from packwright.llm import vector_search as V

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, asked, top):
    d = max({len(v) for _, v in rows if v}, key=lambda n: (sum(len(v or []) == n for _, v in rows), n))
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if i is not None and v and len(v) == d and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, q in ok:
        if asked(i):
            s = sorted(((-float((q * v).sum()), j) for j, v in ok if j != i))[:top]
            out[i] = [(k + 1, j, -x) for k, (x, j) in enumerate(s)]
    return out


def run(spark, rows, asked, top, **options):
    typed = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    d = spark.createDataFrame(typed, SCHEMA).repartition(4)
    got = {}
    for r in V.search(d, d.filter(asked), top=top, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert [x[:2] for x in got[k]] == [x[:2] for x in want[k]]
        assert np.allclose([x[2] for x in got[k]], [x[2] for x in want[k]], rtol=0, atol=1e-12)


def test_small_tables_give_whole_results(spark):
    rng = np.random.default_rng(3)
    # whole numbers, so that equal products are equal in every order of adding up
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [nan, 1, 1, 1, 1]), (205, [inf, 1, 1, 1, 1]), (206, [None, 1.0, 1, 1, 1]),
             (207, [1.0, 2.0]), (None, [1.0] * 5)] + [(300 + k, [9.0, 0, 0, 0, 1]) for k in range(60)] + [(400, [0.5, 0, 0, 0, 0])]
    same(run(spark, rows, "vec_id % 20 = 0", 20), exact(rows, lambda i: i % 20 == 0, 20))


def test_fewer_candidates_than_top_and_empty(spark):
    rows = [(k, [float(k + 1), 1.0]) for k in range(4)]
    same(run(spark, rows, "vec_id < 2", 20), exact(rows, lambda i: i < 2, 20))
    assert run(spark, [(1, [1.0])], "vec_id = 1", 20) == {}
    assert run(spark, [(1, [0.0])], "true", 20) == {}
    assert run(spark, [], "true", 20) == {}


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = run(spark, rows, "vec_id % 20 = 0", 20, list_size=60)
    want = exact(rows, lambda i: i % 20 == 0, 20)
    hits = [len({j for _, j, _ in want[q]} & {j for _, j, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    assert V.halve(np.array([v for _, v in rows]), 32).shape[0] == 32


def test_clustered_vectors_read_few_lists():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.2 for c in centres])
    c = V.halve(x, 64)
    graph = V.graph_of(c)
    read, found = [], []
    home = np.array([own[0] for own in V.lists_of(x, c, 1, 0.0)])
    for q in x[::160]:
        lists = V.walk(q, c, graph, 0.16, width=4)
        d = ((x - q) ** 2).sum(axis=1)
        found.append(np.isin(home[np.argsort(d)[:20]], lists).mean())
        read.append(len(lists))
    assert np.mean(found) > 0.95 and np.mean(read) < 16


def test_lists_are_balanced_and_boundaries_are_copied():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8))
    c = V.halve(x, 32)
    lists = V.lists_of(x, c, 2, 0.1)
    d = V.distances(x, c)
    assert all(own[0] == int(d[i].argmin()) and 1 <= len(own) <= 2 for i, own in enumerate(lists))
    assert any(len(own) == 2 for own in lists)
    assert np.bincount([own[0] for own in lists], minlength=32).max() < 4 * 4000 / 32


def test_blocks_hold_every_row_once(spark):
    rows = [(1, k, k, [1.0]) for k in range(500)] + [(2, k, k, [2.0]) for k in range(3)]
    got = V.blocks_of(spark.createDataFrame(rows, "list int, pid long, ph long, v array<double>"), 50).collect()
    assert sorted((r.list, x.pid) for r in got for x in r.block) == sorted((a, b) for a, b, *_ in rows)
    assert max(len(r.block) for r in got) < 120
