"""Top share of a group by counting, against sorting."""

import math
import random

import pytest

from packwright.operators import topn as T

@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "g string, score double, place long, extra int"


def want(rows, ratio):
    rank = lambda r: ((0, 0.0) if r[1] is None or math.isnan(r[1]) else (1, r[1]))
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-rank(r)[0], -rank(r)[1], r[2]))
        out += mine[: math.floor(len(mine) * ratio)]
    return sorted(out, key=str)


def got(spark, rows, ratio, one_task):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in T.top_share(df, ["g"], "score", "place", ratio, one_task).collect()), key=str)


def make(seed, n=600):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308, 5e-324, 1.0]
    score = lambda g: rng.choice(odd) if rng.random() < 0.2 else rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3)), 10 ** rng.uniform(-300, 300)])
    rows = []
    for i in range(n):
        g = rng.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((g, score(g), i if rng.random() < 0.5 else -i, 7))
    return rows


@pytest.mark.parametrize("ratio, one_task", [(0.3, 10), (0.7, 200), (0.7, 10**6)])
def test_by_counting_and_by_ranking(spark, ratio, one_task):
    """Every group, the hot one, or none by counting."""
    rows = [r for r in make(3) if not (r[1] is not None and math.isnan(r[1]))]
    assert got(spark, rows, ratio, one_task) == want(rows, ratio)


def test_lost_scores_come_last(spark):
    nan = float("nan")
    rows = [("g", s, i, 0) for i, s in enumerate([nan, None, float("-inf"), 2.0, 1.0, nan])]
    for one_task in (0, 100):
        df = spark.createDataFrame(rows, SCHEMA)
        assert [sorted(r.place for r in T.top_share(df, ["g"], "score", "place", k / 6, one_task).collect()) for k in (3, 5)] == [
            [2, 3, 4], [0, 1, 2, 3, 4]]


def test_one_score_for_all(spark):
    for start, step in ((2**62, 1), (-(2**63) + 1, 2**50)):
        rows = [("g", 4.0, start + i * step, 0) for i in range(500)]
        assert sorted(r[2] for r in got(spark, rows, 0.1, 5)) == [start + i * step for i in range(50)]


def test_empty_and_bad_ratio(spark):
    assert got(spark, [], 0.5, 1) == []
    with pytest.raises(ValueError):
        T.top_share(spark.createDataFrame([], SCHEMA), ["g"], "score", "place", 1.5)
