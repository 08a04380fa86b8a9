"""Property checks against plain-Python definitions of the reference's rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from packwright.functions import arrays as AR
from packwright.functions import text as T
from packwright.operators.scoring import top_n_in_order
from pyspark.sql import functions as F

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def _segments(ids, eos):
    out, cur = [], 1
    for i in ids:
        out.append(cur)
        if i == eos:
            cur += 1
    return out


def _cut(text):
    idx = len(text)
    for m in ("References", "External links"):
        if m + "\n\n" in text:
            idx = min(idx, text.index(m + "\n\n"))
        elif m + "\n" in text:
            idx = min(idx, text.index(m + "\n"))
    if "Charts\n" in text:
        idx = min(idx, text.index("Charts\n"))
    return text[:idx]


@SETTINGS
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=60))
def test_segment_mask_equals_loop(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, ids array<int>")
    got = {r.k: r.m for r in df.select("k", AR.segment_mask("ids", 0).alias("m")).collect()}
    assert all(got[i] == _segments(r, 0) for i, r in enumerate(rows))


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["References", "External links", "Charts", "\n", "\n\n", "x", " y"]),
                         max_size=12).map("".join), min_size=1, max_size=80))
def test_cut_tail_equals_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", T.cut_tail("t").alias("c")).collect()}
    assert all(got[i] == _cut(t) for i, t in enumerate(texts))


@SETTINGS
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=5), max_size=15), min_size=1, max_size=60))
def test_top_n_in_order_equals_sort(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, lines array<string>")
    got = {r.k: r.kept for r in df.select("k", top_n_in_order(F.col("lines"), F.length, 0.7).alias("kept")).collect()}
    for i, r in enumerate(rows):
        n = int(len(r) * 0.7)
        best = sorted(range(len(r)), key=lambda j: (-len(r[j]), j))[:n]
        assert got[i] == sorted(best)
