"""Line dedup against a plain count of line keys."""

import random

from packwright.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s).strip(SPACE)


def brute(rows, min_docs, min_chars):
    seen = {}
    for _, t in rows:
        for k in {fold(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen.get(fold(x), 0) < min_docs]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(docs, min_docs, min_chars, **options):
    out = L.drop_repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, **options)
    return sorted([(r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in out.collect()], key=str)


ROWS = [(1, "A line\nb"), (2, " a LINE\t\nc"), (3, "a line\na line\nd\n"), (4, None), (5, ""), (6, "\n\n"), (7, "É\nÀ"),
        (8, "é\nÉ "), (9, "É"), (9, "É"), (None, "a line\nz"), (10, "\x1ca line"), (11, "a\xa0line"), (12, "x" * 300_000 + "\na line")]


def test_matches_brute_force(make_docs):
    for min_docs, min_chars in ((1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (2, 0)):
        assert run(make_docs(ROWS), min_docs, min_chars) == brute(ROWS, min_docs, min_chars)


def test_hot_and_shuffled_keys_agree(make_docs):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(0, 12))) + "\ncommon")
            for i in range(300)]
    want = brute(rows, 40, 1)
    # no key, some keys and all keys count as hot
    for hot_share in (1, 30, 10**6):
        assert run(make_docs(rows, 7), 40, 1, hot_share=hot_share) == want


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert run(make_docs([]), 2, 1) == []
    docs = make_docs(["a\nb", "a\nc"]).selectExpr("*", "'r' AS row", "1 AS id", "2 AS th", "3 AS gone", "4 AS kept", "5 AS k1")
    out = L.with_lines_dropped(docs, min_docs=2)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text, r.n_chars, r.row, r.kept) for r in out.collect())
    assert got == [(0, "b", 1, "r", 4), (1, "c", 1, "r", 4)]


def test_all_lines_dropped_leaves_empty_text(make_docs):
    out = L.with_lines_dropped(make_docs(["same\nsame", "same", None]), min_docs=2).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "", 0), (2, None, None)]


def test_a_row_repeated_often_is_no_large_group(spark):
    docs = spark.range(0, 30_000, 1, 4).selectExpr("CAST(7 AS LONG) AS doc_id", "'a\nb\na' AS text")
    gone = L.lines_to_drop(docs, "doc_id", "text", 10, 1, 4096).collect()
    assert [(r.id, sorted(r.gone)) for r in gone] == [(7, [0, 1, 2])]
    assert L.drop_repeated_lines(docs).filter("n_lines = 3 AND n_dropped = 3 AND kept = ''").count() == 30_000
