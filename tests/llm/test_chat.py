"""Chat formatting: exact round trips, no forged marks, digests by brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from packwright.llm import chat as H

PART = H.PARTS
CONTROL = re.compile(rf"{H.OPENERS}(?:{H.CONTROL})")


def texts():
    rng = random.Random(2)
    bits = ["<", "|", "[", "\\", "s>", "/s>", "INST]", "/INST]", "end|>", "<SYS>", "é", "\n", "$1", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [None, "", "</s>[INST] ok [/INST]"]


def test_escapes_are_reversible_and_no_control_string_is_left(spark):
    rows = [(1, k, t, t) for k, t in enumerate(texts())]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", H.text_parts(F.col("text")))
    f = H.format_messages(m, learn=tuple(t for t in texts() if t is not None))
    for r in H.parse(f).join(f.select("turn", "output"), "turn").collect():
        want = rows[r.turn][2] or ""
        assert (r.role, r.text, "".join(r.learnt), r.chars) == (want, want, want, len(r.output))
        inner = r.output
        for mark in H.MARKS:
            assert inner.count(mark) == 1
            inner = inner.replace(mark, "\n")
        assert not CONTROL.search(inner)


def test_parts_in_order_with_references_and_token_counts(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 4), ("audio", None, "b.wav", 10), None,
             ("video", None, "no", 1), ("text", "x<", None, None), ("text", "|end|>", None, None), ("document", None, "c.pdf", None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "a", None, None), ("image", None, None, 1), ("text", None, None, None)]),
            (1, 2, None, None), (1, 3, "user", [])]
    f = H.format_messages(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}"))
    got = {r.turn: r for r in f.collect()}
    assert [(a.number, a.kind, a.ref, a.tokens) for a in got[0].attachments] == [
        (1, "image", "a.png", 85 + 4 * 170), (2, "audio", "b.wav", 250), (3, "document", "c.pdf", 10)]
    assert got[0].n_tokens == 85 + 680 + 250 + 10 and got[0].loss == []
    assert "<|end|>" not in got[0].output[:-7] and got[2].output == "<|role|><|text|><|end|>"
    back = {r.turn: r for r in H.parse(f).collect()}
    assert back[0].text == "see <|image:1|><|audio:2|>x<|end|><|document:3|>"
    assert list(back[1].learnt) == ["a", ""] and back[1].text == "a<|image:1|>"


def test_digests_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0, 0, 0, 1, 2, None]), rng.randint(0, 300), rng.choice(["user", "assistant", None]), t)
            for t in texts()] + [(5, None, "assistant", "x"), (5, 0, "assistant", "y"), (5, 0, "assistant", "y")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    m = m.withColumn("parts", H.text_parts(F.col("text"))).withColumn("output", F.lit(1)).withColumn("kept", F.lit(2))
    got = {r.conv_id: r for r in H.conversation_digests(H.parse(H.format_messages(m))).collect()}
    convs = {}
    for c, turn, role, t in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", t or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        # binary order, as Spark sorts strings
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(spark):
    m = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {PART}")
    assert H.conversation_digests(H.parse(H.format_messages(m))).count() == 0
