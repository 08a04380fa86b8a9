"""Golden micro-fixtures for the Column rules (text and arrays)."""

from pyspark.sql import functions as F

from packwright.functions import arrays as AR
from packwright.functions import text as T
from packwright.operators.tokens import strip_specials, tokens_to_string
from packwright.params import EOS_TOKEN


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {t}" for n, (v, t) in cols.items())
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], schema)
    return df.select(expr.alias("r")).first()["r"]


def test_segment_mask_reference_vector(spark):
    ids = [1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3, 0, 6]
    assert one(spark, AR.segment_mask("ids", 0), ids=(ids, "array<int>")) == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4]


def test_segment_mask_edges(spark):
    assert one(spark, AR.segment_mask("ids", 0), ids=([0, 0, 5], "array<int>")) == [1, 2, 3]
    assert one(spark, AR.segment_mask("ids", 0), ids=([5, 0], "array<int>")) == [1, 1]
    assert one(spark, AR.segment_mask("ids", 0), ids=([], "array<int>")) == []


def test_clean_text_on_literal_cases(spark):
    cases = [("  a \n  b\n\n\n c  ", "a\nb\nc"), ("\u3000x\xa0\n y ", "x\ny"), ("a\x1c\nb\x0b", "a\nb"),
             ("\n\n", ""), ("plain", "plain"), (" \x85z ", "z"), ("a b\n\tc d", "a b\nc d")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r["r"] for r in df.select(T.clean_text("t").alias("r")).collect()] == [w for _, w in cases]


def test_cut_tail_fixtures(spark):
    assert one(spark, T.cut_tail("t"), t=("x References\ny References\n\nz", "string")) == "x References\ny "
    assert one(spark, T.cut_tail("t"), t=("aCharts\n\nExternal links\n\n", "string")) == "a"
    assert one(spark, T.cut_tail("t"), t=("no markers", "string")) == "no markers"


def test_assemble_baike_rules(spark):
    secs = [("基本信息", " first line \n second"), ("截图", "  [1]\n"), ("简介", "tail\xa0\xa0标题")]
    row = spark.createDataFrame(
        [("标题", None, secs)], "title string, summary string, sections array<struct<title:string,content:string>>")
    got = row.select(T.assemble_baike("title", "summary", "sections").alias("r")).first()["r"]
    assert got == "标题-基本信息\nfirst line\nsecond标题-简介\ntail" + EOS_TOKEN


def test_assemble_baike_summary_and_empty(spark):
    row = spark.createDataFrame(
        [("T", "a long enough summary text", []), ("T", "short", [])],
        "title string, summary string, sections array<struct<title:string,content:string>>")
    got = [r["r"] for r in row.select(T.assemble_baike("title", "summary", "sections").alias("r")).collect()]
    assert got == ["T的简介:a long enough summary text" + EOS_TOKEN, EOS_TOKEN]


def test_prompt_text_and_placeholders(spark):
    df = spark.createDataFrame([("q", ""), ("q", "ctx")], "instruction string, input string")
    assert [r["r"] for r in df.select(T.prompt_text("instruction", "input").alias("r")).collect()] == ["q", "q\nctx"]
    assert one(spark, T.template_replace("t", [("<NAME>", "N"), ("<AUTHOR>", "A")]), t=("<NAME> by <AUTHOR>", "string")) == "N by A"


def test_padding_and_labels(spark):
    assert one(spark, AR.right_pad("a", 5, 0), a=([7, 8], "array<int>")) == [7, 8, 0, 0, 0]
    assert one(spark, AR.masked_labels("a", "b"), a=([1, 2], "array<int>"), b=([3], "array<int>")) == [-100, -100, 3]
    assert one(spark, AR.trained_count(AR.shifted_targets("a")), a=([-100, -100, 5, 6], "array<int>")) == 2


def test_truncate_at_eos(spark):
    assert one(spark, AR.truncate_at("a", 2, 10), a=([5, 2, 7], "array<int>")) == [5, 2]
    assert one(spark, AR.truncate_at("a", 2, 2), a=([5, 6, 7], "array<int>")) == [5, 6]


def test_special_token_wrapping(spark):
    assert one(spark, AR.wrap_specials("a", "b", bos=1, eos=2), a=([5], "array<int>"), b=([6, 7], "array<int>")) == [1, 5, 2, 1, 6, 7, 2]
    assert one(spark, AR.wrap_specials("a", "b"), a=([5], "array<int>"), b=([6], "array<int>")) == [5, 6]
    assert one(spark, AR.token_type_ids("a", "b", bos=1, eos=2), a=([5], "array<int>"), b=([6], "array<int>")) == [0, 0, 0, 1, 1, 1]


def test_attention_pairs(spark):
    # segments of 4, 4, 4, 1 -> 10 + 10 + 10 + 1
    assert one(spark, AR.attention_pairs("m"), m=([1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4], "array<int>")) == 31
    # 0/1 mask: keys j visible to every query i >= j
    assert one(spark, AR.attention_pairs("m"), m=([1, 1, 0], "array<int>")) == 3 + 2


def test_decode_rules(spark):
    toks = ["a", "<|endoftext|>", "<|startoftext|>", "b", "<unk>"]
    assert one(spark, tokens_to_string("t"), t=(toks, "array<string>")) == "a <|endoftext|><|startoftext|>b <unk>"
    assert one(spark, strip_specials("t"), t=(toks, "array<string>")) == ["a", "b"]


def test_clean_text_random_equivalence(spark):
    import random

    rnd = random.Random(7)
    alphabet = [" ", "\n", "\t", "\xa0", "　", "\x1c", "\x0b", " ", "a", "b", "。"]
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r["i"]: r["r"] for r in df.select("i", T.clean_text("t").alias("r")).collect()}
    from itertools import groupby

    def by_runs(text):
        """A run of white space with a line end in it is one line end; ends are trimmed."""
        out = []
        for space, run in groupby(text, str.isspace):
            run = "".join(run)
            out.append("\n" if space and "\n" in run else run)
        return "".join(out).strip()

    assert all(got[i] == by_runs(s) for i, s in enumerate(samples))


def test_chat_template_two_rows_like_the_reference_check(spark):
    from packwright.operators.examples import chat_blocks, system_block
    from packwright.params import DEFAULT

    rows = [("q1", "", "a1", [["u1", "r1"], ["u2", "r2"]]), ("q2", "", "a2", [])]
    df = spark.createDataFrame(rows, "instruction string, input string, output string, history array<array<string>>")
    got = [r.b for r in df.select(chat_blocks(DEFAULT).alias("b")).collect()]
    sys_ = system_block(DEFAULT)
    user = lambda t: f"\n<|startoftext|>user\n{t}<|endoftext|>\n<|startoftext|>assistant\n"
    first = [(b.text, b.trained) for b in got[0]]
    assert first == [(sys_ + user("u1"), False), ("r1<|endoftext|>", True), (user("u2"), False),
                     ("r2<|endoftext|>", True), (user("q1"), False), ("a1", True)]
    second = [(b.text, b.trained) for b in got[1]]
    assert second == [(sys_ + user("q2"), False), ("a2", True)]
