"""Token files and byte-level BPE against the libraries on whole texts, and exact round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packwright.llm import byte_bpe as B
from packwright.llm import token_files as T

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    alphabet = "ab Z9é ß  \n\t.,'!\x1c\x85日本🙂́|<>"
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return mixed + [None, "", " ", "  ", "\n\n a", "a  b ", "don't we'll 'sx !'s", "<|endoftext|> x", "same", "same",
                    "x" * 50_000, "ab" * 30_000 + " " * 5_000 + "end", "word " * 20_000, "!" * 3000, " \n" * 3000 + "q"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_texts_are_cut_only_where_tokens_end(texts):
    lib = library()
    for t in texts:
        for size in (1, 7, 1000):
            parts = list(B.cuts(t or "", size))
            assert "".join(parts) == (t or "")
            if len(parts) < 3000:
                assert [x for p in parts for x in lib.encode_ordinary(p)] == lib.encode_ordinary(t or "")


def test_encode_as_the_library_and_decode_back(make_docs, texts):
    lib = library()
    enc = B.encode(make_docs(texts, 5).withColumn("ids", F.lit(1)), RANKS, P.PATTERN)
    got = {r.id: r for r in B.decode(enc, RANKS).collect()}
    assert len(got) == len(texts)
    both = {r.id: r for r in B.round_trip(make_docs(texts, 5), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == list(both[i].ids) == lib.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == bytes(both[i].decoded) == (t or "").encode()


def test_decode_gives_raw_bytes(spark):
    lib = library()
    ids = lib.encode_ordinary("🙂")
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "id long, ids array<int>")
    got = {r.id: r.decoded for r in B.decode(df, RANKS).collect()}
    assert bytes(got[1]) == lib.decode_bytes(ids[:1]) and got[2] is None and bytes(got[3]) == b""


@pytest.mark.parametrize("kept", [10, 800_000])
def test_group_encoder_is_the_library(texts, kept, monkeypatch):
    import pyarrow as pa

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    monkeypatch.setattr(T, "KEPT_WORDS", kept)
    enc = T.Encoder(open(JSON, "rb").read())
    rng = random.Random(1)
    words = ["word", "Word,", "naïve...", "l'été", "don't!", "x'", "a1", "12.", "(b)", "Привет!", "日本,", "…,", "×!", "ŉ?", "\n\nq", "--"]
    more = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for group in (texts, more, [" " + t for t in more], more[:5], texts[:1], []):
        got = enc.encode(pa.array(group, type=pa.string()))
        assert [x.tolist() for x in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in group]
        assert len(enc.kept) <= kept


def test_token_files_round_trip(spark, make_docs, texts, tmp_path):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    docs = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "null id"), (1000, "twice")]
    path = T.write(make_docs(docs, 4).withColumn("part", F.lit("x")), str(tmp_path / "f"), JSON, end_id=0)
    rows = T.read(spark, path).select("*", F.arrow_udf(T.ids_crc32, "long")("ids").alias("crc")).orderBy("start").collect()
    ids = [r.id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(rows) == len(docs)
    left, start = list(docs), 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        match = [d for d in left if d[0] == r.id and tok.encode(d[1] or "", add_special_tokens=False).ids + [0] == list(r.ids)]
        assert match
        left.remove(match[0])
        assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += len(r.ids)
    assert not left


def test_selective_reads_and_file_layout(spark, make_docs, tmp_path):
    import pyarrow.parquet as pq

    path = T.write(make_docs([f"text number {k} " * 40 for k in range(3000)], 6), str(tmp_path / "f"), JSON, page_kb=4)
    files = sorted(tmp_path.glob("f/part-*.parquet"))
    metas = [pq.ParquetFile(f).metadata for f in files]
    ends = []
    for m in metas:
        g = m.row_group(0)
        cols = {g.column(c).path_in_schema: g.column(c) for c in range(g.num_columns)}
        assert cols["id"].has_column_index and cols["id"].has_offset_index
        assert "DELTA_BINARY_PACKED" in cols["id"].encodings
        assert any("DICTIONARY" in e for e in cols["ids.list.element"].encodings)
        ends.append((cols["id"].statistics.min, cols["id"].statistics.max))
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))  # files are ranges of ids
    only = T.read(spark, path, columns=("n_tokens",))
    assert "ids" not in only._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert [r.id for r in T.read(spark, path).filter("id between 700 and 702").orderBy("id").collect()] == [700, 701, 702]


def test_empty_table(spark, make_docs, tmp_path):
    path = T.write(make_docs([]), str(tmp_path / "f"), JSON)
    assert T.read(spark, path).count() == 0
    assert B.decode(B.encode(make_docs([]), RANKS, P.PATTERN), RANKS).count() == 0
