"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` gives each text's ids exactly as the library's ``encode_ordinary`` does; ``decode``
gives the raw bytes of ids (which need not be valid UTF-8 on their own).

Long texts are cut before white space that follows other characters. Every match of the
pattern ends there, so the ids of the parts, one after another, are the ids of the text.
The ranks are read once on the driver and broadcast (one vocabulary file, about 1 MB).

Defined cases: null and empty texts have no ids; strings of special tokens are ordinary text;
null ids decode to null; an id outside the vocabulary is an error; repeated rows and null or
repeated row ids are kept as they are; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

#: White space as the pre-tokenization patterns of these vocabularies know it (Unicode
#: White_Space). Fixed values.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a text may be cut: white space after something else.
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
LONG = 1 << 16  # characters handed to the library at once, to the next cut


def cuts(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that end where a match must end."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_LIBRARIES: dict = {}  # of this Python worker


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def library(data: bytes, pattern: str):
    import tiktoken

    name = hashlib.md5(data + pattern.encode()).hexdigest()
    if name not in _LIBRARIES:
        _LIBRARIES[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _LIBRARIES[name]


def encode_text(lib, text: str) -> np.ndarray:
    parts = [np.asarray(lib.encode_ordinary(x), dtype=np.int32) for x in cuts(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def id_lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrow lists of 32-bit ids."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of every row."""
    data = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(b: pa.RecordBatch) -> dict:
        lib = library(data.value, pattern)
        return {"id": b.column("id"), "ids": id_lists([encode_text(lib, t or "") for t in b.column("t").to_pylist()])}

    return C.arrow_map(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids and decoded (the bytes that the ids, and nothing else, decode to) of every row:
    :func:`encode` and :func:`decode` in one Python step, so a task needs one worker."""
    data = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(b: pa.RecordBatch) -> dict:
        lib, back = library(data.value, pattern), worker_decoder(data.value)
        ids = [encode_text(lib, t or "") for t in b.column("t").to_pylist()]
        return {"id": b.column("id"), "ids": id_lists(ids), "decoded": [back(x.tolist()) for x in ids]}

    return C.arrow_map(src, run, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")


def worker_decoder(data: bytes) -> Callable[[list[int]], bytes]:
    name = hashlib.md5(data).hexdigest()
    if name not in _DECODERS:
        _DECODERS[name] = decoder(data)
    return _DECODERS[name]


def decoder(data: bytes) -> Callable[[list[int]], bytes]:
    tokens = {rank: token for token, rank in ranks_of(data).items()}
    return lambda ids: b"".join(map(tokens.__getitem__, ids))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids."""
    C.ready(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(ids: pa.Array) -> pa.Array:
        back = worker_decoder(data.value)
        return pa.array([None if x is None else back(x) for x in ids.to_pylist()], type=pa.binary())

    return encoded.withColumn(out_col, F.arrow_udf(run, "binary")(F.col(ids_col)))


_DECODERS: dict = {}  # of this Python worker
