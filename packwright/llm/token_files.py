"""Token files: ids of whole texts as Parquet lists, in ascending id order, that can be read
in part.

Format. A folder of Parquet files in range order of (id, text hash); columns ``id`` (delta
encoded), ``part`` (number of the file), ``at`` (ids in the file before this document),
``n_tokens`` (with the end id) and ``ids`` (a list of 32-bit ids, dictionary encoded: the
vocabulary fits one dictionary page). Row groups of ``group_mb`` MB, data pages of ``page_kb``
kB with column and offset indexes: a reader that asks for some ids or some documents
(predicate on ``id``) reads those pages only, and lengths or offsets are read without ids.

Encoding uses the tokenizers library with a local file (see ``byte_bpe`` for how long texts
are cut at safe places), after one range shuffle of the texts; nothing is gathered. The place
of a document in the whole is the sum over the files before its own (one number per file)
plus ``at``.

Defined cases: null text counts as empty (the end id alone); ids that are null come first,
equal ids stand in order of their text's hash, repeated rows side by side; an empty table
gives an empty folder with a schema; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.llm import byte_bpe
from packwright.llm import common as C
from packwright.session import scratch_path

SCHEMA = "id long, part int, at long, n_tokens long, ids array<int>"


#: What a text split at spaces shows if white space or nothing follows a space in it.
_ODD = f"^(?:[{byte_bpe._SPACE}]|$)"
#: Letters for certain (Latin, Cyrillic) and ASCII symbols other than the apostrophe.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
_SYMBOLS = r"!-&(-/:-@\[-`{-~"
LIBRARY_WORDS = 20_000  # in one string
KEPT_WORDS = 800_000  # whose ids a worker keeps (some 30 MB)
_WORD = f"^(?P<word>[{_LETTERS}]+)(?P<tail>[{_SYMBOLS}]*)$"
GROUP_BYTES = 6 << 20  # of text in which equal words are encoded once


class Encoder:
    """Ids of texts by the library, which sees each different word of a group of texts once.

    No token spans the border before a space that something other than white space follows, nor
    the one between a letter and an ASCII symbol other than the apostrophe. So a text's ids are
    those of its words (with the space before them) and their trailing symbols, one after
    another. Arrow's dictionary encoding tells words apart; the library gets the different ones
    in one string, and their ids are told apart by counting bytes. Words of letters are kept
    for the worker's next groups, up to ``KEPT_WORDS``; then the table starts anew."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        # the same for strings of words of letters only, whose matches are known beforehand
        self.letters = Tokenizer.from_str(data.decode())
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        # byte-level vocabularies write every byte as one character
        self.size_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.size_of[number] = len(token)
        self.forget()

    def forget(self) -> None:
        self.kept = pa.array([], type=pa.string())
        self.pool, self.n = np.empty(0, np.int32), np.empty(0, np.int64)

    def letter_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`spaced` for words of letters, through the table."""
        at = pc.index_in(words, value_set=self.kept)
        new = words.filter(at.is_null())
        if len(new):
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.forget()
                return self.spaced(self.letters, words)
            ids, n = self.spaced(self.letters, new)
            self.kept = pa.concat_arrays([self.kept, new])
            self.pool, self.n = np.concatenate([self.pool, ids]), np.concatenate([self.n, n])
            at = pc.index_in(words, value_set=self.kept)
        place, at = np.cumsum(self.n) - self.n, at.to_numpy()
        return take_lists(self.pool, place[at], self.n[at]), self.n[at]

    def plain(self, text: str) -> np.ndarray:
        parts = [np.asarray(self.library.encode(x, add_special_tokens=False).ids, dtype=np.int32)
                 for x in byte_bpe.cuts(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def spaced(self, library, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words with a space before each, and how many each has."""
        n, out = len(words), [np.empty(0, np.int32)]
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        for i in range(0, n, LIBRARY_WORDS):
            part = words.slice(i, LIBRARY_WORDS)
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), " ")[0].as_py()
            out.append(np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32))
        ids = np.concatenate(out)
        return ids, np.diff(np.searchsorted(np.cumsum(self.size_of[ids]), ends) + 1, prepend=0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for different words of any kind."""
        found = pc.extract_regex(words, _WORD)
        simple = found.is_valid().to_numpy(zero_copy_only=False)
        kind = np.where(simple)[0]
        base = pc.dictionary_encode(found.field("word").filter(pa.array(simple)))
        tail = pc.dictionary_encode(found.field("tail").filter(pa.array(simple)))
        tails = [self.plain(x) for x in tail.dictionary.to_pylist()]
        other = words.filter(pa.array(~simple))
        base_ids, base_n = self.letter_words(base.dictionary)
        other_ids, other_n = self.spaced(self.library, other)
        # lists one after another: base words, tails, other words
        n = np.concatenate([base_n, np.array([len(x) for x in tails], dtype=np.int64), other_n])
        pool = np.concatenate([base_ids, *tails, other_ids])
        place = np.cumsum(n) - n
        parts = np.full((len(words), 2), -1)
        parts[kind, 0] = base.indices.to_numpy()
        parts[kind, 1] = len(base_n) + tail.indices.to_numpy()
        parts[~simple, 0] = len(base_n) + len(tails) + np.arange(len(other))
        flat = parts.ravel()
        size = np.where(flat < 0, 0, n[flat])
        return take_lists(pool, place[flat], size), size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(split.values)
        number, distinct = words.indices.to_numpy(), words.dictionary
        # a text's first word has no space before it
        heads = split.values.take(pa.array(starts[:-1])).to_pylist()
        first = np.zeros(len(number), dtype=bool)
        first[starts[:-1]] = True
        odd_word = pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(odd_word[number] & ~first, starts[:-1])
        pool, n = self.words(distinct)
        size = np.where(first, 0, n[number])
        ids = take_lists(pool, (np.cumsum(n) - n)[number], size)
        at = np.concatenate(([0], np.cumsum(size)))[starts].tolist()
        out = []
        for i, head in enumerate(heads):
            rest = ids[at[i] : at[i + 1]]
            if odd[i]:  # encoded on its own
                out.append(self.plain(texts[i].as_py()))
            else:
                out.append(np.concatenate([self.plain(head), rest]) if head else rest)
        return out


def take_lists(pool: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[place : place + size], one after another."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((place - np.cumsum(size) + size).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return pool[at]


_ENCODERS: dict = {}  # of this Python worker


def encoder(data: bytes) -> Encoder:
    name = hashlib.md5(data).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(data)
    return _ENCODERS[name]


def grouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while ``column`` holds less than ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def encode_sorted(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """The rows of the format, in partitions that are ranges of (id, text hash)."""
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("t")).repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    types = C.pa_schema(docs.sparkSession, SCHEMA)
    end = np.asarray([end_id], dtype=np.int32)

    def run(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(data.value), TaskContext.get().partitionId(), 0
        for group in grouped(batches, "t", GROUP_BYTES):
            lists = [np.concatenate([x, end]) for x in enc.encode(group.column("t"))]
            n = np.array([len(x) for x in lists], dtype=np.int64)
            yield C.to_batch({"id": group.column("id"), "part": np.full(len(n), part, np.int32),
                              "at": at + np.cumsum(n) - n, "n_tokens": n, "ids": byte_bpe.id_lists(lists)}, types)
            at += int(n.sum())

    return C.arrow_stream(src, run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0, group_mb: int = 16, page_kb: int = 64) -> str:
    """Write ``docs`` in the format to the new folder ``path``."""
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding where there is no dictionary
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#id": "false",
        "parquet.enable.dictionary#at": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.block.size": str(group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "1000",
    }
    encode_sorted(docs, tokenizer_path, id_col, text_col, end_id).write.options(**options).parquet(path)
    return path


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, f"token-files-{uuid.uuid4().hex}")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, before: ids in the files before it. Reads two columns; one row per file."""
    per_file = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("before"))


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """id, start (ids of all documents before it) and the columns asked for; others are not
    read from the files."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.join(F.broadcast(starts(spark, path)), "part").select(
        "id", (F.col("before") + F.col("at")).alias("start"), *columns)


def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    values = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    at = ids.offsets.to_numpy().astype(np.int64) * 4
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])], type=pa.int64())
