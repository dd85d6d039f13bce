"""Packing by concatenate and cut.

All documents form one stream of tokens that is cut every ``size`` tokens. The first pass encodes
each document once, writes its ids to the shared folder and notes the tokens in front of it within
its partition; the sum over the partitions before it gives its place in the whole stream. The second
pass cuts each document at the window borders. A window at a partition's end is completed by the
first documents of the next: each side gives its own boundary record, joined by the sequence's id.
Every window but the last is full, so padding is less than one window for the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WordIds, cut_batch, load_tokenizer, stored
from tokenloom.llm.words import Words, before_space

SIZE = 2048
END_ID = 1
# Rows that the second pass returns at a time.
PIECES = 20_000


SPACES = " \t\n\r\v\f"
# Sentence marks: the tokenizer takes none together with a letter, and no special token has one.
MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
LETTERS = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def words_and_marks(data: np.ndarray) -> np.ndarray:
    """Cut in front of white space and between an ASCII letter and a sentence mark."""
    cut = before_space(data)
    cut[1:] |= MARKS[data[1:]] & LETTERS[data[:-1]]
    return cut


class SpacedWordIds(WordIds):
    """Word table for a tokenizer that drops white space and case and marks the last piece of a word.

    New words of letters are encoded many at a time, as lines of one text; the marks tell where
    each ends.
    """

    def __init__(self, path: str, mark: str = "</w>"):
        super().__init__(path)
        vocabulary = load_tokenizer(path).get_vocab()
        self.last_piece = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last_piece[[i for piece, i in vocabulary.items() if piece.endswith(mark)]] = True

    def learn(self, words: Iterable[str]) -> None:
        if len(self) >= self.limit:
            self.turn()
        new = self.new(set(words))
        letters = [w for w in new if w.lower().isalpha()]
        for at in range(0, len(letters), 5_000):
            part = letters[at : at + 5_000]
            self.update(zip(part, self.lines(part), strict=True))
        rest = [w for w in new if not w.lower().isalpha()]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            self.update(zip(part, self.encode(part), strict=True))

    def lines(self, words: list[str]) -> list[bytes]:
        made = load_tokenizer(self.path).encode_batch_fast(["\n".join(words)], add_special_tokens=False)
        ids = np.array(made[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last_piece[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # a letter fell apart in lower case
            return self.encode(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def spaced_word_ids(path: str) -> SpacedWordIds:
    return SpacedWordIds(path)


def token_ids(texts: pa.Array, tokenizer: str, end_id: int | None = END_ID) -> list[bytes]:
    """Ids of each text and the end id, for a tokenizer that drops white space: a text's ids are
    those of its words, one after another. Each distinct word is encoded once."""
    table = spaced_word_ids(tokenizer)
    # Capitals are alike to the tokenizer, but for the strings of special tokens.
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring(texts, "<|")
    words = Words(pc.if_else(odd, texts, pc.ascii_lower(texts)), words_and_marks)
    bare = [w.strip(SPACES) for w in words.distinct]
    table.learn(bare)
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    return [x.tobytes() + end for x in words.joined([table[w] for w in bare])]


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """First pass, written to the shared folder: doc_id, ids, n_tokens, and its place: the partition
    it was encoded in and the tokens before it there."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for run in cut_batch(batch, "text"):
                ids = token_ids(run.column("text"), tokenizer, end_id)
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = before + np.cumsum(counts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": run.column("doc_id"),
                        "ids": pa.array(ids, pa.binary()),
                        "n_tokens": pa.array(counts),
                        "part": pa.array(np.full(len(ids), part, dtype=np.int64)),
                        "before": pa.array(ends - counts),
                    }
                )
                before = int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary, n_tokens long, part long, before long"
    return stored(docs.select("doc_id", "text").mapInArrow(work, schema))


def global_offsets(encoded: DataFrame) -> DataFrame:
    """Add ``at``, the tokens of all documents before a row: the partitions' totals are summed
    along, then the tokens before the row in its own partition are added.

    The summed table has one row per partition that was encoded.
    """
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    # One row for each task of the first pass.
    return encoded.join(F.broadcast(starts), "part").withColumn("at", F.col("first") + F.col("before"))


def cut_windows(placed: DataFrame, size: int = SIZE) -> DataFrame:
    """Second pass: the pieces of each document between window borders, with their ids."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, blobs = batch.column("doc_id"), batch.column("ids")
            counts = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            at = batch.column("at").to_numpy(zero_copy_only=False)
            # A document without tokens has no piece.
            pieces = np.where(counts > 0, (at + counts - 1) // size - at // size + 1, 0)
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            window = at[row] // size + nth
            first = np.maximum(window * size, at[row])
            last = np.minimum((window + 1) * size, at[row] + counts[row])
            start, length = first - at[row], last - first
            for k in range(0, len(row), PIECES):
                s = slice(k, k + PIECES)
                data = []
                for r, a, n in zip(row[s].tolist(), start[s].tolist(), length[s].tolist(), strict=True):
                    data.append(blobs[r].as_buffer().slice(4 * a, 4 * n).to_pybytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": doc_ids.take(pa.array(row[s])),
                        "start": pa.array(start[s], pa.int64()),
                        "length": pa.array(length[s], pa.int64()),
                        "ids": pa.array(data, pa.binary()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64()),
                        "doc_tokens": pa.array(counts[row[s]], pa.int64()),
                        "sequence_id": pa.array(window[s], pa.int64()),
                        "offset": pa.array(first[s] - window[s] * size, pa.int64()),
                    }
                )

    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return placed.select("doc_id", "ids", "n_tokens", "at").mapInArrow(work, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int | None = END_ID) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``size`` tokens; one row per piece.

    Columns: doc_id, start (its document's tokens before it), length, ids (32-bit little-endian),
    ids_crc32, doc_tokens, sequence_id, offset (in the sequence, without gaps). A null or empty text
    has the end id alone; repeated rows are packed each; null ids are kept; an empty table gives no
    row. Other columns are not read. The order of documents in the stream is that of the partitions
    read, so it may differ between runs; each run's result is whole and consistent.
    """
    return cut_windows(global_offsets(encode_partitions(docs, tokenizer, end_id)), size)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, doc_ids and ids, in order of offset.

    A group has at most as many rows as a sequence has tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        pieces.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
            F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
            F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex"),
        )
        .select("sequence_id", "n_tokens", "doc_ids", F.unhex("hex").alias("ids"))
    )
