"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tokenloom.plans.groups import checkpoint_folder

# Characters of text that a task works on at a time.
RUN_CHARS = 8_000_000
# Entries of a generation of a Python worker's word table, which holds two: bounds its memory.
TABLE_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it outlives the executors that made it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tokenloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_runs(
    df: DataFrame,
    columns: list[str],
    schema: str,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | dict],
    text: str | None = "text",
) -> DataFrame:
    """Apply ``work`` to runs of rows holding at most about ``RUN_CHARS`` characters of ``text``, or to
    whole batches if it is None.

    Only ``columns`` reach Python, so other columns of ``df`` may have any name.
    """

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in cut_batch(batch, text) if text else [batch]:
                made = work(run)
                if isinstance(made, dict):
                    made = pa.RecordBatch.from_pydict(made)
                if made.num_rows:
                    yield made

    return df.select(*columns).mapInArrow(runs, schema)


def cut_batch(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``RUN_CHARS`` bytes of text, one row at least."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > RUN_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


class Table(dict):
    """A word table of bounded size: entries are made when first asked for.

    When it is full it starts anew, but keeps the last generation's entries at hand, so that words
    in use are not made again.
    """

    def __init__(self, make: Callable[[str], object], limit: int = TABLE_WORDS):
        super().__init__()
        self.make, self.limit, self.last = make, limit, {}

    def __missing__(self, word):
        value = self.last.get(word)
        if value is None:
            value = self.make(word)
            if len(self) >= self.limit:
                self.turn()
        self[word] = value
        return value

    def new(self, words: Iterable[str]) -> list[str]:
        return [w for w in words if w not in self and w not in self.last]

    def turn(self) -> None:
        self.last = dict(self)
        self.clear()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of the ``tokenizers`` library at ``path``, one thread, no truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordIds(Table):
    """Distinct-word table: each distinct word is encoded once, its ids kept as 32-bit little-endian bytes."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        super().__init__(lambda word: self.encode([word])[0], limit)
        self.path = path

    def encode(self, words: list[str]) -> list[bytes]:
        import numpy as np

        made = load_tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words of a run that are new, all at once."""
        if len(self) >= self.limit:
            self.turn()
        new = self.new(set(words))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.update(zip(part, self.encode(part), strict=True))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """The worker's table for a tokenizer."""
    return WordIds(path)
