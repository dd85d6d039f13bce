"""Labelled samples of bounded size, and filtering whole rows by a scored text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut_batch


def remainder(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def labelled_ids(labels: DataFrame, label: str, parts: int, held: int, limit: int) -> DataFrame:
    """doc_id and y of at most ``limit`` labelled documents outside the held-out part, by the order
    of their ids' hashes."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(parts) != held))
    one = usable.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def unlabelled_ids(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id of at most ``limit`` documents, by the order of another hash; no label is read."""
    known = docs.filter("doc_id IS NOT NULL").select("doc_id")
    return known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(limit)


def keep_rows(docs: DataFrame, wanted: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The whole rows of ``docs`` whose text is wanted; columns stay as they are."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in cut_batch(batch, "text"):
                yield run.filter(pa.array(wanted(run.column("text")), pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
