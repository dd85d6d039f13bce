"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks, dealt evenly and stored. Queries go to the workers in groups of bounded
size, one group at a time; a task scores its candidate blocks against the group's query blocks by matrix
products, so no vector is copied for a partner. Each round counts scores in a global histogram per
query, over the interval that still holds the query's kth highest score, and narrows the interval to
one bin; when bins are one score wide, the kth score is known. The last round keeps the rows that
reach it and breaks ties by id. Scores are made anew in each round, so none are stored.

A task adds only what can matter: scores below its own k best cannot be among the k best of all, so
it counts k scores per query at most, and in the last round gives its k best by score and id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stored
from tokenloom.sources.readers import spread

QUERY_BLOCK = 512
# Rows of a candidate block, and bytes of its vectors as longs.
CANDIDATE_BLOCK, BLOCK_BYTES = 4096, 1 << 21
# Queries, and bytes of their vectors as longs, that go to the workers at a time.
GROUP, GROUP_BYTES = 32_768, 1 << 24
BINS = 1024
# No score: below all scores, and its negative is above them.
OWN = np.iinfo(np.int64).min + 1
# A block's columns are looked at in stretches that end here, so that the first ones tell what can matter of the rest.
STRETCHES = (128, 1024)
# Scores of a query that may matter, in a stretch, above which its best are told apart before they are sorted.
DENSE = 64


def integer_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """id and vec: floor(scale * x) of each component as long. Rows with a null id or vector, an
    empty vector, or null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    usable = F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine
    return rows.filter(usable).select(F.col(id_column).cast("long").alias("id"), whole.alias("vec"))


def by_dimension(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the vectors: the length, the ids and the matrix of the rows that have it."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    begin, ids = np.cumsum(sizes) - sizes, ids.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, ids[rows], flat[begin[rows][:, None] + np.arange(dim)]


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest whole numbers that hold it."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def packed(rows: DataFrame) -> DataFrame:
    """Candidate blocks of vectors of one length: dim, the ids and the matrix as bytes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            """Blocks of what is held, down to fewer than ``least`` rows."""
            size = max(1, min(CANDIDATE_BLOCK, BLOCK_BYTES // (8 * dim)))
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            at = 0
            while len(ids) - at >= min(least, size):
                part = narrow(matrix[at : at + size])
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([dim], pa.int32()),
                        "c_id": pa.array([ids[at : at + size].tobytes()], pa.binary()),
                        "c_matrix": pa.array([part.tobytes()], pa.binary()),
                    }
                )
                at += size
            if at < len(ids):
                held[dim] = [(ids[at:], matrix[at:])]

        for batch in batches:
            for dim, ids, matrix in by_dimension(batch.column("id"), batch.column("vec")):
                held.setdefault(dim, []).append((ids, matrix))
                yield from blocks(dim, CANDIDATE_BLOCK)
        for dim in list(held):
            yield from blocks(dim, 1)

    return rows.select("id", "vec").mapInArrow(work, "dim int, c_id binary, c_matrix binary")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two matrices, in numbers that hold them exactly."""
    most = [max(-int(m.min(initial=0)), int(m.max(initial=0))) for m in (q, c)]
    bound = most[0] * most[1] * q.shape[1]
    # Whole numbers in floats are exact as long as no sum can reach the limit.
    for kind, limit in ((np.float32, 2**24), (np.float64, 2**53)):
        if bound < limit:
            return q.astype(kind) @ c.astype(kind).T
    return q.astype(np.int64) @ c.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best by score, then smaller id."""
    order = np.argsort(ids, kind="stable")
    k = min(k, scores.shape[1])
    by_id = scores[:, order]
    # Not by negated scores: the negative of OWN is OWN again.
    at = scores.shape[1] - k
    kth = np.partition(by_id, at, axis=1)[:, at : at + 1]
    above, level = by_id > kth, by_id == kth
    room = k - above.sum(axis=1, keepdims=True)
    keep = above | (level & (np.cumsum(level, axis=1) <= room))
    keep &= by_id != OWN
    row, column = np.nonzero(keep)
    return row, order[column]


class Best:
    """A task's best scores so far, k for each query of a block: ``scores``, highest first, and ``ids``.

    Scores count from the query's ``low`` on, up to below ``low + width`` if there is a width. Equal ones go to
    the smaller id if ``by_id``, else to any.
    """

    def __init__(self, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, width: int | None, by_id: bool):
        self.queries, self.matrix, self.low = block
        self.k, self.by_id = k, by_id
        self.high = np.full_like(self.low, np.iinfo(np.int64).max) if width is None else self.low + width
        self.scores = np.full((len(self.queries), k), OWN)
        self.ids = np.full((len(self.queries), k), np.iinfo(np.int64).max)
        # Scores above it can matter.
        self.floor = self.low - 1

    def add(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        scores = _scores(self.matrix, c)
        for begin, end in zip((0, *STRETCHES), (*STRETCHES, None), strict=True):
            if begin < len(c_ids):
                self.take(c_ids[begin:end], scores[:, begin:end])

    def take(self, c_ids: np.ndarray, scores: np.ndarray) -> None:
        floor, high = self.floor, self.high
        if scores.dtype != np.int64:
            # Bounds beyond all scores of the type say the same at its limit, where they are exact.
            limit = 2**24 if scores.dtype == np.float32 else 2**53
            floor, high = (np.clip(x, -limit, limit).astype(scores.dtype) for x in (floor, high))
        use = (scores > floor[:, None]) & (scores < high[:, None])
        n = np.count_nonzero(use)
        if not n:
            return
        if n > DENSE * len(use):
            use &= self.queries[:, None] != c_ids[None, :]
            kept = np.full(scores.shape, OWN)
            np.copyto(kept, scores, where=use, casting="unsafe")
            row, column = _best(kept, c_ids, self.k)
        else:
            row, column = np.nonzero(use)
            other = self.queries[row] != c_ids[column]
            row, column = row[other], column[other]
        some = np.unique(row)
        every = np.concatenate([row, np.repeat(some, self.k)])
        score = np.concatenate([scores[row, column].astype(np.int64), self.scores[some].ravel()])
        ids = np.concatenate([c_ids[column], self.ids[some].ravel()])
        order = np.lexsort((ids, -score, every))
        # Each of these queries has its k of before at least.
        first = np.searchsorted(every[order], some)
        order = order[first[:, None] + np.arange(self.k)]
        self.scores[some], self.ids[some] = score[order], ids[order]
        # An equal score can only matter by its id.
        self.floor[some] = np.maximum(self.low[some] - 1, self.scores[some, -1] - self.by_id)


def sent(queries: DataFrame) -> Broadcast:
    """One group of queries for the workers: for each length of vector, blocks of ids, matrix and low."""
    made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    rows = queries.select("id", "vec", "low").toArrow().combine_chunks()
    if rows.num_rows:
        vectors = rows["vec"].combine_chunks()
        place = pa.array(np.arange(rows.num_rows))
        ids, low = (rows[c].to_numpy() for c in ("id", "low"))
        for dim, at, matrix in by_dimension(place, vectors):
            made[dim] = [
                (ids[at[i : i + QUERY_BLOCK]], narrow(matrix[i : i + QUERY_BLOCK]), low[at[i : i + QUERY_BLOCK]])
                for i in range(0, len(at), QUERY_BLOCK)
            ]
    return queries.sparkSession.sparkContext.broadcast(made)


def best_of_task(batches: Iterable[pa.RecordBatch], queries: Broadcast, k: int, width: int | None, by_id: bool) -> Iterator[Best]:
    """The best scores of the candidate blocks of a task, for every block of queries."""
    made: dict[int, list[Best]] = {}
    for batch in batches:
        for dim, c_id, c_matrix in zip(*batch.columns, strict=True):
            dim, c_ids = dim.as_py(), np.frombuffer(c_id.as_buffer(), dtype=np.int64)
            if dim not in queries.value:
                continue
            data = c_matrix.as_buffer()
            c = np.frombuffer(data, dtype=f"i{data.size // (len(c_ids) * dim)}").reshape(-1, dim)
            if dim not in made:
                made[dim] = [Best(block, k, width, by_id) for block in queries.value[dim]]
            for best in made[dim]:
                best.add(c_ids, c)
    for bests in made.values():
        yield from bests


def histograms(candidates: DataFrame, queries: Broadcast, k: int, width: int, step: int) -> DataFrame:
    """Per query and bin of its interval (``width`` scores, ``step`` to a bin), the scores counted: query_id, bin, n. A task
    counts its k best of the interval."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for best in best_of_task(batches, queries, k, width, False):
            q, at = np.nonzero(best.scores != OWN)
            bins = (best.scores[q, at] - best.low[q]) // step
            keys, n = np.unique(q * BINS + bins, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"query_id": pa.array(best.queries[keys // BINS]), "bin": pa.array(keys % BINS), "n": pa.array(n.astype(np.int64))}
            )

    return candidates.mapInArrow(work, "query_id long, bin long, n long")


def narrowed(spans: DataFrame, counted: DataFrame, step: int) -> DataFrame:
    """Each query's interval after a round: the bin that holds the last score still wanted. A query
    with fewer scores than wanted keeps the interval's lower end."""
    total = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    reached = total.withColumn("upto", F.sum("n").over(down)).withColumnRenamed("query_id", "id")
    found = (
        spans.select("id", "low", "want")
        .join(reached, "id")
        .filter("upto >= want AND upto - n < want")
        .select("id", (F.col("low") + F.col("bin") * step).alias("to"), (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    )
    short = spans.join(found, "id", "left")
    return short.select("id", "vec", F.coalesce("to", "low").alias("low"), F.coalesce("left", "want").alias("want"))


def reaching(candidates: DataFrame, queries: Broadcast, k: int) -> DataFrame:
    """Scores that reach the query's kth, at most k of a task: query_id, vec_id, score."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for best in best_of_task(batches, queries, k, None, True):
            q, at = np.nonzero(best.scores != OWN)
            yield pa.RecordBatch.from_pydict(
                {"query_id": pa.array(best.queries[q]), "vec_id": pa.array(best.ids[q, at]), "score": pa.array(best.scores[q, at])}
            )

    return candidates.mapInArrow(work, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    k: int = 5,
    scale: int = 256,
) -> DataFrame:
    """For each query, its k highest scores: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x) of x as double; a score is the inner product of two such
    vectors, which must fit 63 bits. Queries are the rows whose id is divisible by ``every``;
    candidates are all rows but the query's own (rows with the same id count as its own). Equal
    scores go to the smaller id. With fewer than k candidates all are returned. Null ids, and
    vectors that are null, empty or hold null or non-finite components, take no part; vectors of
    different length are not compared. Repeated rows are candidates each, but one query. An empty
    table gives no row. Other columns are not read.
    """
    lanes = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = stored(integer_vectors(spread(vectors.select(id_column, vector)), id_column, vector, scale))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows, largest = whole.agg(F.count(F.lit(1)), F.max(norm)).first()
    # No inner product is larger than the largest squared length.
    limit = min(int(largest or 0) + 1, 2**62 - 1)
    candidates = stored(packed(whole.repartition(max(1, min(lanes, -(-rows // CANDIDATE_BLOCK))))))
    queries = stored(whole.filter(F.col("id") % every == 0).dropDuplicates(["id"]))
    count, size = queries.agg(F.count(F.lit(1)), F.sum(8 * F.size("vec"))).first()
    groups = max(1, -(-count // GROUP), -(-(size or 0) // GROUP_BYTES))
    found = []
    for group in range(groups):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == group)
        found.append(best_of_group(own, candidates, k, limit))
    every_group = found[0]
    for more in found[1:]:
        every_group = every_group.unionByName(more)
    return every_group


def best_of_group(queries: DataFrame, candidates: DataFrame, k: int, limit: int) -> DataFrame:
    """The k best of each query (id, vec), whose scores lie between ``-limit`` and ``limit``."""
    spans = queries.select("id", "vec", F.lit(-limit).cast("long").alias("low"), F.lit(k).cast("long").alias("want"))
    width = 2 * limit + 1
    while width > 1:
        step = -(-width // BINS)
        group = sent(spans)
        spans = stored(narrowed(spans, histograms(candidates, group, k, width, step), step))
        group.unpersist()
        width = step
    group = sent(spans)
    best = reaching(candidates, group, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    made = stored(ranked.select("query_id", "rank", "vec_id", "score"))
    group.unpersist()
    return made
