"""Work on groups of any size without pulling one group into one task.

A key may hold a large share of all rows. Each helper counts rows per key first (a scan of the
key columns only). Keys within ``HOT_ROWS`` use a plain window. The others are range-partitioned
by key *and* order, so a hot key is spread over many tasks, and results are stitched together
from one summary row per key and range block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

HOT_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="tokenloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably, so that later jobs neither recompute it nor lose it."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    # Eager and reliable: the data outlives the executor that made it.
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > limit).drop("_n")


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys with more than ``limit`` rows (or None)."""
    hot = cut_lineage(hot_keys(df, keys, limit))
    if hot.isEmpty():
        return df, None
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def _direction(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add ``_block``, rising along ``order`` within each key; stored, so the blocks stay put."""
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *_direction(order))
    return cut_lineage(placed.withColumn("_block", F.spark_partition_id()))


def blocks_before(keys: Sequence[str]):
    """Window over the block summaries preceding a block."""
    return (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    out: str,
    total: str | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Sum ``value`` along ``order`` within each key, up to and including the row.

    ``order`` must be total (end it with an id), ``keys`` must not be null. ``total`` names an
    optional column for the sum over the whole key.
    """
    usual, hot = split_hot(df, keys, limit)
    ordering = _direction(order)
    whole = Window.partitionBy(*keys)
    rows = (Window.unboundedPreceding, Window.currentRow)
    done = usual.withColumn(out, F.sum(value).over(whole.orderBy(*ordering).rowsBetween(*rows)))
    if total:
        done = done.withColumn(total, F.sum(value).over(whole))
    if hot is None:
        return done

    placed = ordered_blocks(hot.withColumn("_value", value), keys, order)
    sums = placed.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(blocks_before(keys)), F.lit(0))
    offsets = sums.withColumn("_before", before)
    if total:
        offsets = offsets.withColumn(total, F.sum("_sum").over(whole))
    inside = Window.partitionBy(*keys, "_block").orderBy(*ordering).rowsBetween(*rows)
    rest = placed.join(offsets.drop("_sum"), [*keys, "_block"]).withColumn(
        out, F.sum("_value").over(inside) + F.col("_before")
    )
    return done.unionByName(rest.drop("_block", "_before", "_value"))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "rank",
    total: str | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each key 1..n along ``order``, with the group size if asked."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, total, limit)


def walk_in_order(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    schema: str,
    begin: Callable[[], object],
    step: Callable[[object, tuple], tuple],
) -> DataFrame:
    """Pass the rows of each key in order through ``step(state, row)``; its tuples are the result.

    For decisions that need the ones before them. Rows stream through the task in batches, so a key
    of any length takes the memory of its state only, and one job. ``row`` has the columns of ``df``.
    """
    at = df.columns.index(key)
    placed = df.repartition(key).sortWithinPartitions(key, *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[at] != current:
                    current, state = row[at], begin()
                made.append(step(state, row))
            columns = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    spark = df.sparkSession
    target = to_arrow_schema(spark.createDataFrame([], schema).schema)
    types, names = target.types, target.names
    return placed.mapInArrow(walk, schema)
