"""Event tables, keyed upserts, feedback and key rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources.readers import partition_by_reason

# --- fixed values: event tables and their columns ---------------------------------------------
EVENT_TABLES = {
    "compression_events": "api_key string, original_tokens long, compressed_tokens long, "
    "pct_saved long, mode string, platform string",
    "context_events": "api_key string, mode string, original_tokens long, optimized_tokens long, "
    "tokens_saved long, messages_total long, messages_pruned long, summary_tokens long, "
    "platform string",
    "tool_call_events": "api_key string, tool_name string, tier string, tool_session_id string, "
    "original_tokens long, compressed_tokens long, pct_saved long, cache_hit boolean",
    "chat_events": "session_id string, user_message string, bot_response string",
    "sensitive_events": "session_id string, api_key string, categories array<string>, "
    "risk_level string",
    "feedback": "original string, compressed string, rating int, comment string",
}
INACTIVE = ("canceled", "unpaid", "past_due")
# --- end of fixed values ------------------------------------------------------------------------


def event_columns(df: DataFrame, table: str, ts: str = "created_at") -> DataFrame:
    """``df`` in the table's columns and types, with its day for partitioning."""
    if table not in EVENT_TABLES:
        raise ValueError(f"unknown event table {table!r}")
    schema = df.sparkSession.createDataFrame([], EVENT_TABLES[table]).schema
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    stamp = F.col(ts).cast("timestamp").alias("created_at")
    return df.select(*columns, stamp, F.to_date(ts).alias("day"))


def append_events(df: DataFrame, table: str, folder: str, ts: str = "created_at") -> None:
    """Append to ``folder/table``, one directory per day."""
    rows = event_columns(df, table, ts)
    rows.write.mode("append").partitionBy("day").parquet(f"{folder}/{table}")


def append_event_stream(
    stream: DataFrame, table: str, folder: str, checkpoint: str, ts: str = "created_at"
):
    """The same for a stream; the caller keeps the checkpoint folder."""
    return (
        event_columns(stream, table, ts)
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", f"{folder}/{table}")
        .option("checkpointLocation", checkpoint)
    )


def read_events(spark: SparkSession, table: str, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def check_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings from 1 to 5; everything else is set aside."""
    reason = F.when(
        F.col("original").isNull() | F.col("compressed").isNull(), "missing_text"
    ).when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "rating_out_of_range")
    return partition_by_reason(df, reason)


def append_feedback(df: DataFrame, folder: str, ts: str = "created_at") -> DataFrame:
    """Append the valid feedback and return the rest."""
    good, bad = check_feedback(df)
    append_events(good, "feedback", folder, ts)
    return bad


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; the partial maximum keeps one row per key and task."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(
        *keys, "_row.*"
    ).select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``current`` with ``changes`` applied; a later write wins, on a tie the change does."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_by_key(both, keys, [*order, "_new"]).drop("_new")


def upsert_stream(folder: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` handler: each batch writes the next version of the table.

    Version ``n`` is built from the highest finished version below ``n``, so a repeated batch after
    a failure rebuilds the same version from the same input. Versions below that one are removed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = latest_by_key(batch, keys, order)
        earlier = [v for v in _versions(spark, folder) if v < batch_id]
        if earlier:
            latest = upsert(spark.read.parquet(f"{folder}/version={earlier[-1]}"), latest, keys, order)
        latest.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        for old in earlier[:-1]:
            _delete(spark, f"{folder}/version={old}")

    return apply


def _path(spark: SparkSession, name: str):
    """A path and its file system, wherever the table is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions, oldest first: those with the mark that Spark leaves on success."""
    path, files = _path(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    versions = [n for n in names if n.startswith("version=")]
    done = [n for n in versions if files.exists(_path(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return sorted(int(n.removeprefix("version=")) for n in done)


def _delete(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def read_upserted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={_versions(spark, folder)[-1]}")


def subscription_status(event: Column) -> Column:
    """Account status after a billing event."""
    return F.when(event.isin(*INACTIVE), F.lit("canceled")).otherwise(F.lit("active"))


def rotate_keys(keys: DataFrame, rotations: DataFrame) -> DataFrame:
    """Replace old keys by new ones (``old_key, new_key``); savings stay with the account row."""
    changed = rotations.select(F.col("old_key").alias("api_key"), "new_key")
    columns = [
        F.coalesce("new_key", "api_key").alias("api_key") if c == "api_key" else F.col(c)
        for c in keys.columns
    ]
    return keys.join(changed, "api_key", "left").select(*columns)
