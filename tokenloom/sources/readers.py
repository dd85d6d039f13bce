"""Reads with contract checks: good rows, and rejected rows with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
ROLES = ("user", "assistant", "system")
MODES = ("lossless", "aggressive")
MAX_TEXT_CHARS = 50_000
# --- end of fixed values ------------------------------------------------------------------------


def partition_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    return good, checked.filter(F.col("reason").isNotNull())


def read_conversations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages need an id, a role of three and a text."""
    reason = (
        F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), "missing_position")
        .when(F.col("role").isNull(), "missing_role")
        .when(~F.col("role").isin(*ROLES), "unknown_role")
        .when(F.col("text").isNull(), "missing_text")
    )
    return partition_by_reason(df, reason)


def read_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optimise requests (``conv_id, query, mode``): a query and a known mode."""
    query = F.trim(F.coalesce("query", F.lit("")))
    mode = F.coalesce("mode", F.lit(MODES[0]))
    reason = F.when(query == "", "missing_query").when(~mode.isin(*MODES), "unknown_mode")
    good, bad = partition_by_reason(df, reason)
    return good.withColumn("query", query).withColumn("mode", mode), bad


def content_text(content: Column) -> Column:
    """Message content as text: a JSON list of blocks gives its text blocks, line by line."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(
        F.filter(blocks, lambda b: b["type"] == "text"),
        lambda b: F.coalesce(b["text"], F.lit("")),
    )
    is_list = content.startswith("[") & blocks.isNotNull()
    return F.when(is_list, F.array_join(texts, "\n")).otherwise(F.coalesce(content, F.lit("")))


def request_text(df: DataFrame) -> DataFrame:
    """The text of a request body: ``messages`` is an array of (role, content).

    Content that is a list of blocks contributes its text blocks; other values nothing.
    """
    texts = F.transform("messages", lambda m: content_text(m["content"]))
    return df.withColumn("text", F.array_join(texts, "\n"))


def read_corpus(
    df: DataFrame, text: str = "text", max_chars: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Texts, up to ``max_chars`` if given; longer ones are rejected whole, never cut.

    A service's contract has ``MAX_TEXT_CHARS``.
    """
    reason = F.when(F.col(text).isNull(), "missing_text")
    if max_chars is not None:
        reason = reason.when(F.length(text) > max_chars, "text_too_long")
    return partition_by_reason(df, reason)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small input arrives in fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
