"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is heavy per byte: let small shuffles keep as many tasks as there are cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ranks up to this limit are cut before the shuffle, which keeps hot groups small.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}

# Only possible when the session starts. Recording the call site of every column call costs
# more than the calls, and plans here are long.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "tokenloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; a cluster's own settings win when already set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that a session built elsewhere leaves open."""
    given = spark._jsparkSession.sessionState().conf()
    for key, value in SETTINGS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark
