"""Streams over several files, against the batch result on the same rows."""

from pyspark.sql import functions as F

from tokenloom.catalog.stream_queries import drain, drain_updates
from tokenloom.operators import context as C
from tokenloom.operators import usage as U
from tokenloom.sources import sinks
from tokenloom.streaming import stateful as S


def in_files(spark, df, column, folder, n=3):
    """Write ``df`` in ``n`` files along ``column`` and open them one per micro-batch."""
    bounds = df.approxQuantile(column, [i / n for i in range(n + 1)], 0.0)
    for i in range(n):
        upper = F.col(column) < bounds[i + 1] if i < n - 1 else F.lit(True)
        part = df.filter((F.col(column) >= bounds[i]) & upper)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(
        map(tuple, b.select(columns).collect()), key=repr
    )


def log(spark):
    return spark.range(400).select(
        F.col("id").alias("call_id"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("session_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 50 + (F.col("id") % 5) * 7).alias("ts"),
        F.when(F.col("id") % 11 == 0, (F.col("id") % 4).cast("int")).alias("n_tools"),
        (F.col("id") % 53 == 0).alias("is_clear"),
    )


def test_tool_cache_stream(spark, tmp_path):
    df = log(spark)
    stream = in_files(spark, df, "call_id", tmp_path / "in")
    batch = U.tool_cache(df, 360).drop("ts")
    same(drain(S.stream_tool_cache(stream, 360)), batch)


def test_limits_stream(spark, tmp_path):
    df = log(spark).select(F.col("call_id").alias("event_id"), "session_id", "ts")
    stream = in_files(spark, df, "event_id", tmp_path / "in")
    batch = U.sliding_limit(df, 3, 60)
    same(drain(S.stream_limits(stream, "sliding", "session_id", 3, 60)), batch)


def messages(spark):
    text = F.concat(F.lit("word"), F.col("id") % 9, F.lit(" Acme Cloud needs "), F.col("id") % 6 + 10, F.lit(" GB. ok"))
    return spark.range(60).select(
        (F.col("id") % 4).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        text.alias("text"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"),
    )


def test_novelty_stream(spark, tmp_path):
    df = messages(spark)
    stream = in_files(spark, df, "turn", tmp_path / "in")
    same(drain(S.stream_delta_prune(stream)), C.mark_novel(df).select("conv_id", "turn", "kept"))


def test_summary_stream_carries_on(spark, tmp_path):
    df = messages(spark).filter("conv_id = 1")
    stream = in_files(spark, df, "turn", tmp_path / "in", 2)
    rows = drain(S.stream_summary(stream, budget=40)).collect()
    half = df.approxQuantile("turn", [0.5], 0.0)[0]
    first = C.summarize(df.filter(F.col("turn") < half), budget=40)
    second = C.summarize(df.filter(F.col("turn") >= half), first, 40)
    expected = {first.first()["summary"], second.first()["summary"]}
    assert {r["summary"] for r in rows} == expected


def test_seen_tools_stream(spark, tmp_path):
    names = F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda i: (F.col("id") + i) % 5)
    df = spark.range(60).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("session_id"),
        F.col("id").alias("turn"),
        F.transform(names, lambda n: n.cast("string")).alias("tools"),
        F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"),
    )
    from tokenloom.operators.tools import split_seen_tools

    stream = in_files(spark, df, "turn", tmp_path / "in")
    flat = df.select("session_id", "turn", F.posexplode("tools").alias("pos", "tool"))
    same(drain(S.stream_seen_tools(stream)), split_seen_tools(flat))


def test_stats_stream(spark, tmp_path):
    df = log(spark).select(
        "call_id", "ts", F.lit("m").alias("mode"), F.lit(10).alias("original_tokens"), F.lit(4).alias("compressed_tokens")
    )
    stream = in_files(spark, df, "call_id", tmp_path / "in")
    rows = drain_updates(S.stream_stats(stream), ["hour", "mode"], ["n"])
    batch = df.groupBy(F.date_trunc("hour", "ts").alias("hour"), "mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.lit(6)).alias("tokens_saved")
    )
    same(rows.withColumn("tokens_saved", F.col("tokens_saved").cast("long")), batch.withColumn("tokens_saved", F.col("tokens_saved").cast("long")))


def test_late_row_leaves_other_periods_alone(spark, tmp_path):
    """Two a day: a late row of the day before counts in its own day only."""
    at = ["02 00:01", "02 00:02", "02 00:03", "01 23:59", "02 00:04", "02 00:05", "02 00:06"]
    rows = [(i, "u", f"2024-01-{t}:00") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id long, user string, t string")
    df = df.select("event_id", "user", F.to_timestamp("t").alias("ts"))
    stream = in_files(spark, df, "event_id", tmp_path / "in", 3)
    for kind, expected in (("daily", [0, 1, 3]), ("monthly", [0, 1])):
        out = drain(S.stream_limits(stream, kind, "user", 2, lateness="1 hour")).filter("allowed")
        assert sorted(r["event_id"] for r in out.collect()) == expected


def test_event_stream_sink(spark, tmp_path):
    df = messages(spark).select(
        F.lit("s").alias("session_id"), F.lit("k").alias("api_key"), F.array(F.lit("JWT")).alias("categories"),
        F.lit("HIGH").alias("risk_level"), "ts", "turn",
    )
    stream = in_files(spark, df, "turn", tmp_path / "in")
    writer = sinks.append_event_stream(
        stream, "sensitive_events", str(tmp_path / "out"), str(tmp_path / "check"), "ts"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sinks.read_events(spark, "sensitive_events", str(tmp_path / "out")).count() == 60


def test_daily_limit_keeps_a_state_for_a_month(spark, tmp_path):
    """The days of a key's month share a state, and so a call of Python; each has its own count."""
    hours = F.timestamp_seconds(1_704_067_200 + F.col("id") * 6 * 3600)
    df = spark.range(80).select(F.col("id").alias("event_id"), F.lit("u").alias("user"), hours.alias("ts"))
    stream = S.stream_limits(in_files(spark, df, "event_id", tmp_path / "in"), "daily", "user", 2)
    running = stream.writeStream.format("memory").queryName("daily").trigger(availableNow=True).start()
    running.awaitTermination()
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    allowed = {r["event_id"] for r in spark.table("daily").filter("allowed").collect()}
    assert allowed == {i for i in range(80) if i % 4 < 2}
