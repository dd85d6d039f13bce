import pytest
from pyspark.sql import functions as F

from tokenloom.operators import usage as U
from tokenloom.plans import groups


def calls(spark, *rows):
    """Rows of (session, seconds, n_tools, is_clear)."""
    made = [(i, s, t, n, c) for i, (s, t, n, c) in enumerate(rows)]
    schema = "call_id long, session_id string, sec double, n_tools int, is_clear boolean"
    df = spark.createDataFrame(made, schema)
    return df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def replay(df, **options):
    return {r["call_id"]: (r["tools"], r["cache_hit"], r["tokens_saved"]) for r in U.tool_cache(df, **options).collect()}


CASE = [
    ("a", 0.0, None, False),  # nothing stored
    ("a", 10.0, 5, False),  # stores
    ("a", 310.0, None, False),  # exactly 300 s later: hit
    ("a", 610.001, None, False),  # 300.001 s later: miss, re-armed
    ("a", 620.0, None, False),  # hit
    ("a", 630.0, None, True),  # forget
    ("a", 631.0, None, False),  # nothing stored
    ("a", 632.0, 0, False),  # an empty list is no list
    ("b", 5.0, 1, False),
    ("b", 6.0, None, False),
]
EXPECTED = {
    0: (None, False, 0),
    1: (5, False, 0),
    2: (5, True, 540),
    3: (5, False, 0),
    4: (5, True, 540),
    6: (None, False, 0),
    7: (None, False, 0),
    8: (1, False, 0),
    9: (1, True, 108),
}


@pytest.mark.parametrize("limit", [1, 10**6])
def test_tool_cache(spark, limit):
    assert replay(calls(spark, *CASE), limit=limit) == EXPECTED


@pytest.mark.parametrize("hot", [2, 7, 10**6])
def test_sliding_limit(spark, hot):
    rows = [(i, "s", float(60 * i)) for i in range(31)]
    rows += [(31, "s", 3600.0), (32, "s", 3600.0), (40, "t", 0.0)]
    df = spark.createDataFrame(rows, "event_id long, session_id string, sec double")
    df = df.withColumn("ts", F.timestamp_seconds("sec"))
    out = {r["event_id"]: r["allowed"] for r in U.sliding_limit(df, hot=hot).collect()}
    # Thirty pass, the next is refused; an hour after the first one place is free again.
    assert [out[i] for i in (0, 29, 30, 31, 32, 40)] == [True, True, False, True, False, True]


@pytest.mark.parametrize("hot", [2, 10**6])
def test_monthly_limit(spark, hot):
    rows = [
        (0, "ip", "2024-01-01", None, "pro"),
        (1, "ip", "2024-01-02", None, "developer"),
        (2, "ip", "2024-01-03", None, "pro"),
        (3, "ip", "2024-01-04", "k", "pro"),
        (4, "ip", "2024-01-04", None, "standard"),
        (5, "ip", "2024-02-01", None, "pro"),
    ]
    df = spark.createDataFrame(rows, "call_id long, platform string, ts string, api_key string, mode string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    out = {r["call_id"]: tuple(r)[1:] for r in U.monthly_limit(df, 2, hot).collect()}
    assert out == {
        0: (True, 0, 1),
        1: (True, 1, 0),
        2: (False, 2, 0),
        3: (True, 0, 0),
        4: (True, 0, 0),
        5: (True, 0, 1),
    }


def test_running_total_of_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    forms = [
        groups.running_total(df, ["k"], [F.desc("id")], F.col("id"), "s", "t", limit)
        for limit in (10, 10**6)
    ]
    first, second = (sorted(map(tuple, f.select("k", "id", "s", "t").collect())) for f in forms)
    assert first == second


def test_tier_stats_empty(spark):
    df = spark.createDataFrame([], "mode string, original_tokens long, compressed_tokens long, pct_saved long")
    rows = U.tier_stats(df).collect()
    assert [tuple(r) for r in rows] in ([], [(None, 0, 0, 0.0)])


def test_break_even_of_published_ratios(spark):
    df = spark.createDataFrame([("x", 22.0), ("y", 98.7)], "system string, cr double")
    minutes = U.break_even(U.cost_report(df), "x", "y").first()["break_even_minutes"]
    assert minutes == pytest.approx(3.51, abs=0.01)


def test_authentication(spark):
    log = spark.createDataFrame(
        [(0, None), (1, " "), (2, "x"), (3, "a"), (4, "b")], "call_id long, api_key string"
    )
    keys = spark.createDataFrame([("a", "active"), ("b", "canceled")], "api_key string, status string")
    out = {r["call_id"]: r["auth_status"] for r in U.authenticate(log, keys).collect()}
    assert out == {0: "missing", 1: "missing", 2: "invalid", 3: "ok", 4: "inactive"}


def test_history_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(8, 7), (200, 199), (0, 0)], "a long, b long")
    out = [r[0] for r in df.select(U.history_percent(F.col("a"), F.col("b"))).collect()]
    assert out == [13, 1, 0]


def test_sliding_limit_equals_a_plain_walk(spark):
    """Bursts, quiet hours, floods without a pause and equal times, in sessions of every size."""
    import datetime
    import random

    draw, rows = random.Random(11), []
    for session in range(8):
        at = 0
        for _ in range((0, 1, 40, 150, 150, 300, 300, 80)[session]):
            # Session 6 never pauses, 7 has equal times only.
            at += 0 if session == 7 else draw.randint(0, 9) if session == 6 or draw.random() < 0.8 else draw.randint(50, 200)
            rows.append((len(rows), f"s{session}", at))
    draw.shuffle(rows)
    start = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(i, s, start + datetime.timedelta(seconds=at)) for i, s, at in rows], "event_id long, session_id string, ts timestamp"
    )
    for limit in (1, 3, 12):
        expected = {}
        for session in {s for _, s, _ in rows}:
            accepted = []
            for at, i in sorted((at, i) for i, s, at in rows if s == session):
                ok = sum(t > at - 60 for t in accepted) < limit
                accepted += [at] * ok
                expected[i] = ok
        assert len(set(expected.values())) == 2
        for hot in (0, 100):
            found = {r["event_id"]: r["allowed"] for r in U.sliding_limit(events, limit, 1, hot).collect()}
            assert found == expected
