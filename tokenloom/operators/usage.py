"""Call-log replays, limits, savings and account reports."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.columns import half_even
from tokenloom.functions.text import TOKENS_PER_TOOL
from tokenloom.operators.safety import key_hint
from tokenloom.plans.groups import (
    HOT_ROWS,
    blocks_before,
    cut_lineage,
    numbered,
    ordered_blocks,
    split_hot,
)

# --- fixed values -----------------------------------------------------------------------------
CACHE_TTL_S = 300
CACHED_SHARE = 0.10
DOLLARS_PER_MILLION = 3
MONTHLY_LIMIT = 5_000
DAILY_LIMIT = 10
CHAT_LIMIT = 30
CHAT_MINUTES = 60
KEY_LIMITS = {"solo": 1, "team": 10}
HISTORY = 500
QUALITY_FLOOR, QUALITY_SPAN, QUALITY_DECAY = 3.35, 1.65, 0.028
SAFE_BELOW, DEGRADED_FROM = 33.0, 85.4
SESSIONS, CONTEXT_SPEND, ENGINEER_RATE = 100, 1.20, 100
# --- end of fixed values ------------------------------------------------------------------------


def dollars(tokens: Column) -> Column:
    return half_even(tokens / 1_000_000 * DOLLARS_PER_MILLION, 2)


def key_limit_column(plan: Column) -> Column:
    limit = F.when(F.lit(False), F.lit(0))
    for name, size in KEY_LIMITS.items():
        limit = limit.when(plan == name, size)
    return limit.otherwise(1)


# --- tool cache -------------------------------------------------------------------------------


def cached_saving(n_tools: Column) -> Column:
    """Tokens saved by one hit: the list's size less the share still billed."""
    original = n_tools * TOKENS_PER_TOOL
    return (original - F.floor(original * F.lit(CACHED_SHARE))).cast("long")


def tool_cache(calls: DataFrame, ttl_s: int = CACHE_TTL_S, limit: int = HOT_ROWS) -> DataFrame:
    """Replay the session tool cache over ``call_id, session_id, ts, n_tools, is_clear``.

    A call that brings tools stores them. A call without uses the stored ones: a hit if the
    last call of the session was at most ``ttl_s`` seconds ago. A clear event forgets them and
    is not a call itself. Other columns are carried along.
    """
    stored = F.when(F.col("n_tools") > 0, F.struct(F.col("n_tools").alias("tools")))
    cleared = F.when(F.col("is_clear"), F.struct(F.lit(None).cast("int").alias("tools")))
    rows = calls.withColumn("_mark", F.coalesce(cleared, stored))
    order = ["ts", "call_id"]
    usual, hot = split_hot(rows, ["session_id"], limit)
    session = Window.partitionBy("session_id").orderBy(*order)
    upto = (Window.unboundedPreceding, Window.currentRow)
    done = usual.withColumn(
        "_now", F.last("_mark", ignorenulls=True).over(session.rowsBetween(*upto))
    ).withColumn("_last", F.lag("ts").over(session))
    if hot is not None:
        placed = ordered_blocks(hot, ["session_id"], order)
        position = F.struct(*order)
        ends = placed.groupBy("session_id", "_block").agg(
            F.max_by("_mark", F.when(F.col("_mark").isNotNull(), position)).alias("_end"),
            F.max("ts").alias("_end_ts"),
        )
        before = blocks_before(["session_id"])
        carried = ends.withColumn(
            "_carry", F.last("_end", ignorenulls=True).over(before)
        ).withColumn("_carry_ts", F.last("_end_ts").over(before))
        inside = Window.partitionBy("session_id", "_block").orderBy(*order)
        rest = (
            placed.join(carried.drop("_end", "_end_ts"), ["session_id", "_block"])
            .withColumn(
                "_now",
                F.coalesce(
                    F.last("_mark", ignorenulls=True).over(inside.rowsBetween(*upto)), "_carry"
                ),
            )
            .withColumn("_last", F.coalesce(F.lag("ts").over(inside), "_carry_ts"))
        )
        done = done.unionByName(rest.drop("_block", "_carry", "_carry_ts"))

    brings = F.coalesce(F.col("n_tools") > 0, F.lit(False))
    tools = F.col("_now.tools")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.col("_last").cast("timestamp")
    )
    hit = ~brings & tools.isNotNull() & (gap <= ttl_s * 1_000_000)
    replay = done.filter(~F.col("is_clear")).withColumn("cache_hit", F.coalesce(hit, F.lit(False)))
    kept = [c for c in calls.columns if c not in ("n_tools", "is_clear")]
    return replay.select(
        *kept,
        tools.alias("tools"),
        "cache_hit",
        F.when(F.col("cache_hit"), cached_saving(tools)).otherwise(0).alias("tokens_saved"),
    )


def savings_by_key(replay: DataFrame) -> DataFrame:
    """Tokens saved per key; calls without a key or a saving count nowhere."""
    return (
        replay.filter(F.col("api_key").isNotNull() & (F.col("tokens_saved") > 0))
        .groupBy("api_key")
        .agg(F.sum("tokens_saved").alias("tokens_saved"))
    )


def session_state(calls: DataFrame) -> DataFrame:
    """What the cache holds at the end of the log: session, tools, last call.

    ``tools`` is whatever the calls carry in ``n_tools``. Sessions cleared last hold nothing.
    """
    position = F.struct("ts", "call_id")
    brings = F.col("n_tools") > 0
    ends = calls.groupBy("session_id").agg(
        F.max(F.when(F.col("is_clear"), position)).alias("_clear"),
        F.max(F.when(brings, position)).alias("_store"),
        F.max_by("n_tools", F.when(brings, position)).alias("n_tools"),
        F.max_by("ts", F.when(~F.col("is_clear"), position)).alias("last_call"),
    )
    alive = F.col("_store").isNotNull() & (
        F.col("_clear").isNull() | (F.col("_clear") < F.col("_store"))
    )
    return ends.filter(alive).select("session_id", "n_tools", "last_call")


def session_list(sessions: DataFrame, as_of: Column, ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """Stored sessions (session_id, tools_json, last_call): tools, size, warmth and age."""
    tools = F.from_json("tools_json", "array<struct<name:string>>")
    age = (
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_call").cast("timestamp"))
    ) / 1_000_000
    return sessions.withColumn("_tools", tools).select(
        "session_id",
        F.size("_tools").cast("long").alias("tool_count"),
        F.transform("_tools", lambda t: F.coalesce(t["name"], F.lit("?"))).alias("tool_names"),
        (F.size("_tools") * TOKENS_PER_TOOL).cast("long").alias("tokens_cached"),
        (age < ttl_s).alias("cache_warm"),
        # A future call time truncates toward zero.
        age.cast("long").alias("last_call_ago_s"),
    )


# --- keys and accounts ------------------------------------------------------------------------


def authenticate(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Sort calls by key: ok, missing, invalid or inactive."""
    known = keys.select(F.col("api_key").alias("_key"), F.col("status").alias("_status"))
    given = F.trim(F.coalesce("api_key", F.lit("")))
    rows = calls.withColumn("_given", F.when(given != "", given))
    return rows.join(known, F.col("_given") == F.col("_key"), "left").select(
        "call_id",
        F.when(F.col("_given").isNull(), "missing")
        .when(F.col("_key").isNull(), "invalid")
        .when(F.col("_status") == "active", "ok")
        .otherwise("inactive")
        .alias("auth_status"),
    )


def with_savings(keys: DataFrame, savings: DataFrame) -> DataFrame:
    saved = savings.select("api_key", F.col("tokens_saved").alias("_saved"))
    return (
        keys.join(saved, "api_key", "left")
        .withColumn("tokens_saved", F.coalesce("_saved", F.lit(0)))
        .drop("_saved")
    )


def dashboard(keys: DataFrame, savings: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per account, active if any key is. The session count covers all accounts."""
    active = sessions.agg(F.count(F.lit(1)).alias("sessions_active")).scalar()
    return (
        with_savings(keys, savings)
        .groupBy("email")
        .agg(
            F.max("plan").alias("plan"),
            F.min("status").alias("status"),
            F.sum("tokens_saved").alias("tokens_saved"),
            F.count(F.lit(1)).alias("keys_used"),
        )
        .select(
            "email",
            "plan",
            "status",
            active.alias("sessions_active"),
            "tokens_saved",
            dollars(F.col("tokens_saved")).alias("dollar_saved"),
            key_limit_column(F.col("plan")).cast("long").alias("key_limit"),
            "keys_used",
        )
    )


def dashboard_projects(keys: DataFrame, savings: DataFrame) -> DataFrame:
    """The project rows of the dashboard, for team accounts only."""
    return (
        with_savings(keys, savings)
        .filter(F.col("plan") == "team")
        .select(
            "email",
            "project_name",
            key_hint(F.col("api_key")).alias("api_key_hint"),
            "status",
            "tokens_saved",
            dollars(F.col("tokens_saved")).alias("dollar_saved"),
        )
    )


def account_keys(keys: DataFrame, email: str) -> DataFrame:
    """An account's keys in order of creation."""
    return (
        keys.filter(F.col("email") == email)
        .orderBy("created_at", "api_key")
        .select("project_name", key_hint(F.col("api_key")).alias("api_key_hint"), "status", "tokens_saved")
    )


def key_limit(keys: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Which keys the plan allows, in order of creation."""
    rows = numbered(keys, ["email"], ["created_at", "api_key"], "used", None, limit)
    return rows.select(
        "api_key", "email", (F.col("used") <= key_limit_column(F.col("plan"))).alias("allowed")
    )


# --- limits -----------------------------------------------------------------------------------


def monthly_limit(calls: DataFrame, limit: int = MONTHLY_LIMIT, hot: int = HOT_ROWS) -> DataFrame:
    """Free use per address and calendar month; keys and the standard tier are exempt.

    All other tiers share the count, refused calls do not add to it. Needs
    ``call_id, platform, ts, api_key, mode``.
    """
    exempt = F.col("api_key").isNotNull() | (F.col("mode") == "standard")
    counted = calls.filter(~exempt).withColumn("_month", F.date_trunc("month", "ts"))
    slim = counted.select("call_id", "platform", "_month", "ts")
    rows = numbered(slim, ["platform", "_month"], ["ts", "call_id"], "_nth", None, hot)
    used = F.least(F.col("_nth") - 1, F.lit(limit)).cast("long")
    judged = rows.select(
        "call_id",
        (F.col("_nth") <= limit).alias("allowed"),
        used.alias("used"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("_nth")).cast("long").alias("remaining"),
    )
    zero = F.lit(0).cast("long")
    free = calls.filter(exempt).select(
        "call_id", F.lit(True).alias("allowed"), zero.alias("used"), zero.alias("remaining")
    )
    return judged.unionByName(free)


def daily_quota(events: DataFrame, limit: int = DAILY_LIMIT, hot: int = HOT_ROWS) -> DataFrame:
    """Uses per unlicensed user and UTC day (``event_id, user_id, ts``)."""
    slim = events.select("event_id", "user_id", F.to_date("ts").alias("_day"), "ts")
    rows = numbered(slim, ["user_id", "_day"], ["ts", "event_id"], "_nth", None, hot)
    return rows.select(
        "event_id",
        (F.col("_nth") <= limit).alias("allowed"),
        F.least(F.col("_nth") - 1, F.lit(limit)).cast("long").alias("used"),
    )


def _accepted(attempts: Column, start: Column, limit: int, span: int) -> Column:
    """Fold over ordered (us, event_id): struct of recent accepted times and accepted ids."""

    def step(state: Column, a: Column) -> Column:
        recent = F.filter(state["recent"], lambda t: t > a["us"] - span)
        return F.when(
            F.size(recent) < limit,
            F.struct(
                F.concat(recent, F.array(a["us"])).alias("recent"),
                F.concat(state["ids"], F.array(a["event_id"])).alias("ids"),
            ),
        ).otherwise(F.struct(recent.alias("recent"), state["ids"].alias("ids")))

    return F.aggregate(attempts, start, step)


def _busy_stretches(events: DataFrame, limit: int, span: int) -> tuple[DataFrame, DataFrame]:
    """The events (event_id, session_id, us) that are surely accepted, and the others in stretches.

    An event is heavy if its session had ``limit`` others, refused ones included, within ``span`` before; all
    others are surely accepted. Time is cut in buckets of ``span``; those within one of a heavy event are
    busy. A decision in doubt only looks back one span, so a run of busy buckets decides without the rest
    of its session, and the events of all other buckets are accepted. Needs one numbering along each session and
    joins on (session, number) and (session, bucket); no task holds a session.
    """
    rows = numbered(events, ["session_id"], ["us", "event_id"], "nth", None, HOT_ROWS)
    rows = cut_lineage(rows.withColumn("bucket", F.floor(F.col("us") / span)))
    # The event ``limit`` places before.
    before = rows.select("session_id", (F.col("nth") + limit).alias("nth"), F.col("us").alias("_us"))
    heavy = rows.join(before, ["session_id", "nth"]).filter(F.col("_us") > F.col("us") - span)
    near = F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])).alias("bucket")
    busy = heavy.select("session_id", "bucket").distinct().select("session_id", near).distinct()
    # There are as many buckets as spans of time, however many events they hold.
    order = Window.partitionBy("session_id").orderBy("bucket")
    starts = F.coalesce(F.col("bucket") - F.lag("bucket").over(order) > 1, F.lit(True)).cast("int")
    busy = busy.withColumn("_start", starts).withColumn("stretch", F.sum("_start").over(order))
    busy = cut_lineage(busy.select("session_id", "bucket", "stretch"))
    slim = rows.select("event_id", "session_id", "us", "bucket")
    quiet = slim.join(busy, ["session_id", "bucket"], "left_anti").select("event_id")
    return quiet, slim.join(busy, ["session_id", "bucket"]).select("event_id", "session_id", "stretch", "us")


def _jump_through(stretches: DataFrame, limit: int, span: int) -> DataFrame:
    """The accepted events of busy stretches: event_id.

    The next event that can be accepted after ``limit`` others is the first one a span after the earliest
    of them: it is found by a search in the ordered times, so refused events cost nothing.
    """
    placed = stretches.repartition("session_id", "stretch").sortWithinPartitions("session_id", "stretch", "us", "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque(maxlen=limit)
        for batch in batches:
            us = batch.column("us").to_numpy()
            session, stretch = batch.column("session_id"), batch.column("stretch").to_numpy()
            codes = session.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(stretch) != 0)) + 1
            ok = np.zeros(len(us), dtype=bool)
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(us)], strict=True):
                key = session[first].as_py(), int(stretch[first])
                if key != current:
                    current = key
                    recent.clear()
                at = first
                while at < end:
                    if len(recent) == limit:
                        at += int(np.searchsorted(us[at:end], recent[0] + span))
                        if at >= end:
                            break
                    ok[at] = True
                    recent.append(int(us[at]))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column("event_id").filter(pa.array(ok))], names=["event_id"])

    kind = stretches.schema["event_id"].dataType.simpleString()
    return placed.mapInArrow(walk, f"event_id {kind}")


def sliding_limit(
    events: DataFrame,
    limit: int = CHAT_LIMIT,
    minutes: int = CHAT_MINUTES,
    hot: int = 1_000,
) -> DataFrame:
    """At most ``limit`` accepted events per session in the last ``minutes``.

    Refused events are not logged, so each decision needs the earlier ones. Sessions up to
    ``hot`` events fold in one array. Longer ones are cut where no decision looks across, and jump from
    one accepted event to the next; only a session that stays above the limit without a pause is one
    stretch, and passes as sorted batches with ``limit`` times at hand.
    """
    span = minutes * 60 * 1_000_000
    slim = events.select(
        "event_id", "session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    if limit < 1:
        return slim.select("event_id", F.lit(False).alias("allowed"))
    attempt = F.struct("us", "event_id")
    id_type = slim.schema["event_id"].dataType.simpleString()
    usual, long_ones = split_hot(slim, ["session_id"], hot)

    def begin(recent: Column) -> Column:
        return F.struct(
            recent.alias("recent"), F.array().cast(f"array<{id_type}>").alias("ids")
        )

    empty = F.array().cast("array<long>")
    folded = usual.groupBy("session_id").agg(F.array_sort(F.collect_list(attempt)).alias("_a"))
    accepted = folded.select(
        F.explode(_accepted(F.col("_a"), begin(empty), limit, span)["ids"]).alias("event_id")
    )
    if long_ones is not None:
        quiet, busy = _busy_stretches(long_ones, limit, span)
        accepted = accepted.unionByName(quiet).unionByName(_jump_through(busy, limit, span))
    marks = accepted.withColumn("_ok", F.lit(True))
    return events.select("event_id").join(marks, "event_id", "left").select(
        "event_id", F.coalesce("_ok", F.lit(False)).alias("allowed")
    )


# --- reports ----------------------------------------------------------------------------------


def tier_stats(events: DataFrame) -> DataFrame:
    """Count, tokens saved and mean percentage, overall (mode null) and per tier."""
    return events.rollup("mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("original_tokens") - F.col("compressed_tokens")), F.lit(0)).alias(
            "tokens_saved"
        ),
        F.coalesce(F.round(F.avg("pct_saved"), 1), F.lit(0.0)).alias("avg_pct"),
    )


def tool_sessions(tool_calls: DataFrame) -> DataFrame:
    """Per session (``session_id, turn, tool_count, raw_tokens, dsl_tokens``): turns and savings.

    The first turn sets the tool count and the raw size every later turn is measured against.
    """
    saved = F.greatest(F.lit(0), F.col("raw_tokens") - F.col("dsl_tokens"))
    sums = tool_calls.withColumn("_saved", saved).groupBy("session_id").agg(
        F.min_by("tool_count", "turn").alias("tool_count"),
        F.min_by("raw_tokens", "turn").alias("raw_tokens"),
        F.min_by("dsl_tokens", "turn").alias("_dsl"),
        F.count(F.lit(1)).alias("turn_count"),
        F.sum("_saved").alias("tokens_saved_total"),
    )
    first = half_even(1 - F.col("_dsl") / F.col("raw_tokens"), 4)
    average = F.round(F.col("tokens_saved_total") / (F.col("raw_tokens") * F.col("turn_count")), 4)
    has_raw = F.col("raw_tokens") > 0
    return sums.select(
        "session_id",
        "tool_count",
        "raw_tokens",
        F.when(has_raw, first).otherwise(0.0).alias("cr_turn1"),
        "turn_count",
        "tokens_saved_total",
        F.when(F.col("turn_count") == 1, F.when(has_raw, first).otherwise(0.0))
        .otherwise(average)
        .alias("cr_session_avg"),
    )


def quality_column(cr: Column) -> Column:
    return QUALITY_FLOOR + QUALITY_SPAN * F.exp(-QUALITY_DECAY * cr)


def cost_report(
    optimised: DataFrame,
    sessions: int = SESSIONS,
    context_spend: float = CONTEXT_SPEND,
    engineer_rate: float = ENGINEER_RATE,
    minutes: float = 5.0,
) -> DataFrame:
    """Quality, fact loss and monthly cost per system at its measured compression (``system, cr``)."""
    rows = optimised.groupBy("system").agg(F.avg("cr").alias("avg_cr"))
    rows = rows.withColumn("quality", quality_column(F.col("avg_cr")))
    rows = rows.withColumn("fact_loss", 1 - F.col("quality") / 5)
    api = sessions * (1 - F.col("avg_cr") / 100) * context_spend
    rework = sessions * F.col("fact_loss") * (minutes / 60) * engineer_rate
    zone = (
        F.when(F.col("avg_cr") <= SAFE_BELOW, "safe")
        .when(F.col("avg_cr") <= DEGRADED_FROM, "degraded")
        .otherwise("critical")
    )
    return rows.select(
        "system", "avg_cr", "quality", "fact_loss", zone.alias("zone"), (api + rework).alias("monthly_cost")
    )


def break_even(
    report: DataFrame,
    first: str,
    second: str,
    sessions: int = SESSIONS,
    context_spend: float = CONTEXT_SPEND,
    engineer_rate: float = ENGINEER_RATE,
) -> DataFrame:
    """Minutes of rework per failure above which ``first`` is the cheaper of two systems."""

    def of(system: str, column: str) -> Column:
        return F.max(F.when(F.col("system") == system, F.col(column)))

    sides = report.agg(
        of(first, "avg_cr").alias("c1"),
        of(second, "avg_cr").alias("c2"),
        of(first, "fact_loss").alias("f1"),
        of(second, "fact_loss").alias("f2"),
    )
    spend = sessions * context_spend * (F.col("c1") - F.col("c2")) / 100
    failures = sessions * (F.col("f1") - F.col("f2")) * engineer_rate
    return sides.select(
        F.lit(first).alias("first"),
        F.lit(second).alias("second"),
        F.when(failures != 0, spend * 60 / failures).alias("break_even_minutes"),
    )


def usage_counters(events: DataFrame) -> DataFrame:
    """Per user (``user_id, saved, pct``): tokens saved, sum of percentages, prompts."""
    return events.groupBy("user_id").agg(
        F.coalesce(F.sum("saved"), F.lit(0)).alias("tokens_saved"),
        F.coalesce(F.sum("pct"), F.lit(0)).alias("pct_sum"),
        F.count(F.lit(1)).alias("prompts"),
    )


def history_percent(before: Column, after: Column) -> Column:
    """Whole percent saved, halves rounded up."""
    return F.when(before > 0, F.floor((before - after) / before * 100 + 0.5)).otherwise(0).cast("long")


def recent_history(events: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last ``n`` compressions per user (``user_id, event_id, ts, et, pt``) with percentage."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return (
        events.withColumn("_nth", F.row_number().over(newest))
        .filter(F.col("_nth") <= n)
        .drop("_nth")
        .withColumn("pct", history_percent(F.col("et"), F.col("pt")))
    )
