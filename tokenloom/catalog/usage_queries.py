"""Queries over call logs, accounts and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.base import query, run_folder, table, view, view_sql
from tokenloom.operators import usage as U
from tokenloom.sources import sinks

CALLS = view_sql("calls_v")
BOTH = view_sql("calls_v", "accounts_v")
TTL = 6 * 3600
AS_OF = "2024-02-01 00:00:00"


def calls(spark, sf_dir):
    return view(spark, sf_dir, "calls_v")


def accounts(spark, sf_dir):
    return view(spark, sf_dir, "accounts_v")


# --- tool cache -------------------------------------------------------------------------------

CACHE_SQL = f"""marked AS (SELECT *, CAST(sum(CAST(is_clear AS INT)) OVER s AS BIGINT) AS seg,
    lag(ts) OVER (PARTITION BY session_id ORDER BY ts, call_id) AS prev
  FROM calls_v WINDOW s AS (PARTITION BY session_id ORDER BY ts, call_id)),
held AS (SELECT *, last_value(n_tools IGNORE NULLS) OVER
    (PARTITION BY session_id, seg ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS tools FROM marked),
replay AS (SELECT call_id, session_id, ts, api_key, original_tokens, compressed_tokens, mode, platform, tools, cache_hit,
    CASE WHEN cache_hit THEN CAST(tools * 120 - floor(tools * 120 * 0.1) AS BIGINT) ELSE 0 END AS tokens_saved
  FROM (SELECT *, n_tools IS NULL AND tools IS NOT NULL AND ts - prev <= INTERVAL {TTL} SECOND AS cache_hit FROM held)
  WHERE NOT is_clear)"""
SLIM = "call_id, session_id, tools, cache_hit, tokens_saved"


@query("tool_cache", f"{CALLS}, {CACHE_SQL} SELECT {SLIM} FROM replay")
def tool_cache(spark, sf_dir):
    return U.tool_cache(calls(spark, sf_dir), TTL).select(*SLIM.split(", "))


@query("tool_cache_hot", f"{CALLS}, {CACHE_SQL} SELECT {SLIM} FROM replay")
def tool_cache_hot(spark, sf_dir):
    """The block-wise form for very long sessions, forced on all of them."""
    return U.tool_cache(calls(spark, sf_dir), TTL, limit=10).select(*SLIM.split(", "))


SAVINGS_SQL = f"""{CACHE_SQL}, savings AS (SELECT api_key, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved
  FROM replay WHERE api_key IS NOT NULL AND tokens_saved > 0 GROUP BY api_key)"""


@query("savings", f"{CALLS}, {SAVINGS_SQL} SELECT * FROM savings")
def savings(spark, sf_dir):
    return U.savings_by_key(U.tool_cache(calls(spark, sf_dir), TTL))


HELD_SQL = """ends AS (SELECT session_id, max((ts, call_id)) FILTER (is_clear) AS cleared,
    max((ts, call_id)) FILTER (n_tools > 0) AS stored,
    max_by(n_tools, (ts, call_id)) FILTER (n_tools > 0) AS n_tools, max(ts) FILTER (NOT is_clear) AS last_call
  FROM calls_v GROUP BY session_id),
sessions AS (SELECT session_id, n_tools, last_call FROM ends WHERE stored IS NOT NULL AND (cleared IS NULL OR cleared < stored))"""


@query("session_state", f"{CALLS}, {HELD_SQL} SELECT * FROM sessions")
def session_state(spark, sf_dir):
    return U.session_state(calls(spark, sf_dir))


@query(
    "session_list",
    f"""{CALLS}, {HELD_SQL}
SELECT session_id, CAST(n_tools AS BIGINT) AS tool_count,
  list_transform(range(1, n_tools + 1), lambda i: 'tool_' || i) AS tool_names,
  CAST(n_tools * 120 AS BIGINT) AS tokens_cached,
  epoch(TIMESTAMP '{AS_OF}') - epoch(last_call) < {TTL} AS cache_warm,
  CAST(floor(epoch(TIMESTAMP '{AS_OF}') - epoch(last_call)) AS BIGINT) AS last_call_ago_s FROM sessions""",
)
def session_list(spark, sf_dir):
    names = F.transform(
        F.sequence(F.lit(1), F.col("n_tools")),
        lambda i: F.struct(F.concat(F.lit("tool_"), i.cast("string")).alias("name")),
    )
    held = U.session_state(calls(spark, sf_dir)).withColumn("tools_json", F.to_json(names))
    return U.session_list(held, F.lit(AS_OF).cast("timestamp"), TTL)


# --- accounts ---------------------------------------------------------------------------------


@query(
    "dashboard",
    f"""{BOTH}, {SAVINGS_SQL}, {HELD_SQL}
SELECT email, max(plan) AS plan, min(status) AS status, (SELECT count(*) FROM sessions) AS sessions_active,
  CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS tokens_saved,
  round_even(sum(coalesce(tokens_saved, 0))::DOUBLE / 1000000 * 3, 2) AS dollar_saved,
  CAST(CASE max(plan) WHEN 'team' THEN 10 ELSE 1 END AS BIGINT) AS key_limit, count(*) AS keys_used
FROM accounts_v LEFT JOIN savings USING (api_key) GROUP BY email""",
)
def dashboard(spark, sf_dir):
    log = calls(spark, sf_dir)
    saved = U.savings_by_key(U.tool_cache(log, TTL))
    return U.dashboard(accounts(spark, sf_dir), saved, U.session_state(log))


@query(
    "dashboard_projects",
    f"""{BOTH}, {SAVINGS_SQL}
SELECT email, project_name, left(api_key, 8) || '...' AS api_key_hint, status, coalesce(tokens_saved, 0) AS tokens_saved,
  round_even(coalesce(tokens_saved, 0)::DOUBLE / 1000000 * 3, 2) AS dollar_saved
FROM accounts_v LEFT JOIN savings USING (api_key) WHERE plan = 'team'""",
)
def dashboard_projects(spark, sf_dir):
    saved = U.savings_by_key(U.tool_cache(calls(spark, sf_dir), TTL))
    return U.dashboard_projects(accounts(spark, sf_dir), saved)


@query(
    "auth_status",
    f"""{BOTH}
SELECT call_id, CASE WHEN c.api_key IS NULL THEN 'missing' WHEN a.api_key IS NULL THEN 'invalid'
  WHEN a.status = 'active' THEN 'ok' ELSE 'inactive' END AS auth_status FROM
  (SELECT call_id, CASE WHEN call_id % 7 = 0 THEN 'pk_unknown' ELSE api_key END AS api_key FROM calls_v) c
  LEFT JOIN accounts_v a ON a.api_key = c.api_key""",
)
def auth_status(spark, sf_dir):
    log = calls(spark, sf_dir).withColumn(
        "api_key", F.when(F.col("call_id") % 7 == 0, "pk_unknown").otherwise(F.col("api_key"))
    )
    return U.authenticate(log, accounts(spark, sf_dir))


EMAIL = "u7@example.com"


@query(
    "account_keys",
    f"""{BOTH}, {SAVINGS_SQL}
SELECT project_name, left(api_key, 8) || '...' AS api_key_hint, status, coalesce(tokens_saved, 0) AS tokens_saved
FROM accounts_v LEFT JOIN savings USING (api_key) WHERE email = '{EMAIL}'""",
)
def account_keys(spark, sf_dir):
    saved = U.savings_by_key(U.tool_cache(calls(spark, sf_dir), TTL))
    return U.account_keys(U.with_savings(accounts(spark, sf_dir), saved), EMAIL)


@query(
    "key_limit",
    f"""{view_sql('accounts_v')}
SELECT api_key, email, row_number() OVER (PARTITION BY email ORDER BY created_at, api_key)
  <= CASE plan WHEN 'team' THEN 10 ELSE 1 END AS allowed FROM accounts_v""",
)
def key_limit(spark, sf_dir):
    return U.key_limit(accounts(spark, sf_dir))


# --- limits -----------------------------------------------------------------------------------


def _monthly_sql(limit: int) -> str:
    return f"""{CALLS}
SELECT call_id, nth <= {limit} AS allowed, least(nth - 1, {limit}) AS used, greatest(0, {limit} - nth) AS remaining FROM
  (SELECT call_id, row_number() OVER (PARTITION BY platform, date_trunc('month', ts) ORDER BY ts, call_id) AS nth
   FROM calls_v WHERE api_key IS NULL AND mode <> 'standard')
UNION ALL SELECT call_id, true, 0, 0 FROM calls_v WHERE api_key IS NOT NULL OR mode = 'standard'"""


# In the derived view only standard calls lack a key; a shifted tier gives the limit work.
_SHIFTED = "CASE WHEN call_id % 2 = 0 THEN 'pro' ELSE mode END"


@query(
    "free_limit",
    _monthly_sql(60).replace("FROM calls_v", f"FROM (SELECT * REPLACE ({_SHIFTED} AS mode) FROM calls_v)"),
)
def free_limit(spark, sf_dir):
    return U.monthly_limit(calls(spark, sf_dir).withColumn("mode", F.expr(_SHIFTED)), 60)


@query(
    "daily_quota",
    """SELECT event_id, nth <= 2 AS allowed, least(nth - 1, 2) AS used FROM (SELECT event_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)""",
)
def daily_quota(spark, sf_dir):
    return U.daily_quota(table(spark, sf_dir, "events"), 2)


CHAT_LIMIT, CHAT_MINUTES = 3, 24 * 60
_CHAT_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS TIMESTAMP[]) AS recent, CAST(NULL AS BIGINT) AS event_id, false AS allowed
    FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, CASE WHEN len(recent) < {CHAT_LIMIT} THEN list_append(recent, ts) ELSE recent END,
    event_id, len(recent) < {CHAT_LIMIT}
  FROM (SELECT e.user_id, e.i, e.ts, e.event_id,
      list_filter(w.recent, lambda t: t > e.ts - INTERVAL {CHAT_MINUTES} MINUTE) AS recent
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT event_id, allowed FROM walk WHERE i > 0"""


def _chat_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), "ts")


@query("chat_limit", _CHAT_SQL)
def chat_limit(spark, sf_dir):
    return U.sliding_limit(_chat_events(spark, sf_dir), CHAT_LIMIT, CHAT_MINUTES)


@query("chat_limit_hot", _CHAT_SQL)
def chat_limit_hot(spark, sf_dir):
    """The block-wise form for very long sessions, forced on all of them."""
    events = _chat_events(spark, sf_dir)
    size = max(20, events.count() // 300)
    return U.sliding_limit(events, CHAT_LIMIT, CHAT_MINUTES, hot=size)


# --- reports ----------------------------------------------------------------------------------

_PCT = "floor((original_tokens - compressed_tokens) * 100 / original_tokens)"


@query(
    "tier_stats",
    f"""{CALLS}
SELECT mode, count(*) AS n, CAST(sum(original_tokens - compressed_tokens) AS BIGINT) AS tokens_saved,
  round(avg(CAST({_PCT} AS BIGINT)), 1) AS avg_pct FROM calls_v GROUP BY ROLLUP (mode)""",
)
def tier_stats(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("pct_saved", F.expr(f"CAST({_PCT} AS BIGINT)"))
    return U.tier_stats(rows)


@query(
    "tool_sessions",
    f"""{CALLS}
SELECT session_id, tool_count, raw_tokens, round_even(1 - dsl::DOUBLE / raw_tokens, 4) AS cr_turn1, turn_count, tokens_saved_total,
  CASE WHEN turn_count = 1 THEN round_even(1 - dsl::DOUBLE / raw_tokens, 4)
    ELSE round(tokens_saved_total::DOUBLE / (raw_tokens * turn_count), 4) END AS cr_session_avg FROM
  (SELECT session_id, min_by(1 + call_id % 7, call_id) AS tool_count, min_by(original_tokens, call_id) AS raw_tokens,
    min_by(compressed_tokens, call_id) AS dsl, count(*) AS turn_count,
    CAST(sum(greatest(0, original_tokens - compressed_tokens)) AS BIGINT) AS tokens_saved_total
   FROM calls_v GROUP BY session_id)""",
)
def tool_sessions(spark, sf_dir):
    turns = calls(spark, sf_dir).selectExpr(
        "session_id",
        "call_id AS turn",
        "1 + call_id % 7 AS tool_count",
        "original_tokens AS raw_tokens",
        "compressed_tokens AS dsl_tokens",
    )
    return U.tool_sessions(turns)


_CR = "(1 - CAST(compressed_tokens AS DOUBLE) / original_tokens) * 100"
_COST_SQL = f"""report AS (SELECT *, CASE WHEN avg_cr <= 33.0 THEN 'safe' WHEN avg_cr <= 85.4 THEN 'degraded' ELSE 'critical' END AS zone,
    100 * (1 - avg_cr / 100) * 1.2::DOUBLE + 100 * fact_loss * (5.0::DOUBLE / 60) * 100 AS monthly_cost FROM
  (SELECT *, 1 - quality / 5 AS fact_loss FROM
    (SELECT *, 3.35::DOUBLE + 1.65::DOUBLE * exp(-0.028::DOUBLE * avg_cr) AS quality FROM
      (SELECT mode AS system, avg({_CR}) AS avg_cr FROM calls_v GROUP BY mode))))"""


def _systems(spark, sf_dir):
    return calls(spark, sf_dir).selectExpr("mode AS system", f"{_CR} AS cr")


@query(
    "cost_report",
    f"""{CALLS}, {_COST_SQL} SELECT system, round(avg_cr, 6) AS avg_cr, round(quality, 6) AS quality,
  round(fact_loss, 6) AS fact_loss, zone, round(monthly_cost, 4) AS monthly_cost FROM report""",
)
def cost_report(spark, sf_dir):
    rows = U.cost_report(_systems(spark, sf_dir))
    for name in ("avg_cr", "quality", "fact_loss"):
        rows = rows.withColumn(name, F.round(name, 6))
    return rows.withColumn("monthly_cost", F.round("monthly_cost", 4))


@query(
    "break_even",
    f"""{CALLS}, {_COST_SQL}
SELECT 'standard' AS first, 'pro' AS second,
  round(100 * 1.2::DOUBLE * (a.avg_cr - b.avg_cr) / 100 * 60 / (100 * (a.fact_loss - b.fact_loss) * 100), 4) AS break_even_minutes
FROM report a, report b WHERE a.system = 'standard' AND b.system = 'pro'""",
)
def break_even(spark, sf_dir):
    rows = U.break_even(U.cost_report(_systems(spark, sf_dir)), "standard", "pro")
    return rows.withColumn("break_even_minutes", F.round("break_even_minutes", 4))


@query(
    "usage_counters",
    f"""SELECT user_id, CAST(sum(event_id % 50) AS BIGINT) AS tokens_saved, CAST(sum(event_id % 30) AS BIGINT) AS pct_sum,
  count(*) AS prompts FROM events GROUP BY user_id""",
)
def usage_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return U.usage_counters(
        events.selectExpr("user_id", "event_id % 50 AS saved", "event_id % 30 AS pct")
    )


@query(
    "history_top",
    """SELECT user_id, event_id, ts, et, pt, CAST(floor((et - pt)::DOUBLE / et * 100 + 0.5) AS BIGINT) AS pct FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM
    (SELECT user_id, event_id, ts, 100 + event_id % 400 AS et, 90 + event_id % 300 AS pt FROM events)) WHERE nth <= 20""",
)
def history_top(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "ts", "100 + event_id % 400 AS et", "90 + event_id % 300 AS pt"
    )
    return U.recent_history(events, 20)


# --- keyed tables -----------------------------------------------------------------------------


@query(
    "latest_by_key",
    f"""{CALLS} SELECT session_id, max_by(call_id, (ts, call_id)) AS call_id, max(ts) AS ts,
  max_by(mode, (ts, call_id)) AS mode FROM calls_v GROUP BY session_id""",
)
def latest_by_key(spark, sf_dir):
    log = calls(spark, sf_dir).select("session_id", "call_id", "ts", "mode")
    return sinks.latest_by_key(log, ["session_id"], ["ts", "call_id"])


@query(
    "upsert",
    """SELECT user_id, max_by(event_type, (ts, event_id)) AS status, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""",
)
def upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id", "event_type AS status", "ts", "event_id")
    order = ["ts", "event_id"]
    current = sinks.latest_by_key(events.filter("event_id % 2 = 0"), ["user_id"], order)
    return sinks.upsert(current, events.filter("event_id % 2 = 1"), ["user_id"], order)


@query(
    "rotate_keys",
    f"""{view_sql('accounts_v')} SELECT CASE WHEN plan = 'team' THEN 'pk_new_' || project_name ELSE api_key END AS api_key,
  email, plan, status, project_name, created_at FROM accounts_v""",
)
def rotate_keys(spark, sf_dir):
    keys = accounts(spark, sf_dir)
    rotations = keys.filter("plan = 'team'").selectExpr(
        "api_key AS old_key", "'pk_new_' || project_name AS new_key"
    )
    return sinks.rotate_keys(keys, rotations)


@query(
    "feedback_contract",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN 'ok'
  ELSE 'rating_out_of_range' END AS reason FROM events) GROUP BY reason""",
)
def feedback_contract(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_type AS original",
        "props AS compressed",
        "CASE WHEN event_id % 8 = 7 THEN NULL ELSE event_id % 8 END AS rating",
        "'' AS comment",
    )
    good, bad = sinks.check_feedback(events)
    rows = good.withColumn("reason", F.lit("ok")).select("reason").unionByName(bad.select("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_append",
    f"""{CALLS} SELECT api_key, original_tokens, compressed_tokens,
  CAST(floor(100 * (original_tokens - compressed_tokens) / original_tokens) AS BIGINT) AS pct_saved, mode, platform,
  epoch_us(ts) AS us, CAST(ts AS DATE) AS day FROM calls_v""",
)
def event_append(spark, sf_dir):
    """Calls appended to the event table in two parts, read back with their days."""
    rows = calls(spark, sf_dir).withColumn(
        "pct_saved", F.floor(100 * (F.col("original_tokens") - F.col("compressed_tokens")) / F.col("original_tokens"))
    )
    folder = run_folder(spark)
    for half in (0, 1):
        sinks.append_events(rows.filter(F.col("call_id") % 2 == half), "compression_events", folder, "ts")
    back = sinks.read_events(spark, "compression_events", folder)
    return back.withColumn("us", F.unix_micros("created_at")).drop("created_at")


@query(
    "feedback_append",
    """SELECT original, rating, count(*) AS n FROM (SELECT event_type AS original, CAST(event_id % 8 AS INTEGER) AS rating
  FROM events WHERE props IS NOT NULL AND event_id % 8 BETWEEN 1 AND 5) GROUP BY ALL""",
)
def feedback_append(spark, sf_dir):
    """Valid feedback appended and read back; the rest is set aside."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type AS original", "props AS compressed", "event_id % 8 AS rating", "'' AS comment", "ts AS created_at"
    )
    folder = run_folder(spark)
    sinks.append_feedback(rows, folder)
    back = sinks.read_events(spark, "feedback", folder)
    return back.groupBy("original", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subscription_status",
    """SELECT user_id, CASE WHEN status IN ('canceled', 'unpaid', 'past_due') THEN 'canceled' ELSE 'active' END AS status
FROM (SELECT user_id, arg_max(CASE event_id % 5 WHEN 0 THEN 'canceled' WHEN 1 THEN 'unpaid' WHEN 2 THEN 'past_due'
  WHEN 3 THEN 'active' ELSE 'trialing' END, (ts, event_id)) AS status FROM events GROUP BY user_id)""",
)
def subscription_status(spark, sf_dir):
    """Each account's status after its last billing event."""
    billing = table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "ts",
        "event_id",
        "element_at(array('canceled', 'unpaid', 'past_due', 'active', 'trialing'), CAST(event_id % 5 AS INT) + 1) AS event",
    )
    last = sinks.latest_by_key(billing, ["user_id"], ["ts", "event_id"])
    return last.select("user_id", sinks.subscription_status(F.col("event")).alias("status"))
