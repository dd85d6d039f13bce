"""Structured Streaming twins of the batch jobs.

Texts are measured by column functions before the state step; the handlers only walk the few
rows one micro-batch brings per key, in event order. They refer to plain values only, so
workers need not have this package installed. Keyed state is forgotten after
``forget_after`` of event time without activity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenloom.functions import text as T
from tokenloom.operators import context as C
from tokenloom.operators import usage as U
from tokenloom.operators.safety import sensitive_events

DAY_MS = 86_400_000


def _by_key(
    stream: DataFrame,
    key: str,
    order: list[str],
    output: str,
    state: str,
    start: tuple,
    handle: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]],
    forget_ms: int,
    lateness: str,
) -> DataFrame:
    """Run ``handle(state, rows in order)`` per key; the state's first field is the newest time."""

    def run(_, chunks: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable")
        value = group.get if group.exists else start
        value, out = handle(value, rows)
        group.update(value)
        group.setTimeoutTimestamp(
            max(int(value[0]) // 1000, group.getCurrentWatermarkMs()) + forget_ms
        )
        yield out

    return (
        stream.withWatermark("ts", lateness)
        .groupBy(key)
        .applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def stream_tool_cache(
    calls: DataFrame,
    ttl_s: int = U.CACHE_TTL_S,
    forget_after_days: int = 30,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Tool cache over a call stream: ``call_id, session_id, ts, n_tools, is_clear``."""
    span, per_tool, billed = ttl_s * 1_000_000, T.TOKENS_PER_TOOL, U.CACHED_SHARE

    def handle(state: tuple, rows: pd.DataFrame):
        newest, tools, last = state
        out = []
        for call in rows.itertuples(index=False):
            newest = max(newest, call.us)
            if call.is_clear:
                tools, last = 0, 0
                continue
            hit = False
            if call.n_tools > 0:
                tools, last = call.n_tools, max(last, call.us)
            elif tools > 0:
                hit = call.us - last <= span
                last = max(last, call.us)
            size = tools * per_tool
            saved = size - int(size * billed) if hit else 0
            out.append((call.call_id, call.session_id, tools or None, hit, saved))
        columns = ["call_id", "session_id", "tools", "cache_hit", "tokens_saved"]
        made = pd.DataFrame(out, columns=columns)
        made["tools"] = made["tools"].astype("Int32")
        return (int(newest), int(tools), int(last)), made

    slim = calls.select(
        "call_id",
        "session_id",
        "ts",
        F.coalesce("n_tools", F.lit(0)).alias("n_tools"),
        "is_clear",
        _micros().alias("us"),
    )
    return _by_key(
        slim,
        "session_id",
        ["us", "call_id"],
        "call_id long, session_id string, tools int, cache_hit boolean, tokens_saved long",
        "newest long, tools int, last long",
        (0, 0, 0),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )


def stream_sensitive(stream: DataFrame, text: str = "text") -> DataFrame:
    """Stateless: one event per text with a hit."""
    return sensitive_events(stream, text)


def stream_delta_prune(
    conv: DataFrame, forget_after_days: int = 7, lateness: str = "10 minutes"
) -> DataFrame:
    """Novelty decisions over a message stream: ``conv_id, turn, role, text, ts``."""
    min_new = C.MIN_NEW_WORDS

    def handle(state: tuple, rows: pd.DataFrame):
        newest, known = state[0], set(state[1])
        kept = []
        for m in rows.itertuples(index=False):
            newest = max(newest, m.us)
            keep = (
                m.role == "system"
                or not known.issuperset(m.ents)
                or len(set(m.words) - known) > min_new
            )
            if keep:
                known.update(m.ents)
                known.update(m.words)
            kept.append(keep)
        out = rows[["conv_id", "turn"]].assign(kept=kept)
        return (int(newest), sorted(known)), out

    slim = conv.select(
        "conv_id",
        "turn",
        "role",
        "ts",
        _micros().alias("us"),
        T.entities(F.col("text")).alias("ents"),
        T.word_set(F.col("text"), T.NOVELTY_STOP).alias("words"),
    )
    return _by_key(
        slim,
        "conv_id",
        ["turn"],
        "conv_id long, turn long, kept boolean",
        "newest long, known array<string>",
        (0, []),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )


def stream_summary(
    conv: DataFrame,
    budget: int = C.SUMMARY_BUDGET,
    forget_after_days: int = 7,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Rolling summary: each micro-batch's messages update the conversation's summary."""
    max_words = int(budget / T.TOKENS_PER_WORD)

    def handle(state: tuple, rows: pd.DataFrame):
        newest, old = max(state[0], int(rows["us"].max())), state[1]
        ranked = sorted((s for m in rows["sents"] for s in m), key=lambda s: -s["score"])
        seen, picked, room = set(), [], budget
        for s in ranked:
            if s["key"] in seen:
                continue
            seen.add(s["key"])
            if s["tokens"] <= room:
                picked.append(s["sent"])
                room -= s["tokens"]
        if not picked:
            users = rows.loc[rows["role"] == "user", "first"]
            picked = [users.iloc[0]] if len(users) and users.iloc[0] else []
        summary = " ".join(picked)
        if old:
            summary = f"{old.rstrip()} {summary}".strip()
            words = summary.split()
            if len(words) > max_words:
                summary = " ".join(words[-max_words:])
        out = pd.DataFrame({"conv_id": [rows["conv_id"].iloc[0]], "summary": [summary]})
        return (newest, summary), out

    slim = conv.select(
        "conv_id", "turn", "role", "ts", _micros().alias("us"), T.sentences(F.col("text")).alias("_all")
    )

    def measured(s: Column) -> Column:
        value = F.when(F.col("role") == "user", T.intent_score(s)).otherwise(T.fact_density(s) * 4.0)
        return F.struct(
            value.alias("score"),
            T.sentence_key(s).alias("key"),
            T.token_count(s).alias("tokens"),
            s.alias("sent"),
        )

    usable = F.filter(F.transform("_all", measured), lambda s: s["score"] > 0)
    slim = slim.select(
        "conv_id",
        "turn",
        "role",
        "ts",
        "us",
        F.get("_all", F.lit(0)).alias("first"),
        F.when(F.col("role") == "system", F.filter(usable, lambda s: F.lit(False)))
        .otherwise(usable)
        .alias("sents"),
    )
    return _by_key(
        slim,
        "conv_id",
        ["turn"],
        "conv_id long, summary string",
        "newest long, summary string",
        (0, ""),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )


def stream_stats(
    events: DataFrame, keys: tuple[str, ...] = ("mode",), lateness: str = "1 hour"
) -> DataFrame:
    """Usage and savings per hour and key; rows older than the watermark are dropped."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("tokens_saved"),
        )
        .select(F.col("window.start").alias("hour"), *keys, "n", "tokens_saved")
    )


def stream_limits(
    events: DataFrame,
    kind: str,
    key: str,
    limit: int,
    minutes: int = U.CHAT_MINUTES,
    forget_after_days: int = 62,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Accept or refuse each event (``event_id, <key>, ts``).

    ``kind`` is ``monthly`` or ``daily`` (calendar periods, UTC) or ``sliding``. Refused events
    do not count. Every period of a key has a count of its own, so a late event counts in its own
    period and leaves the others as they are.
    """
    periods = {"monthly": "yyyy-MM", "daily": "yyyy-MM-dd", "sliding": None}
    if kind not in periods:
        raise ValueError(f"kind must be one of {', '.join(periods)}")
    pattern = periods[kind]
    if pattern is None:
        return _stream_sliding(events, key, limit, minutes, forget_after_days, lateness)

    def handle(state: tuple, rows: pd.DataFrame):
        newest, used = state[0], dict(zip(state[1], state[2]))
        allowed = []
        for period, us in zip(rows["period"], rows["us"]):
            newest = max(newest, us)
            ok = used.get(period, 0) < limit
            used[period] = used.get(period, 0) + ok
            allowed.append(ok)
        out = rows[["event_id"]].assign(allowed=allowed)
        return (int(newest), list(used), [int(n) for n in used.values()]), out

    # A group has the periods of a key and month: one for every day costs most of the time in Python.
    slot = F.to_json(F.struct(F.col(key).alias("key"), F.date_format("ts", "yyyy-MM").alias("month")))
    period = F.coalesce(F.date_format("ts", pattern), F.lit("")).alias("period")
    slim = events.select("event_id", slot.alias("slot"), period, "ts", _micros().alias("us"))
    return _by_key(
        slim,
        "slot",
        ["us", "event_id"],
        "event_id long, allowed boolean",
        "newest long, periods array<string>, used array<long>",
        (0, [], []),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )


def _stream_sliding(
    events: DataFrame, key: str, limit: int, minutes: int, forget_after_days: int, lateness: str
) -> DataFrame:
    span = minutes * 60 * 1_000_000

    def handle(state: tuple, rows: pd.DataFrame):
        newest, recent = state[0], list(state[1])
        allowed = []
        for us in rows["us"]:
            newest = max(newest, us)
            recent = [t for t in recent if t > us - span]
            ok = len(recent) < limit
            if ok:
                recent.append(int(us))
            allowed.append(ok)
        out = rows[["event_id"]].assign(allowed=allowed)
        return (int(newest), recent), out

    slot = F.to_json(F.struct(F.col(key).alias("key"), F.lit("").alias("period")))
    slim = events.select("event_id", slot.alias("slot"), "ts", _micros().alias("us"))
    return _by_key(
        slim,
        "slot",
        ["us", "event_id"],
        "event_id long, allowed boolean",
        "newest long, recent array<long>",
        (0, []),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )


def stream_seen_tools(
    tool_turns: DataFrame, forget_after_days: int = 30, lateness: str = "10 minutes"
) -> DataFrame:
    """New and already sent tools per request (``session_id, turn, tools, ts``).

    The checkpoint keeps the sent set across restarts.
    """

    def handle(state: tuple, rows: pd.DataFrame):
        newest, sent = max(state[0], int(rows["us"].max())), set(state[1])
        out = []
        for request in rows.itertuples(index=False):
            names = list(request.tools)
            out.append(
                (
                    request.session_id,
                    request.turn,
                    [n for n in names if n not in sent],
                    [n for n in names if n in sent],
                )
            )
            sent.update(names)
        columns = ["session_id", "turn", "new_tools", "cached_tools"]
        return (newest, sorted(sent)), pd.DataFrame(out, columns=columns)

    slim = tool_turns.select("session_id", "turn", "tools", "ts", _micros().alias("us"))
    return _by_key(
        slim,
        "session_id",
        ["turn"],
        "session_id string, turn long, new_tools array<string>, cached_tools array<string>",
        "newest long, sent array<string>",
        (0, []),
        handle,
        forget_after_days * DAY_MS,
        lateness,
    )
