"""Scan texts for secrets and data dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.columns import let
from tokenloom.functions.text import unicode_pattern

# --- fixed values: categories in report order ---------------------------------------------------
# name, level, lower-case pieces of which one must occur, ignore case, pattern. Repeats are cut
# at the count that decides, since more of the same changes nothing; a table's first line is
# read from its last five cells.
_CELL = r"[^\n,]{1,60}"
CATEGORIES = [
    (
        "CONNECTION_STRING",
        "HIGH",
        ["://"],
        True,
        r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|mssql|sqlserver)://\S{10}",
    ),
    (
        "API_KEY",
        "HIGH",
        ["sk-", "akia", "ghp_", "gho_", "xoxb-", "aiza"],
        True,
        r"sk-[A-Za-z0-9]{20}"
        r"|AKIA[0-9A-Z]{16}"
        r"|ghp_[A-Za-z0-9]{36}"
        r"|gho_[A-Za-z0-9]{36}"
        r"|xoxb-\d{9,}-\S{20}"
        r"|AIza[0-9A-Za-z_\-]{35}",
    ),
    (
        "PRIVATE_KEY",
        "HIGH",
        ["private key-----"],
        False,
        r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    ),
    (
        "JWT",
        "HIGH",
        [".ey"],
        False,
        r"ey[A-Za-z0-9_\-]{10,}\.ey[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10}",
    ),
    (
        "ENV_FILE",
        "HIGH",
        ["="],
        False,
        r"(?m)(?:(?:^|\n)[A-Z][A-Z0-9_]{2,}=[^\n]{3,}\n){3}",
    ),
    ("SQL_DUMP", "MEDIUM", ["insert"], True, r"(?:INSERT\s+INTO\s+\w+[^;]{5,};\s*){3}"),
    (
        "STACK_TRACE",
        "MEDIUM",
        ["traceback (most recent call last)"],
        True,
        r"Traceback \(most recent call last\)",
    ),
    (
        "CSV_DATA",
        "MEDIUM",
        [","],
        False,
        rf"[^\n,](?:,{_CELL}){{4}}\n(?:{_CELL},){{4}}{_CELL}\n(?:{_CELL},){{4}}",
    ),
    (
        "LARGE_JSON",
        "MEDIUM",
        ["{"],
        False,
        r"\[\s*\{[^{}]{20,}+\}(?:\s*,\s*\{[^{}]{20,}+\}){9,}+\s*\]",
    ),
]
# --- end of fixed values ---------------------------------------------------------------------------


def hits_column(text: Column) -> Column:
    """Array of (category, risk_level) in report order, HIGH first; each category once."""

    def scan(t: Column) -> Column:
        def test(low: Column) -> Column:
            tests = []
            for name, level, pieces, ignore_case, pattern in CATEGORIES:
                possible = F.lit(False)
                for piece in pieces:
                    possible = possible | F.contains(low, F.lit(piece))
                found = possible & t.rlike(unicode_pattern(pattern, ignore_case))
                hit = F.struct(F.lit(name).alias("category"), F.lit(level).alias("risk_level"))
                tests.append(F.when(found, hit))
            return F.filter(F.array(*tests), lambda h: h.isNotNull())

        return let(F.lower(t), test)

    return let(text, scan)


def sensitive_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per text and category found. The matched text is never kept."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.inline(hits_column(F.col(text))))


def sensitive_events(df: DataFrame, text: str = "text") -> DataFrame:
    """One event per text with a hit: its categories in report order and the highest risk."""
    kept = [c for c in df.columns if c != text]

    # An inlined array of one or no event: a filter would be pushed below and scan twice.
    def event(hits: Column) -> Column:
        is_high = F.exists(hits, lambda h: h["risk_level"] == "HIGH")
        made = F.struct(
            F.transform(hits, lambda h: h["category"]).alias("categories"),
            F.when(is_high, "HIGH").otherwise("MEDIUM").alias("risk_level"),
        )
        return F.when(F.size(hits) > 0, F.array(made))

    return df.select(*kept, F.inline(let(hits_column(F.col(text)), event)))


def key_hint(key: Column) -> Column:
    return F.when(key != "", F.concat(F.substring(key, 1, 8), F.lit("...")))


EVENT_LIMIT = 100


def account_events(events: DataFrame, keys: DataFrame, caller_key: str) -> DataFrame:
    """Events of every key that belongs to the caller's account."""
    mine = keys.filter(F.col("api_key") == caller_key).select("email").distinct()
    account = keys.join(mine, "email", "left_semi").select("api_key")
    return events.join(account, "api_key", "left_semi").select(
        "session_id",
        key_hint(F.col("api_key")).alias("api_key_hint"),
        "ts",
        "categories",
        "risk_level",
    )


def latest_events(events: DataFrame, limit: int = EVENT_LIMIT, order: str = "ts") -> DataFrame:
    """The ``limit`` newest events, newest first, keys shown as hints.

    Events of the same time are ordered by session, key and categories, so that the cut is the same
    each time.
    """
    newest = events.orderBy(F.desc(order), "session_id", "api_key", "categories", "risk_level")
    return newest.limit(limit).select(
        "session_id",
        key_hint(F.col("api_key")).alias("api_key_hint"),
        order,
        "categories",
        "risk_level",
    )
