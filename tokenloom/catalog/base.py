"""Query registry, input tables and derived views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.plans.groups import checkpoint_folder
from tokenloom.session import prepare
from tokenloom.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Views with triggers for the pattern operators: whole tables, whole texts. The expressions
# read the same in Spark and in ANSI SQL.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "prompts_v": (
        "documents",
        [
            "doc_id",
            "lang",
            "source",
            """CASE doc_id % 6
    WHEN 0 THEN 'You are an expert in python. Please explain step by step how the database works. Do not use json. '
    WHEN 1 THEN 'I want a summary of quarterly revenue and churn. It must be very concise. Return as json. '
    WHEN 2 THEN 'It should be noted that latency grew from 20 to 45 in 30 seconds. The patient needs treatment and a clinical diagnosis. '
    WHEN 3 THEN 'Use the bucket my-data-bucket at https://example.com/x with timeout=30 seconds (which is a rather long remark here). '
    WHEN 4 THEN 'You should review the contract clause and the agreement with Acme Corp. Never change the policy version 12. '
    ELSE 'Compare javascript and typescript. Avoid bugs. '
  END || text AS text""",
        ],
    ),
    "chat_v": (
        "conversations",
        [
            "conv_id",
            "turn",
            "role",
            """CASE
    WHEN turn % 4 = 3 THEN 'ok thanks, 45 GB noted. ' || text
    WHEN turn % 4 = 0 THEN 'We must use Acme Cloud with 45 GB. The error rate limit is 15 and the region is EU. ' || text
    WHEN turn % 4 = 1 THEN 'Acme Cloud gives 45 GB in EU. The error rate limit of 15 was set. ' || text
    ELSE 'Raise the error rate limit to ' || CAST(20 + conv_id % 30 AS STRING) || ' please. ' || text
  END AS text""",
        ],
    ),
    "secrets_v": (
        "documents",
        [
            "doc_id",
            "'s' || CAST(doc_id % 40 AS STRING) AS session_id",
            "'pk_' || CAST(doc_id % 150 AS STRING) || '_0123' AS api_key",
            """CASE doc_id % 12
    WHEN 0 THEN 'postgres://user:pw@db.example.com:5432/app '
    WHEN 1 THEN 'sk-' || repeat('a1', 12) || ' '
    WHEN 2 THEN '-----BEGIN ' || 'PRIVATE KEY----- '
    WHEN 3 THEN 'ey' || repeat('Ab', 6) || '.ey' || repeat('Cd', 6) || '.' || repeat('Ef', 6) || ' '
    WHEN 4 THEN repeat('APP_NAME=value' || chr(10), 4)
    WHEN 5 THEN repeat('INSERT INTO t VALUES (1, 2); ', 4)
    WHEN 6 THEN 'Traceback (most recent call last) '
    WHEN 7 THEN repeat('a,b,c,d,e' || chr(10), 4)
    WHEN 8 THEN '[' || repeat('{"id": 1, "name": "some value"}, ', 11) || '{"id": 1, "name": "some value"}] '
    ELSE ''
  END || text AS text""",
        ],
    ),
    "calls_v": (
        "events",
        [
            "event_id AS call_id",
            "'s' || CAST(user_id AS STRING) AS session_id",
            "ts",
            "CASE WHEN event_type = 'signup' THEN CAST(1 + event_id % 5 AS INT) END AS n_tools",
            "event_type = 'error' AND event_id % 10 = 0 AS is_clear",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'pk_' || CAST(user_id AS STRING) || '_0123' END AS api_key",
            "CAST(100 + event_id % 400 AS BIGINT) AS original_tokens",
            "CAST(90 + event_id % 300 AS BIGINT) AS compressed_tokens",
            "CASE event_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'pro' ELSE 'developer' END AS mode",
            "'ip:10.0.0.' || CAST(user_id % 20 AS STRING) AS platform",
        ],
    ),
    "tools_v": (
        "part",
        [
            "CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS catalog_id",
            "p_partkey AS pos",
            """CASE p_partkey % 3
    WHEN 0 THEN '{"type":"function","function":{"name":"tool_' || CAST(p_partkey AS STRING) || '","description":"' || p_name || '","parameters":{"properties":{"query":{"type":"string"},"limit":{"type":"integer","default":10}},"required":["query"]}}}'
    WHEN 1 THEN '{"name":"tool_' || CAST(p_partkey AS STRING) || '","description":"' || p_name || '","input_schema":{"properties":{"region":{"type":"string"},"user_id":{"type":"string"}},"required":["region"]}}'
    ELSE '{"name":"tool_' || CAST(p_partkey AS STRING) || '","description":"' || p_name || '","parameters":{"properties":{"region":{"type":"string","enum":["eu","us","ap","sa"]},"verbose":{"type":"boolean"}}}}'
  END AS tool_json""",
        ],
    ),
}
ACCOUNTS = [
    "'pk_' || CAST(user_id AS STRING) || '_0123' AS api_key",
    "'u' || CAST(user_id % 40 AS STRING) || '@example.com' AS email",
    "CASE WHEN user_id % 40 < 10 THEN 'team' ELSE 'solo' END AS plan",
    "CASE WHEN user_id % 13 = 0 THEN 'canceled' ELSE 'active' END AS status",
    "'project' || CAST(user_id AS STRING) AS project_name",
]
HEAVY = {"documents", "conversations", "pages", "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "accounts_v":
        return (
            table(spark, sf_dir, "events").groupBy("user_id").agg({"ts": "min"})
            .withColumnRenamed("min(ts)", "created_at")
            .selectExpr(*ACCOUNTS, "created_at")
        )
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def view_sql(*names: str) -> str:
    """``WITH`` list of the named views."""
    parts = []
    for name in names:
        if name == "accounts_v":
            body = (
                f"SELECT {', '.join(ACCOUNTS)}, created_at FROM "
                "(SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id)"
            )
        else:
            source, columns = VIEWS[name]
            body = f"SELECT {', '.join(columns)} FROM {source}"
        parts.append(f"{name} AS ({body})")
    return "WITH RECURSIVE " + ",\n".join(parts)


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for what a query writes and reads back."""
    return f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- SQL fragments shared by the checks -----------------------------------------------------------
_Q = "''"


def token_words_sql(text: str) -> str:
    return rf"""len(regexp_extract_all({text}, '[^\s,.:;!?()\[\]{{}}"'']+'))"""


def tokens_sql(words: str) -> str:
    return f"greatest(1, CAST(ceil(CAST(1.3 AS DOUBLE) * ({words})) AS BIGINT))"


def token_count_sql(text: str) -> str:
    return tokens_sql(token_words_sql(text))


def space_words_sql(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '\S+'))"


def strip_sql(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def words_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def sentences_sql(text: str) -> str:
    marked = rf"regexp_replace({strip_sql(text)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip_sql('s')})"
    return f"list_filter({parts}, lambda s: s <> '')"


def ascii_sql(text: str, mark: str) -> str:
    """Non-ASCII letters as ``mark``, a word character the pattern does not name."""
    return rf"regexp_replace({text}, '[^\x00-\x7F]', '{mark}', 'g')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def count_sql(text: str, pattern: str) -> str:
    """Matches of a lower-case pattern in any case, with Unicode word borders."""
    return f"len(regexp_extract_all({ascii_sql(f'lower({text})', 'Z')}, {quoted(pattern)}))"


def entities_sql(text: str) -> str:
    from tokenloom.functions.text import ENTITY_PATTERN

    found = f"regexp_extract_all({ascii_sql(text, '_')}, {quoted(ENTITY_PATTERN)})"
    stripped = f"list_transform({found}, lambda e: {strip_sql('e')})"
    return f"list_distinct(list_filter({stripped}, lambda e: len(e) > 1))"


def density_sql(text: str) -> str:
    from tokenloom.functions.text import FACT_PATTERN

    pattern = FACT_PATTERN
    for upper in ("GB", "MB", "KB", "|M)"):
        pattern = pattern.replace(upper, upper.lower())
    hits = count_sql(text, pattern)
    words = f"greatest({space_words_sql(text)}, 1)"
    return f"least(1.0::DOUBLE, {hits}::DOUBLE / greatest({words} * 0.1::DOUBLE, 1.0::DOUBLE))"


def key_sql(sentence: str) -> str:
    return rf"regexp_replace(lower({sentence}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def in_list(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"
