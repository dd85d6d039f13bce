"""Queries over tool catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.base import query, table, token_words_sql, tokens_sql, view, view_sql
from tokenloom.operators import tools as O
from tokenloom.plans.groups import cut_lineage

TOOLS = view_sql("tools_v")


def catalog(spark, sf_dir):
    return view(spark, sf_dir, "tools_v")


# The three shapes of the derived view, spelled out by hand.
_PARAMS_SQL = """params AS (SELECT catalog_id, pos, tool, param_no, name, type FROM
  (SELECT CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS catalog_id, p_partkey AS pos, 'tool_' || p_partkey AS tool,
    unnest([0, 1]) AS param_no,
    unnest(CASE p_partkey % 3 WHEN 0 THEN ['query', 'limit'] WHEN 1 THEN ['region', 'user_id'] ELSE ['region', 'verbose'] END) AS name,
    unnest(CASE p_partkey % 3 WHEN 0 THEN ['str', 'int'] WHEN 1 THEN ['str', 'str'] ELSE ['str', 'bool'] END) AS type
   FROM part)),
registry AS (SELECT catalog_id, CAST(1 AS BIGINT) AS rank, '§T1' AS symbol, name, type, count(*) AS n_tools
  FROM params WHERE name = 'region' GROUP BY catalog_id, name, type HAVING count(*) >= 3)"""


@query(
    "normalise_tools",
    f"""WITH {_PARAMS_SQL} SELECT catalog_id, pos, tool AS name, string_agg(name || ':' || type, ',' ORDER BY param_no) AS params
FROM params GROUP BY ALL""",
)
def normalise_tools(spark, sf_dir):
    tools = O.normalise_tools(catalog(spark, sf_dir))
    shown = F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"]))
    return tools.select("catalog_id", "pos", "name", F.array_join(shown, ",").alias("params"))


@query("tools_registry", f"WITH {_PARAMS_SQL} SELECT * FROM registry")
def tools_registry(spark, sf_dir):
    # Stored before the parameters are grouped, which is much faster than in one plan.
    return O.param_registry(cut_lineage(O.normalise_tools(catalog(spark, sf_dir))))


_LINES_SQL = """lines AS (SELECT catalog_id, pos, name, CASE WHEN len(comment) > 80 THEN head || left(comment, 77) || '…'
    ELSE head || comment END AS line FROM
  (SELECT CAST(floor((p_partkey - 1) / 40) AS BIGINT) AS catalog_id, p_partkey AS pos, 'tool_' || p_partkey AS name,
    'tool_' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '(query, limit=10)'
      WHEN 1 THEN '(' || coalesce(symbol, 'region: str') || ', user_id)'
      ELSE '(' || coalesce(symbol, 'region: eu|us|ap') || ', verbose)' END AS head, '  # ' || p_name AS comment
   FROM part LEFT JOIN registry ON registry.catalog_id = CAST(floor((p_partkey - 1) / 40) AS BIGINT)))"""


# The short form of signatures: what is left out is told by this form, not by the operator.
SHORT = {"max_enum": O.MAX_ENUM, "max_comment": O.MAX_COMMENT}


@query("tool_lines", f"WITH {_PARAMS_SQL}, {_LINES_SQL} SELECT * FROM lines")
def tool_lines(spark, sf_dir):
    # Read three times: parsed once.
    tools = cut_lineage(O.normalise_tools(catalog(spark, sf_dir)))
    return O.tool_lines(tools, O.param_registry(tools), **SHORT).select("catalog_id", "pos", "name", "line")


def _dsl_sql(cached: str) -> str:
    return f"""{TOOLS}, {_PARAMS_SQL}, {_LINES_SQL},
bodies AS (SELECT catalog_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT ({cached})) AS body,
    coalesce(list(name ORDER BY pos) FILTER (NOT ({cached})), []) AS new_tools,
    coalesce(list(name ORDER BY pos) FILTER ({cached}), []) AS cached_tools FROM lines GROUP BY catalog_id),
sizes AS (SELECT catalog_id, {tokens_sql(f"CAST(sum({token_words_sql('tool_json')}) AS BIGINT)")} AS original_tokens
  FROM tools_v GROUP BY catalog_id),
texts AS (SELECT catalog_id, concat_ws(chr(10), 'TYPES:{{' || symbol || '=' || registry.name || ': ' || type || '}}',
    CASE WHEN len(cached_tools) > 0 THEN 'TOOLS:[' || array_to_string(cached_tools, ',') || ']' END, body) AS dsl,
    len(cached_tools) AS cached_count, new_tools, cached_tools
  FROM bodies LEFT JOIN registry USING (catalog_id))
SELECT catalog_id, dsl, original_tokens, compressed_tokens, round_even(1 - compressed_tokens::DOUBLE / original_tokens, 4) AS cr,
  cached_count, new_tools, cached_tools
FROM (SELECT *, {tokens_sql(token_words_sql('dsl'))} AS compressed_tokens FROM texts) JOIN sizes USING (catalog_id)"""


@query("tools_dsl", _dsl_sql("false"))
def tools_dsl(spark, sf_dir):
    good = catalog(spark, sf_dir)
    return O.compile_tools(good, **SHORT)


@query("tools_dsl_next_turn", _dsl_sql("pos % 4 = 0"))
def tools_dsl_next_turn(spark, sf_dir):
    good = catalog(spark, sf_dir)
    seen = good.filter("pos % 4 = 0").selectExpr(
        "catalog_id", "'tool_' || CAST(pos AS STRING) AS name"
    )
    return O.compile_tools(good, seen, **SHORT)


@query(
    "catalog_contract",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY c) > 128 THEN 'too_many_tools'
  ELSE 'ok' END AS reason FROM (SELECT CASE WHEN p_partkey % 10 < 4 THEN -1 ELSE floor((p_partkey - 1) / 40) END AS c FROM part))
GROUP BY reason""",
)
def catalog_contract(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn(
        "catalog_id", F.expr("CASE WHEN pos % 10 < 4 THEN -1 ELSE catalog_id END")
    )
    good, bad = O.accept_catalogs(rows)
    marked = good.withColumn("reason", F.lit("ok")).select("reason").unionByName(bad.select("reason"))
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def tool_turns(spark, sf_dir):
    """Requests that name tools: a few of ten names per call, in order."""
    return table(spark, sf_dir, "events").selectExpr(
        "'s' || CAST(user_id AS STRING) AS session_id",
        "event_id AS turn",
        "ts",
        "transform(sequence(0, CAST(event_id % 4 AS INT)), i -> 'tool_' || CAST((event_id + 3 * i) % 10 AS STRING)) AS tools",
    )


SEEN_SQL = """WITH turns AS (SELECT 's' || CAST(user_id AS STRING) AS session_id, event_id AS turn,
    unnest(range(0, event_id % 4 + 1)) AS pos, 'tool_' || ((event_id + 3 * unnest(range(0, event_id % 4 + 1))) % 10) AS tool
  FROM events),
firsts AS (SELECT session_id, tool, min(turn) AS first FROM turns GROUP BY ALL)
SELECT session_id, turn, coalesce(list(tool ORDER BY pos) FILTER (turn = first), []) AS new_tools,
  coalesce(list(tool ORDER BY pos) FILTER (turn > first), []) AS cached_tools
FROM turns JOIN firsts USING (session_id, tool) GROUP BY session_id, turn"""


@query("seen_tools", SEEN_SQL)
def seen_tools(spark, sf_dir):
    turns = tool_turns(spark, sf_dir)
    rows = turns.select("session_id", "turn", F.posexplode("tools").alias("pos", "tool"))
    return O.split_seen_tools(rows)
