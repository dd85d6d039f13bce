import json

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import safety as S
from tokenloom.operators import tools as O
from tokenloom.sources import readers, sinks

SECRETS = {
    "CONNECTION_STRING": "see MongoDB+SRV://user:pw@host.example/x",
    "API_KEY": "key SK-" + "a1" * 10 + " end",
    "PRIVATE_KEY": "-----BEGIN RSA PRIVATE KEY-----",
    "JWT": "ey" + "Ab" * 5 + ".ey" + "Cd" * 5 + "." + "Ef" * 5,
    "ENV_FILE": "x\nAPP_A=one\nAPP_B=two\nAPP_C=three\n",
    "SQL_DUMP": "insert into t values (1);\n" * 3,
    "STACK_TRACE": "TRACEBACK (most recent call last) here",
    "CSV_DATA": "a,b,c,d,e\n1,2,3,4,5\n6,7,8,9,0",
    "LARGE_JSON": "[" + ", ".join('{"id": 1, "name": "some value"}' for _ in range(10)) + "]",
}
HARMLESS = [
    "postgres://short and nothing else here",
    "a text with sk-short and akia inside it",
    "APP_A=one\nAPP_B=two\nnothing here at all",
    "a,b,c,d,e\n1,2,3,4,5,6\n6,7,8,9,0 extra",
    "a,b,c,d,e\n\n1,2,3,4,5\n6,7,8,9,0",
    "[" + ", ".join('{"id": 1, "name": "some value"}' for _ in range(9)) + "]",
]


def scan(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [r["category"] for r in S.sensitive_scan(df).collect()]


@pytest.mark.parametrize("category", SECRETS)
def test_each_category(spark, category):
    assert scan(spark, "some words first " + SECRETS[category]) == [category] or category == "ENV_FILE"
    assert category in scan(spark, SECRETS[category] + " and some words after it")


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(spark, text):
    assert scan(spark, text) == []


def test_short_text_is_scanned(spark):
    text = "mysql://abcdefghij"
    assert len(text) == 18 and scan(spark, text) == ["CONNECTION_STRING"]


def test_long_dumps_do_not_overflow(spark):
    objects = ", ".join('{"id": 1, "name": "some value"}' for _ in range(20_000))
    assert "LARGE_JSON" in scan(spark, f"[{objects}]")
    assert "SQL_DUMP" in scan(spark, "INSERT INTO t VALUES (1, 2);\n" * 20_000)
    assert "ENV_FILE" in scan(spark, "APP_NAME=value\n" * 20_000)


def test_event_order_and_risk(spark):
    text = SECRETS["STACK_TRACE"] + " " + SECRETS["JWT"]
    df = spark.createDataFrame([(text, "s")], "text string, session_id string")
    row = S.sensitive_events(df).first()
    assert row["categories"] == ["JWT", "STACK_TRACE"] and row["risk_level"] == "HIGH"
    assert "text" not in row.asDict()


# --- tools ----------------------------------------------------------------------------------------


def catalogue(spark, *tools):
    rows = [(1, i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(tools)]
    return spark.createDataFrame(rows, "catalog_id long, pos long, tool_json string")


def tool(name, props, required=(), description="", key="parameters"):
    return {"name": name, "description": description, key: {"properties": props, "required": list(required)}}


def lines(spark, *tools, short=True):
    made = O.normalise_tools(catalogue(spark, *tools))
    limits = {"max_enum": O.MAX_ENUM, "max_comment": O.MAX_COMMENT} if short else {}
    rows = O.tool_lines(made, O.param_registry(made), **limits).orderBy("pos").collect()
    return [r["line"] for r in rows]


def test_dialects_and_order(spark):
    wrapped = {"type": "function", "function": tool("f", {"b": {"type": "integer"}, "a": {"type": "string"}}, ["b"])}
    schema = tool(" g ", {"user_id": {"type": "string"}, "n": {"type": "integer"}}, key="input_schema")
    unnamed = tool("", {})
    assert lines(spark, wrapped, schema, unnamed) == ["f(b: int, a: str)", "g(n, user_id)"]


@pytest.mark.parametrize(
    "schema, shown",
    [
        ({"type": "string"}, "x: str"),
        ({"type": "custom"}, "x: custom"),
        ({}, "x"),
        ({"type": "null"}, "x: None"),
        ({"type": "integer", "default": 3}, "x: int=3"),
        ({"type": "string", "default": "it"}, "x='it'"),
        ({"type": "string", "default": "it's"}, 'x="it\'s"'),
        ({"type": "boolean", "default": False}, "x: bool=False"),
        ({"type": "string", "enum": ["a", "b", "c", "d"]}, "x: a|b|c"),
        ({"type": "string", "enum": ["a"], "default": "a"}, "x: a='a'"),
        ({"type": "integer", "enum": [0, 1], "default": 0}, "x: 0|1"),
        ({"type": "string", "default": None}, "x: str"),
    ],
)
def test_parameter_forms(spark, schema, shown):
    assert lines(spark, tool("f", {"x": schema})) == [f"f({shown})"]


def test_obvious_names(spark):
    props = {
        "page_size": {"type": "integer"},
        "is_active": {"type": "boolean"},
        "is_blue": {"type": "boolean"},
        "tags": {"type": "array"},
        "Query": {"type": "string"},
    }
    assert lines(spark, tool("f", props)) == ["f(Query, is_active, is_blue: bool, page_size, tags)"]


def test_comment_is_cut(spark):
    exact = lines(spark, tool("f", {}, description="d" * 76))[0]
    assert exact == "f()  # " + "d" * 76
    cut = lines(spark, tool("f", {}, description="d" * 77))[0]
    assert cut == "f()  # " + "d" * 73 + "…"


def test_nothing_is_cut_unless_asked_for(spark):
    choices = [f"c{i}" for i in range(9)]
    made = tool("f", {"x": {"type": "string", "enum": choices}}, description="d" * 300)
    assert lines(spark, made, short=False) == [f"f(x: {'|'.join(choices)})  # " + "d" * 300]
    whole = O.compile_tools(catalogue(spark, made)).first()["dsl"]
    assert "|".join(choices) in whole and "d" * 300 in whole


def test_registry_and_cache(spark):
    shared = {"region": {"type": "string"}}
    tools = [tool(f"t{i}", {**shared, "z": {"type": "number"}} if i < 3 else shared) for i in range(4)]
    seen = spark.createDataFrame([(1, "t0")], "catalog_id long, name string")
    row = O.compile_tools(catalogue(spark, *tools), seen).first()
    assert row["dsl"] == (
        "TYPES:{§T1=region: str, §T2=z: float}\nTOOLS:[t0]\nt1(§T1, §T2)\nt2(§T1, §T2)\nt3(§T1)"
    )
    assert row["new_tools"] == ["t1", "t2", "t3"] and row["cached_tools"] == ["t0"]


# --- sources and sinks ----------------------------------------------------------------------------


def test_contracts(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "tool", "b"), (1, 2, None, "c"), (1, 3, "user", None), (1, 4, "user", "\ue000\ue013")],
        "conv_id long, turn long, role string, text string",
    )
    good, bad = readers.read_conversations(conv)
    assert [r["turn"] for r in good.orderBy("turn").collect()] == [0, 4]
    reasons = {r["turn"]: r["reason"] for r in bad.collect()}
    assert reasons == {1: "unknown_role", 2: "missing_role", 3: "missing_text"}

    requests = spark.createDataFrame(
        [(1, " q ", None), (2, " ", "lossless"), (3, "q", "fast")], "conv_id long, query string, mode string"
    )
    good, bad = readers.read_requests(requests)
    assert [tuple(r) for r in good.collect()] == [(1, "q", "lossless")]
    assert {r["reason"] for r in bad.collect()} == {"missing_query", "unknown_mode"}


def test_request_text(spark):
    blocks = json.dumps([{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}])
    df = spark.createDataFrame([([("user", "a"), ("user", blocks)],)], "messages array<struct<role:string,content:string>>")
    assert readers.request_text(df).first()["text"] == "a\nx\ny"


def test_events_and_feedback(spark, tmp_path):
    rows = [("o", "c", r, "", "2024-01-0%d 10:00:00" % (i + 1)) for i, r in enumerate([1, 5, 0, 6])]
    df = spark.createDataFrame(rows, "original string, compressed string, rating int, comment string, created_at string")
    bad = sinks.append_feedback(df, str(tmp_path))
    assert bad.count() == 2
    stored = sinks.read_events(spark, "feedback", str(tmp_path))
    assert stored.count() == 2 and stored.filter("day = DATE'2024-01-01'").count() == 1


def test_upsert_and_rotation(spark):
    schema = "k string, v int, ts long"
    current = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], schema)
    changes = spark.createDataFrame([("a", 2, 5), ("b", 2, 4), ("c", 2, 1)], schema)
    out = {r["k"]: r["v"] for r in sinks.upsert(current, changes, ["k"], ["ts"]).collect()}
    assert out == {"a": 2, "b": 1, "c": 2}

    keys = spark.createDataFrame([("old", 7), ("same", 1)], "api_key string, tokens_saved long")
    rotated = sinks.rotate_keys(keys, spark.createDataFrame([("old", "new")], "old_key string, new_key string"))
    assert {tuple(r) for r in rotated.collect()} == {("new", 7), ("same", 1)}
    states = spark.createDataFrame([("unpaid",), ("paid",)], "e string")
    assert [r[0] for r in states.select(sinks.subscription_status(F.col("e"))).collect()] == ["canceled", "active"]


def test_a_catalogue_in_one_file_is_parsed_by_all_cores_and_once(spark, tmp_path):
    from tokenloom.catalog import QUERIES
    from tokenloom.catalog.tool_queries import catalog

    parts = spark.range(1, 81).select(F.col("id").alias("p_partkey"), F.lit("a small part").alias("p_name"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert catalog(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    lines = QUERIES["tool_lines"](spark, str(tmp_path))
    # The tools come from the store: no part of the plan reads and parses the file again.
    assert not lines.inputFiles()
    assert lines.count() == 80


def test_the_registry_reads_stored_tools(spark, tmp_path, monkeypatch):
    from tokenloom.catalog import QUERIES, tool_queries

    given, plain = [], O.param_registry
    monkeypatch.setattr(tool_queries.O, "param_registry", lambda tools: given.append(tools) or plain(tools))
    parts = spark.range(1, 41).select(F.col("id").alias("p_partkey"), F.lit("a small part").alias("p_name"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["tools_registry"](spark, str(tmp_path)).count() == 1
    assert not given[0].inputFiles()
