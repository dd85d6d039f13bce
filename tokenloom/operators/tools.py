"""Tool catalogues: normalise schemas, share parameter types, compile signatures."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.columns import half_even, let
from tokenloom.plans.groups import HOT_ROWS, cut_lineage, numbered

# --- fixed values: type names and parameter names whose type is obvious -----------------------
TYPE_NAMES = {
    "string": "str", "integer": "int", "number": "float",
    "boolean": "bool", "array": "list", "object": "dict", "null": "None",
}
OBVIOUS = {
    "str": (
        r"(?:_id|_key|_code|_slug|_name|_title|_text|_content|_message|_prompt|"
        r"_query|_url|_path|_email|_token|_hash|_type|_format|_lang|_language|"
        r"_status|_mode|_tag|_label|_prefix|_suffix|_pattern|_description|"
        r"_summary|_note|_reason|_input|_output|_cursor|_sort|_order|_filter|"
        r"^query|^text|^content|^message|^prompt|^url|^path|^email|"
        r"^language|^format|^sort|^order|^filter|^cursor|^token)$"
    ),
    "int": (
        r"(?:_count|_num|_number|_size|_limit|_offset|_index|_page|_rank|"
        r"_score|_age|_year|_month|_day|_hour|_minute|_second|_timeout|"
        r"_length|_width|_height|_depth|_priority|_weight|_version|_max|_min|"
        r"^n|^k|^count|^limit|^offset|^page|^size|^top_k|^max|^min)$"
    ),
    "bool": (
        r"(?:^is_|^has_|^enable|^disable|^use_|^with_|^include_|^exclude_|"
        r"^allow_|^show_|^hide_|^force_|^strict_|^verbose|^debug|^async|"
        r"_enabled|_disabled|_active|_required|_visible|_recursive)$"
    ),
    "list": (
        r"(?:_ids|_list|_items|_tags|_labels|_names|_urls|_paths|"
        r"_keys|_values|_fields|_columns|_rows|_args|_params|"
        r"^ids|^items|^tags|^fields|^args|^keys|^values)$"
    ),
}
MAX_ENUM = 3
MAX_TOOLS = 128
MIN_SHARED = 3
MAX_COMMENT, CUT_BY = 80, 3
TYPE_SYMBOL = "§T"
# --- end of fixed values ------------------------------------------------------------------------

_BODY = "name string, description string, parameters string, input_schema string"


def type_column(json_type: Column) -> Column:
    names = F.from_json(F.lit(json.dumps(TYPE_NAMES)), "map<string,string>")
    given = F.when(json_type != "", json_type)
    return F.coalesce(F.element_at(names, given), given, F.lit("any"))


def obvious_column(name: Column, type_name: Column) -> Column:
    """Whether the parameter's name alone tells its type."""
    found = F.lit(False)
    for kind, pattern in OBVIOUS.items():
        found = found | ((type_name == kind) & name.rlike("(?i)" + pattern))
    return found


def _literal_column(value: Column) -> Column:
    """A JSON default as it reads in a signature: quoted text, True, False or a number."""
    quoted = F.when(
        value["text"].contains("'") & ~value["text"].contains('"'),
        F.concat(F.lit('"'), F.replace(value["text"], F.lit("\\"), F.lit("\\\\")), F.lit('"')),
    ).otherwise(
        F.concat(
            F.lit("'"),
            F.replace(
                F.replace(value["text"], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")
            ),
            F.lit("'"),
        )
    )
    nested = F.replace(F.replace(value["json"], F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    nested = F.replace(nested, F.lit('"'), F.lit("'"))
    return (
        F.when(value["json"].startswith('"'), quoted)
        .when(value["json"] == "true", "True")
        .when(value["json"] == "false", "False")
        .when(value["json"].rlike(r"^[\[{]"), nested)
        .otherwise(value["json"])
    )


def _param_column(entry: Column, required: Column) -> Column:
    """One normalised parameter from a ``properties`` map entry."""
    fields = F.struct(
        F.from_json(entry["value"], "type string, enum array<string>").alias("f"),
        # Parsed a second time, with types, only where a default may be present.
        F.when(
            F.contains(entry["value"], F.lit('"default"')), F.try_parse_json(entry["value"])
        ).alias("v"),
    )

    def build(p: Column) -> Column:
        kind = type_column(p["f"]["type"])
        default = F.struct(
            F.to_json(F.try_variant_get(p["v"], "$.default", "variant")).alias("json"),
            F.try_variant_get(p["v"], "$.default", "string").alias("text"),
        )
        has_default = default["json"].isNotNull() & (default["json"] != "null")
        empty = default["json"].isin("0", "0.0", "false", '""', "[]", "{}")
        return F.struct(
            (~F.array_contains(required, entry["key"])).cast("int").alias("optional"),
            entry["key"].alias("name"),
            kind.alias("type"),
            obvious_column(entry["key"], kind).alias("elide_type"),
            F.when(has_default, _literal_column(default)).alias("default"),
            (has_default & empty).alias("default_empty"),
            F.when(F.size(p["f"]["enum"]) > 0, p["f"]["enum"]).alias("enum"),
        )

    return let(fields, build)


def normalise_tools(df: DataFrame) -> DataFrame:
    """``catalog_id, pos, tool_json`` to name, description and ordered parameters.

    Three dialects: wrapped in a function object, plain with ``parameters``, plain with
    ``input_schema``. Unnamed tools are left out; required parameters come first.
    """
    rows = df.withColumn("_o", F.from_json("tool_json", f"type string, function string, {_BODY}"))
    wrapped = (F.col("_o.type") == "function") & F.col("_o.function").startswith("{")
    plain = F.struct(
        *[F.col(f"_o.{c}").alias(c) for c in ("name", "description", "parameters", "input_schema")]
    )
    body = F.when(wrapped, F.from_json(F.col("_o.function"), _BODY)).otherwise(plain)
    rows = rows.withColumn("_b", body).withColumn(
        "name", T.strip(F.coalesce("_b.name", F.lit("")))
    )
    schema = F.coalesce(
        F.when(~F.col("_b.parameters").isin("{}", "null"), F.col("_b.parameters")),
        F.col("_b.input_schema"),
        F.lit("{}"),
    )
    rows = rows.withColumn(
        "_s", F.from_json(schema, "properties map<string,string>, required array<string>")
    )
    required = F.coalesce(F.col("_s.required"), F.array().cast("array<string>"))
    entries = F.coalesce(
        F.map_entries("_s.properties"),
        F.array().cast("array<struct<key:string,value:string>>"),
    )
    params = let(
        required, lambda r: F.array_sort(F.transform(entries, lambda e: _param_column(e, r)))
    )
    return rows.filter(F.col("name") != "").select(
        "catalog_id",
        "pos",
        "name",
        T.strip(F.coalesce("_b.description", F.lit(""))).alias("description"),
        params.alias("params"),
        T.token_words(F.col("tool_json")).alias("json_words"),
    )


def _params(tools: DataFrame) -> DataFrame:
    return tools.select(
        "catalog_id",
        "pos",
        F.col("name").alias("tool"),
        F.posexplode("params").alias("param_no", "p"),
    )


def param_registry(
    tools: DataFrame, min_tools: int = MIN_SHARED, limit: int = HOT_ROWS
) -> DataFrame:
    """Parameters (name, type) shared by several tools of a catalogue, with their symbols.

    Obvious types are left out. Ranked by the number of tools, then by first appearance.
    """
    shared = (
        _params(tools)
        .groupBy("catalog_id", F.col("p.name").alias("name"), F.col("p.type").alias("type"))
        .agg(
            F.count(F.lit(1)).alias("n_tools"),
            F.min(F.struct("pos", "param_no")).alias("_first"),
        )
        .filter(F.col("n_tools") >= min_tools)
        .filter(~obvious_column(F.col("name"), F.col("type")))
    )
    order = [F.desc("n_tools"), F.asc("_first")]
    ranked = numbered(cut_lineage(shared), ["catalog_id"], order, "rank", None, limit)
    return ranked.select(
        "catalog_id",
        "rank",
        F.concat(F.lit(TYPE_SYMBOL), F.col("rank").cast("string")).alias("symbol"),
        "name",
        "type",
        "n_tools",
    )


def _rendered(p: Column, max_enum: int | None) -> Column:
    choices = F.array_join(p["enum"] if max_enum is None else F.slice(p["enum"], 1, max_enum), "|")
    with_default = F.concat(F.lit("="), p["default"])
    kind = F.concat(p["name"], F.lit(": "), p["type"])
    listed = F.concat(p["name"], F.lit(": "), choices)
    return (
        F.when(
            p["enum"].isNotNull(),
            F.when(p["default"].isNull() | p["default_empty"], listed).otherwise(
                F.concat(listed, with_default)
            ),
        )
        .when(
            p["default"].isNotNull(),
            F.concat(
                F.when(p["elide_type"] | (p["type"] == "str"), p["name"]).otherwise(kind),
                with_default,
            ),
        )
        .when(p["elide_type"] | p["type"].isin("any", ""), p["name"])
        .otherwise(kind)
    )


def alias_params(tools: DataFrame, registry: DataFrame, max_enum: int | None = None) -> DataFrame:
    """Every parameter as it reads in a signature; shared ones by their symbol.

    All choices of a parameter are listed, or the first ``max_enum``.
    """
    names = registry.select("catalog_id", F.col("name").alias("_n"), F.col("type").alias("_t"), "symbol")
    rows = _params(tools).alias("a")
    same = (
        (F.col("a.catalog_id") == F.col("b.catalog_id"))
        & (F.col("a.p.name") == F.col("b._n"))
        & (F.col("a.p.type") == F.col("b._t"))
    )
    return rows.join(names.alias("b"), same, "left").select(
        "a.catalog_id",
        "pos",
        "tool",
        "param_no",
        F.coalesce("symbol", _rendered(F.col("a.p"), max_enum)).alias("rendered"),
    )


def tool_lines(
    tools: DataFrame,
    registry: DataFrame,
    seen: DataFrame | None = None,
    max_enum: int | None = None,
    max_comment: int | None = None,
) -> DataFrame:
    """One signature line per tool; tools in ``seen`` (catalog_id, name) are marked as cached.

    Choices and descriptions are whole, or the first ``max_enum`` and, with the comment sign, cut to
    ``max_comment`` characters or fewer.
    """
    signed = (
        alias_params(tools, registry, max_enum)
        .groupBy("catalog_id", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("param_no", "rendered"))).alias("_p"))
    )
    rows = tools.select("catalog_id", "pos", "name", "description", "json_words").join(
        signed, ["catalog_id", "pos"], "left"
    )
    args = F.array_join(
        F.transform(
            F.coalesce("_p", F.array().cast("array<struct<param_no:int,rendered:string>>")),
            lambda p: p["rendered"],
        ),
        ", ",
    )
    comment = F.concat(F.lit("  # "), F.col("description"))
    cut = comment
    if max_comment is not None:
        short = F.concat(F.substring(comment, 1, max_comment - CUT_BY), F.lit("…"))
        cut = F.when(F.length(comment) > max_comment, short).otherwise(comment)
    line = F.concat(
        F.col("name"),
        F.lit("("),
        args,
        F.lit(")"),
        F.when(F.col("description") != "", cut).otherwise(""),
    )
    rows = rows.withColumn("line", line).drop("_p", "description")
    if seen is None:
        return rows.withColumn("cached", F.lit(False))
    known = seen.select("catalog_id", "name").distinct().withColumn("_seen", F.lit(True))
    return (
        rows.join(known, ["catalog_id", "name"], "left")
        .withColumn("cached", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def accept_catalogs(
    df: DataFrame, max_tools: int = MAX_TOOLS
) -> tuple[DataFrame, DataFrame]:
    """Catalogues of at most ``max_tools``, and the tools of larger ones with the reason."""
    large = (
        df.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_tools)
    ).drop("_n")
    rejected = df.join(large, "catalog_id", "left_semi")
    return (
        df.join(large, "catalog_id", "left_anti"),
        rejected.withColumn("reason", F.lit("too_many_tools")),
    )


def compile_tools(
    df: DataFrame,
    seen: DataFrame | None = None,
    min_tools: int = MIN_SHARED,
    max_enum: int | None = None,
    max_comment: int | None = None,
) -> DataFrame:
    """Compile catalogues of ``catalog_id, pos, tool_json`` to signature text with token counts.

    ``MAX_ENUM`` and ``MAX_COMMENT`` give the short form of the signatures. The text of one catalogue is one value; ``accept_catalogs`` can set large ones aside first.
    """
    size = df.groupBy("catalog_id").agg(F.sum(T.token_words(F.col("tool_json"))).alias("_json"))
    tools = cut_lineage(normalise_tools(df))
    registry = cut_lineage(param_registry(tools, min_tools))
    lines = tool_lines(tools, registry, seen, max_enum, max_comment)

    def listed(column: str, wanted: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", F.col(column).alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    cached = F.col("cached")
    bodies = lines.groupBy("catalog_id").agg(
        listed("line", ~cached).alias("_lines"),
        listed("name", ~cached).alias("new_tools"),
        listed("name", cached).alias("cached_tools"),
    )
    entry = F.concat(F.col("symbol"), F.lit("="), F.col("name"), F.lit(": "), F.col("type"))
    types = registry.groupBy("catalog_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("_types")
    )
    rows = size.join(bodies, "catalog_id", "left").join(types, "catalog_id", "left")
    for name in ("_lines", "new_tools", "cached_tools"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    parts = F.array(
        F.when(
            F.col("_types").isNotNull(),
            F.concat(
                F.lit("TYPES:{"),
                F.array_join(F.transform("_types", lambda t: t["e"]), ", "),
                F.lit("}"),
            ),
        ),
        F.when(
            F.size("cached_tools") > 0,
            F.concat(F.lit("TOOLS:["), F.array_join("cached_tools", ","), F.lit("]")),
        ),
        F.when(F.size("_lines") > 0, F.array_join("_lines", "\n")),
    )
    rows = rows.withColumn("dsl", F.array_join(parts, "\n"))
    rows = rows.withColumn("original_tokens", T.tokens_from_words(F.col("_json"))).withColumn(
        "compressed_tokens", F.when(F.col("dsl") == "", 0).otherwise(T.token_count(F.col("dsl")))
    )
    return rows.select(
        "catalog_id",
        "dsl",
        "original_tokens",
        "compressed_tokens",
        half_even(1 - F.col("compressed_tokens") / F.col("original_tokens"), 4).alias("cr"),
        F.size("cached_tools").cast("long").alias("cached_count"),
        "new_tools",
        "cached_tools",
    )


def split_seen_tools(tool_turns: DataFrame) -> DataFrame:
    """New and already sent tools per session turn (``session_id, turn, pos, tool``)."""
    firsts = tool_turns.groupBy("session_id", "tool").agg(F.min("turn").alias("_first"))
    rows = tool_turns.join(firsts, ["session_id", "tool"])

    def listed(wanted: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", "tool"))))
        return F.transform(found, lambda r: r["tool"])

    is_new = F.col("turn") == F.col("_first")
    return rows.groupBy("session_id", "turn").agg(
        listed(is_new).alias("new_tools"), listed(~is_new).alias("cached_tools")
    )
