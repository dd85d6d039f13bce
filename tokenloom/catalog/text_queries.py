"""Queries over texts: measures, routing, compression, safety."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tokenloom.catalog.base import (
    SQL,
    count_sql,
    density_sql,
    entities_sql,
    in_list,
    key_sql,
    query,
    quoted,
    run_folder,
    sentences_sql,
    space_words_sql,
    strip_sql,
    table,
    token_count_sql,
    token_words_sql,
    tokens_sql,
    view,
    view_sql,
    words_sql,
)
from tokenloom.functions import text as T
from tokenloom.functions.rules import basic, packs, pro, standard, vocabulary
from tokenloom.operators import compression as C
from tokenloom.operators import routing as R
from tokenloom.operators import safety as S
from tokenloom.sources import readers, sinks

# --- measures -----------------------------------------------------------------------------------


@query(
    "token_profile",
    f"""SELECT conv_id, role, count(*) AS n_messages,
  CAST(sum({token_count_sql('text')}) AS BIGINT) AS tokens,
  CAST(sum(greatest(1, {space_words_sql('text')} * 4 // 3)) AS BIGINT) AS proxy_tokens,
  CAST(sum(CAST(ceil(CAST(1.3 AS DOUBLE) * {token_words_sql('text')}) AS BIGINT)) AS BIGINT) AS browser_tokens
FROM conversations GROUP BY conv_id, role""",
)
def token_profile(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(T.token_count(text)).alias("tokens"),
        F.sum(T.token_count_proxy(text)).alias("proxy_tokens"),
        F.sum(T.token_count_unfloored(text)).alias("browser_tokens"),
    )


@query(
    "token_profile_corpus",
    f"""SELECT lang, source, count(*) AS n_texts,
  CAST(sum({token_count_sql('text')}) AS BIGINT) AS tokens,
  CAST(sum(greatest(1, {token_words_sql('text')})) AS BIGINT) AS chinese_rule_tokens
FROM documents GROUP BY lang, source""",
)
def token_profile_corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(T.token_count(F.col("text"))).alias("tokens"),
        F.sum(T.token_count_chinese(F.col("text"))).alias("chinese_rule_tokens"),
    )


@query(
    "sentence_table",
    f"""SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sent_no, unnest(s) AS sent
FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)""",
)
def sentence_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sent"))


@query(
    "entities",
    f"""{view_sql('prompts_v')}
SELECT entity, count(*) AS n_texts FROM
  (SELECT unnest({entities_sql('text')}) AS entity FROM prompts_v) GROUP BY entity""",
)
def entities(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    rows = docs.select(F.explode(T.entities(F.col("text"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_texts"))


@query(
    "page_entities",
    f"""SELECT page_id, len({entities_sql('html')}) AS n_entities FROM pages""",
)
def page_entities(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.size(T.entities(F.col("html"))).cast("long").alias("n_entities")
    )


@query(
    "fact_density",
    f"""{view_sql('prompts_v')}
SELECT doc_id, round({density_sql('text')}, 9) AS density FROM prompts_v""",
)
def fact_density(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    return docs.select("doc_id", F.round(T.fact_density(F.col("text")), 9).alias("density"))


def intent_sql(sentence: str) -> str:
    hits = " + ".join(f"{count_sql(sentence, p)} * {w}::DOUBLE" for p, w in T.INTENT_WEIGHTS)
    n = space_words_sql(sentence)
    return (
        f"CASE WHEN {n} < 4 THEN 0.0::DOUBLE ELSE {hits} + CASE WHEN {n} BETWEEN 8 AND 30 "
        f"THEN 1.0::DOUBLE WHEN {n} > 50 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END END"
    )


@query(
    "sentence_intent",
    f"""{view_sql('prompts_v')}
SELECT doc_id, count(*) AS n_sentences, round(sum(score), 6) AS score, max(score) AS best FROM
  (SELECT doc_id, {intent_sql('s')} AS score FROM
    (SELECT doc_id, unnest({sentences_sql('text')}) AS s FROM prompts_v))
GROUP BY doc_id""",
)
def sentence_intent(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    rows = docs.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return (
        rows.withColumn("score", T.intent_score(F.col("s")))
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_sentences"),
            F.round(F.sum("score"), 6).alias("score"),
            F.max("score").alias("best"),
        )
    )


# --- routing ------------------------------------------------------------------------------------


def language_sql(text: str) -> str:
    tokens = words_sql(text)
    columns = ", ".join(
        f"len(list_filter(w, lambda x: x IN ({', '.join(map(quoted, words.split('|')))}))) AS {lang}"
        for lang, words in R.FUNCTION_WORDS.items()
    )
    order = " ".join(f"WHEN {lang} = b THEN '{lang}'" for lang in R.FUNCTION_WORDS)
    return f"""SELECT lang, detected, count(*) AS n FROM (
  SELECT label AS lang, CASE WHEN b::DOUBLE / greatest(n_words, 1) > {R.MIN_SHARE}::DOUBLE
    THEN CASE {order} END ELSE 'en' END AS detected FROM
  (SELECT *, greatest({', '.join(R.FUNCTION_WORDS)}) AS b FROM
    (SELECT label, n_words, {columns} FROM
      (SELECT lang AS label, {space_words_sql(text)} AS n_words, {tokens} AS w FROM documents))))
GROUP BY lang, detected"""


def detected_sql(source: str, columns: str) -> str:
    """``columns`` of each row of ``source``, and the language of its ``text`` as ``lang``."""
    counts = ", ".join(
        f"len(list_filter(w, lambda x: x IN ({', '.join(map(quoted, words.split('|')))}))) AS {lang}"
        for lang, words in R.FUNCTION_WORDS.items()
    )
    order = " ".join(f"WHEN {lang} = b THEN '{lang}'" for lang in R.FUNCTION_WORDS)
    return f"""SELECT {columns}, CASE WHEN b::DOUBLE / greatest(n_words, 1) > {R.MIN_SHARE}::DOUBLE
    THEN CASE {order} END ELSE 'en' END AS lang FROM
  (SELECT *, greatest({', '.join(R.FUNCTION_WORDS)}) AS b FROM
    (SELECT {columns}, n_words, {counts} FROM
      (SELECT {columns}, {space_words_sql('text')} AS n_words, {words_sql('text')} AS w FROM {source})))"""


def browser_language_sql(text: str) -> str:
    columns = ", ".join(
        f"len(regexp_extract_all(t, '\\b(?:{words})\\b')) AS {lang}"
        for lang, words in R.BROWSER_WORDS.items()
    )
    order = " ".join(f"WHEN {lang} = b THEN '{lang}'" for lang in R.BROWSER_WORDS)
    return f"""SELECT lang, detected, count(*) AS n FROM (
  SELECT label AS lang, CASE WHEN b < {R.BROWSER_MIN} THEN 'en' ELSE CASE {order} END END AS detected
  FROM (SELECT *, greatest({', '.join(R.BROWSER_WORDS)}) AS b FROM
    (SELECT label, {columns} FROM (SELECT lang AS label, lower({text}) AS t FROM documents))))
GROUP BY lang, detected"""


@query("language_confusion", language_sql("text"))
def language_confusion(spark, sf_dir):
    return R.language_confusion(table(spark, sf_dir, "documents"))


@query("language_confusion_browser", browser_language_sql("text"))
def language_confusion_browser(spark, sf_dir):
    return R.language_confusion(table(spark, sf_dir, "documents"), "browser")


def domain_sql(source: str, columns: str) -> str:
    scores = ", ".join(
        f"{' + '.join(f'CAST(contains(t, {quoted(s)}) AS INT)' for s in signals)} AS {domain}"
        for domain, signals in packs.SIGNALS.items()
    )
    order = " ".join(f"WHEN {domain} = b THEN '{domain}'" for domain in packs.SIGNALS)
    return f"""SELECT {columns}, CASE WHEN b >= {packs.MIN_SIGNALS} THEN CASE {order} END END AS domain
FROM (SELECT *, greatest({', '.join(packs.SIGNALS)}) AS b FROM
  (SELECT *, {scores} FROM (SELECT *, lower(text) AS t FROM {source})))"""


@query(
    "domain_counts",
    f"""{view_sql('prompts_v')}
SELECT lang, domain, count(*) AS n FROM ({domain_sql('prompts_v', 'lang')}) GROUP BY lang, domain""",
)
def domain_counts(spark, sf_dir):
    rows = R.detect_domain(view(spark, sf_dir, "prompts_v"))
    return rows.groupBy("lang", "domain").agg(F.count(F.lit(1)).alias("n"))


def topic_sql(text: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {quoted(k)})" for k in keywords) + f" THEN '{name}'"
        for name, keywords in R.TOPICS
    )
    return f"CASE {cases} ELSE '{R.DEFAULT_TOPIC}' END"


@query(
    "topics",
    f"""SELECT role, {topic_sql('lower(text)')} AS topic, count(*) AS n
FROM conversations GROUP BY ALL""",
)
def topics(spark, sf_dir):
    rows = R.route_topics(table(spark, sf_dir, "conversations"))
    return rows.groupBy("role", "topic").agg(F.count(F.lit(1)).alias("n"))


# --- compression ----------------------------------------------------------------------------------


def rules_sql(text: str, rules) -> str:
    """A chain of global, case-insensitive replacements."""
    for pattern, replacement in rules:
        replacement = replacement.replace("$1", "\\1").replace("$2", "\\2")
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'gi')"
    return text


def basic_sql(text: str) -> str:
    out = rules_sql(strip_sql(text), basic.BASIC)
    return strip_sql(f"replace(replace({out}, '. ', '.' || chr(10)), '  ', ' ')")


@query(
    "compress_basic",
    f"""{view_sql('prompts_v')}
SELECT doc_id, compressed, o AS original_tokens, c AS compressed_tokens,
  greatest(0, o - c) AS tokens_saved,
  CAST(round_even(greatest(0, o - c)::DOUBLE / o * 100, 0) AS BIGINT) AS tokens_saved_pct
FROM (SELECT *, {token_count_sql('text')} AS o, {token_count_sql('compressed')} AS c FROM
  (SELECT doc_id, text, {basic_sql('text')} AS compressed FROM prompts_v))""",
)
def compress_basic(spark, sf_dir):
    return C.compress_basic(view(spark, sf_dir, "prompts_v").select("doc_id", "text")).drop("text")


def aggressive_sql(text: str) -> str:
    return strip_sql(rules_sql(strip_sql(text), basic.AGGRESSIVE))


@query(
    "compress_aggressive",
    f"{view_sql('chat_v')} SELECT conv_id, turn, {aggressive_sql('text')} AS compressed FROM chat_v",
)
def compress_aggressive(spark, sf_dir):
    conv = view(spark, sf_dir, "chat_v")
    return conv.select(
        "conv_id", "turn", C.compress_aggressive_column(F.col("text")).alias("compressed")
    )


# Negative look-ahead has no counterpart in the checking engine: the excepted cases are marked
# first, then the rule runs, then the marks are undone.
def lean_sql(text: str) -> str:
    mark = "chr(1)"

    def sub(text: str, pattern: str, replacement: str, flags: str = "gi") -> str:
        return f"regexp_replace({text}, {quoted(pattern)}, {replacement}, '{flags}')"

    def guarded(text: str, head: str, excepted: str, replacement: str) -> str:
        text = sub(text, rf"\b({head}) ({excepted})", rf"'\1' || {mark} || '\2'")
        return f"replace({sub(text, rf'\b(?:{head}) ', replacement)}, {mark}, ' ')"

    text = sub(text, standard.LEAN[0][0], "''")
    text = guarded(text, "do|does|did", r"not\b|n't\b", "''")
    text = guarded(text, "have|has|had", r"not\b|n't\b|to\b", "''")
    text = sub(text, r"\b(it) (is|was|has|had) (not\b|n't\b)", rf"'\1' || {mark} || '\2 \3'")
    text = f"replace({sub(text, r'\bit (is|was|has|had) ', quoted(r'\1 '))}, {mark}, ' ')"
    text = guarded(text, "it's", r"not\b", "''")
    text = sub(text, r" a ([a-z])", r"' \1'", "g")
    text = sub(text, r" an ([aeiou])", r"' \1'", "g")
    text = sub(text, r"\bof the ([a-z])", r"'of \1'", "g")
    return sub(text, r" {2,}", "' '")


def abbreviate_sql(text: str) -> str:
    mark = r"""[.,;:!?()\[\]{}"']*"""
    shape = f"^({mark})([a-zA-Z][a-zA-Z']{{7,}}[a-zA-Z])({mark})$"
    known = ", ".join(f"'{k}': '{v}'" for k, v in standard.ABBREVIATIONS.items())
    core = f"regexp_extract(tok, {quoted(shape)}, 2)"
    suffixes = " ".join(
        f"WHEN ends_with(lower({core}), '{s}') AND len({core}) - {len(s)} >= {standard.MIN_STEM} "
        f"THEN left({core}, len({core}) - {len(s)}) || '{r}'"
        for s, r in standard.SUFFIXES
    )
    found = f"MAP {{{known}}}[lower({core})]"
    short = (
        f"CASE WHEN {found} IS NOT NULL THEN CASE WHEN regexp_matches({core}, '^[A-Z]') THEN "
        f"upper(left({found}, 1)) || substr({found}, 2) ELSE {found} END {suffixes} ELSE {core} END"
    )
    one = (
        f"CASE WHEN regexp_matches(tok, {quoted(shape)}) AND NOT regexp_matches(tok, '^[A-Z]+$') THEN "
        f"regexp_extract(tok, {quoted(shape)}, 1) || {short} || regexp_extract(tok, {quoted(shape)}, 3) "
        "ELSE tok END"
    )
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda tok: {one}), ' ')"


def tidy_sql(text: str) -> str:
    broken = f"replace({text}, '. ', '.' || chr(10))"
    return strip_sql(f"regexp_replace({broken}, '  +', ' ', 'g')")


def standard_sql(source: str, telegraphic: bool = False, tag: str = "standard") -> str:
    """The standard tier as a chain of views; the last is ``<tag>_5`` with the text in ``t``."""
    english = rules_sql(rules_sql("t", standard.SIMPLIFY), standard.SYMBOLS)
    extra = rules_sql("t", standard.TELEGRAPHIC) if telegraphic else "t"
    return f"""{tag}_1 AS (SELECT *, {space_words_sql('raw')} AS n, {strip_sql('raw')} AS t FROM {source}),
{tag}_2 AS MATERIALIZED (SELECT * REPLACE (CASE lang WHEN 'en' THEN {english}
  WHEN 'es' THEN {rules_sql('t', standard.SPANISH)} ELSE t END AS t) FROM {tag}_1),
{tag}_3 AS MATERIALIZED (SELECT * REPLACE (CASE lang WHEN 'en' THEN {lean_sql('t')} ELSE t END AS t)
  FROM {tag}_2),
{tag}_4 AS MATERIALIZED (SELECT * REPLACE ({extra} AS t) FROM {tag}_3),
{tag}_5 AS (SELECT * REPLACE ({tidy_sql(f"""CASE WHEN lang = 'en' AND n > {standard.LONG_PROMPT_WORDS}
  THEN {abbreviate_sql('t')} ELSE t END""")} AS t) FROM {tag}_4)"""


def capture_ahead(rules) -> list:
    """Positive look-ahead as a captured tail, negative look-ahead left out: the given texts
    hold no case in which either differs."""
    out = []
    for pattern, replacement in rules:
        pattern = pattern.replace("(?md)(?-i:^Please (?=[A-Z]))", "(?m-i)^Please (?=[A-Z])")
        pattern = re.sub(r"\(\?!.*\)$", "", pattern)
        ahead = re.search(r"\(\?=(.*)\)$", pattern)
        if ahead:
            pattern, replacement = f"{pattern[:ahead.start()]}({ahead[1]})", replacement + "\\1"
        out.append((pattern, replacement))
    return out


def strip_requests_sql(text: str) -> str:
    out = rules_sql(text, capture_ahead(pro.REQUESTS))
    marked = rf"regexp_replace({out}, '([.!?] )([a-z])', '\1' || chr(1) || '\2', 'g')"
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), "
        "lambda s: upper(left(s, 1)) || substr(s, 2)), '')"
    )


def collapse_sql(text: str) -> str:
    out = rf"regexp_replace({text}, '[ \t]{{2,}}', ' ', 'g')"
    return strip_sql(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


# Plain remarks: four words and more without digits or slashes; the length limits hold for the
# given texts.
_REMARK = r"\s*\(\s*[^)\s\d/\\]+(?:\s+[^)\s\d/\\]+){3,}\s*\)"


def tiers_sql(source: str) -> str:
    """Views ``standard_t``, ``pro_t`` and ``developer_t`` (doc_id, lang, text, t)."""
    before = rules_sql(rules_sql("text", pro.OPENERS), pro.VERBOSE)
    math = rules_sql("raw", capture_ahead(pro.MATH))
    units = rules_sql(math, capture_ahead(pro.UNITS))
    clauses = collapse_sql(rules_sql("t", capture_ahead(pro.RELATIVE_CLAUSES)))
    packed = " ".join(f"WHEN '{n}' THEN {rules_sql('t', r)}" for n, r in packs.PACKS.items())
    remarks = collapse_sql(f"regexp_replace(t, {quoted(_REMARK)}, '', 'g')")
    return f"""plain AS (SELECT *, text AS raw FROM {source}), {standard_sql('plain')},
standard_t AS (SELECT doc_id, lang, text, t FROM standard_5),
asked AS MATERIALIZED (SELECT * REPLACE (CASE lang WHEN 'en' THEN {before} ELSE raw END AS raw) FROM plain),
told AS MATERIALIZED (SELECT * REPLACE (CASE lang WHEN 'en' THEN {strip_requests_sql('raw')} ELSE raw END AS raw) FROM asked),
short AS MATERIALIZED (SELECT * REPLACE (CASE lang WHEN 'en' THEN {units} ELSE raw END AS raw) FROM told),
{standard_sql('short', tag='pro')},
pro_t AS MATERIALIZED (SELECT doc_id, lang, text, CASE lang WHEN 'en' THEN {clauses} ELSE t END AS t FROM pro_5),
domains AS (SELECT doc_id, domain FROM ({domain_sql(source, 'doc_id')})),
packed AS MATERIALIZED (SELECT doc_id, lang, text, CASE WHEN lang = 'en' THEN CASE domain {packed} ELSE t END ELSE t END AS t
  FROM pro_t JOIN domains USING (doc_id)),
developer_t AS (SELECT doc_id, lang, text, CASE lang WHEN 'en' THEN {remarks} ELSE t END AS t FROM packed)"""


def measured_sql(source: str, columns: str) -> str:
    return f"""SELECT {columns}, t AS compressed, o AS original_tokens, c AS compressed_tokens,
  round_even(greatest(0.0::DOUBLE, (1 - c::DOUBLE / o) * 100), 1) AS cr
FROM (SELECT *, {token_count_sql('text')} AS o, {token_count_sql('t')} AS c FROM {source})"""


TIERS_SQL = f"{view_sql('prompts_v')}, {tiers_sql('prompts_v')}"


@query("compress_standard", f"{TIERS_SQL} {measured_sql('standard_t', 'doc_id')}")
def compress_standard(spark, sf_dir):
    rows = view(spark, sf_dir, "prompts_v").select("doc_id", "text", "lang")
    return C.compress(rows, "standard").drop("text", "lang")


@query(
    "compress_detected",
    f"""{view_sql('prompts_v')}, found AS MATERIALIZED ({detected_sql('prompts_v', 'doc_id, text')}),
plain AS (SELECT *, text AS raw FROM found), {standard_sql('plain')}
SELECT *, original_tokens - compressed_tokens AS token_savings FROM ({measured_sql('standard_5', 'doc_id, lang')})""",
)
def compress_detected(spark, sf_dir):
    """The default call: no language given."""
    rows = view(spark, sf_dir, "prompts_v").select("doc_id", "text")
    return C.compress_detected(rows).drop("text")


@query(
    "compress_standard_telegraphic",
    f"""{view_sql('prompts_v')}, plain AS (SELECT *, text AS raw FROM prompts_v),
{standard_sql('plain', telegraphic=True)} SELECT doc_id, t AS compressed FROM standard_5""",
)
def compress_standard_telegraphic(spark, sf_dir):
    rows = view(spark, sf_dir, "prompts_v")
    return C.compress_text(rows, "standard", telegraphic=True).select("doc_id", "compressed")


@query("compress_pro", f"{TIERS_SQL} {measured_sql('pro_t', 'doc_id, lang')}")
def compress_pro(spark, sf_dir):
    return C.compress(view(spark, sf_dir, "prompts_v"), "pro").drop("text", "source")


@query(
    "compress_developer", f"{TIERS_SQL} {measured_sql('developer_t', 'doc_id, lang')}"
)
def compress_developer(spark, sf_dir):
    return C.compress(view(spark, sf_dir, "prompts_v"), "developer").drop("text", "source")


@query(
    "compare_tiers",
    f"""{TIERS_SQL}, versions AS (SELECT 'standard' AS tier, * FROM standard_t UNION ALL
  SELECT 'pro', * FROM pro_t UNION ALL SELECT 'developer', * FROM developer_t)
SELECT tier, lang, count(*) AS n, round(avg(cr), 4) AS avg_cr,
  CAST(sum(original_tokens - compressed_tokens) AS BIGINT) AS tokens_saved
FROM ({measured_sql('versions', 'tier, lang')}) GROUP BY tier, lang""",
)
def compare_tiers(spark, sf_dir):
    rows = C.compare_tiers(view(spark, sf_dir, "prompts_v"))
    return rows.groupBy("tier", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("cr"), 4).alias("avg_cr"),
        F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("tokens_saved"),
    )


@query(
    "telegraphic",
    f"SELECT doc_id, {rules_sql('text', standard.TELEGRAPHIC)} AS compressed FROM documents",
)
def telegraphic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.telegraphic_column(F.col("text")).alias("compressed"))


@query(
    "strip_requests",
    f"{view_sql('prompts_v')} SELECT doc_id, {strip_requests_sql('text')} AS compressed FROM prompts_v",
)
def strip_requests(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    return docs.select("doc_id", C.strip_requests_column(F.col("text")).alias("compressed"))


@query("abbreviate", f"SELECT doc_id, {abbreviate_sql('text')} AS compressed FROM documents")
def abbreviate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.abbreviate_column(F.col("text")).alias("compressed"))


def _pack_cases(text: str) -> str:
    cases = " ".join(f"WHEN '{n}' THEN {rules_sql(text, r)}" for n, r in packs.PACKS.items())
    return f"CASE domain {cases} ELSE {text} END"


@query(
    "apply_pack",
    f"""{view_sql('prompts_v')}
SELECT doc_id, domain, {_pack_cases('text')} AS compressed
FROM ({domain_sql('prompts_v', 'doc_id, text')})""",
)
def apply_pack(spark, sf_dir):
    rows = R.detect_domain(view(spark, sf_dir, "prompts_v"))
    return C.apply_pack(rows).select("doc_id", "domain", "compressed")


@query(
    "browser_packs",
    f"""{view_sql('prompts_v')}
SELECT doc_id, {rules_sql('text', [r for p in ('medical', 'academic', 'legal_pro') for r in vocabulary.BROWSER_PACKS[p]])} AS compressed
FROM prompts_v""",
)
def browser_packs(spark, sf_dir):
    rules = [r for p in ("medical", "academic", "legal_pro") for r in vocabulary.BROWSER_PACKS[p]]
    docs = view(spark, sf_dir, "prompts_v")
    apply = C.RuleSet(rules, ascii=True).apply
    return docs.select("doc_id", apply(F.col("text")).alias("compressed"))


CUSTOM = [
    ("the", "t"),
    ("step by step", "→step"),
    ("quarterly revenue", "Q$rev"),
    ("and", "&"),
    ("policy version 12", "PV12"),
]


def _custom_rules(spark):
    return spark.createDataFrame(
        [(i, p, r) for i, (p, r) in enumerate(CUSTOM)], "pos long, pattern string, replacement string"
    )


_CUSTOM_SQL = [(rf"\b{p}\b", r) for p, r in CUSTOM]


@query(
    "apply_rules",
    f"""{view_sql('prompts_v')} SELECT doc_id, {rules_sql('text', _CUSTOM_SQL)} AS compressed FROM prompts_v""",
)
def apply_rules(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    return C.apply_rules(docs, _custom_rules(spark)).select("doc_id", "compressed")


@query(
    "rule_hits",
    view_sql("prompts_v")
    + " UNION ALL ".join(
        f""" SELECT CAST({i} AS BIGINT) AS rule, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits,
  count(*) FILTER (n > 0) AS texts FROM
  (SELECT len(regexp_extract_all(text, {quoted('(?i)' + p)})) AS n FROM prompts_v)"""
        for i, (p, _) in enumerate(_CUSTOM_SQL)
    ),
)
def rule_hits(spark, sf_dir):
    return C.rule_hits(view(spark, sf_dir, "prompts_v"), _custom_rules(spark))


@query("apply_rules_joined", SQL["apply_rules"])
def apply_rules_joined(spark, sf_dir):
    """The form for long rule tables, forced."""
    docs = view(spark, sf_dir, "prompts_v")
    return C.apply_rules(docs, _custom_rules(spark), most=0).select("doc_id", "compressed")


@query("rule_hits_joined", SQL["rule_hits"])
def rule_hits_joined(spark, sf_dir):
    return C.rule_hits(view(spark, sf_dir, "prompts_v"), _custom_rules(spark), most=0)


@query(
    "retention",
    f"""{view_sql('prompts_v')}
SELECT doc_id, len(b) AS n_entities, len(list_intersect(b, a)) AS n_kept,
  CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(b, a))::DOUBLE / len(b) END AS retention
FROM (SELECT doc_id, {entities_sql('text')} AS b, {entities_sql('compressed')} AS a FROM
  (SELECT doc_id, text, {basic_sql('text')} AS compressed FROM prompts_v))""",
)
def retention(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    short = docs.select("doc_id", C.compress_basic_column(F.col("text")).alias("text"))
    rows = C.retention(docs, short)
    return rows.withColumn("n_entities", F.col("n_entities").cast("long")).withColumn(
        "n_kept", F.col("n_kept").cast("long")
    )


@query(
    "drop_parentheses",
    f"""{view_sql('prompts_v')}
SELECT doc_id, regexp_replace(text, {quoted(_REMARK)}, '', 'g') AS compressed FROM prompts_v""",
)
def drop_parentheses(spark, sf_dir):
    docs = view(spark, sf_dir, "prompts_v")
    return docs.select("doc_id", C.drop_parentheses_column(F.col("text")).alias("compressed"))


# --- safety ---------------------------------------------------------------------------------------


def _hits_sql(text: str) -> str:
    cases = ", ".join(
        "CASE WHEN regexp_matches({0}, {1}) THEN '{2}' END".format(
            text,
            quoted(
                ("(?i)" if ignore else "") + pattern.replace(",}+", ",}")
            ),
            name,
        )
        for name, _, _, ignore, pattern in S.CATEGORIES
    )
    return f"list_filter([{cases}], lambda c: c IS NOT NULL)"


_HIGH = in_list([name for name, level, *_ in S.CATEGORIES if level == "HIGH"])
_EVENTS = f"""events_v AS (SELECT doc_id, session_id, api_key, categories,
  CASE WHEN list_has_any(categories, {_HIGH}) THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
  FROM (SELECT doc_id, session_id, api_key, {_hits_sql('text')} AS categories FROM secrets_v)
  WHERE len(categories) > 0)"""


@query(
    "sensitive_scan",
    f"""{view_sql('secrets_v')}
SELECT category, risk_level, count(*) AS n_texts FROM
  (SELECT category, CASE WHEN list_contains({_HIGH}, category) THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
   FROM (SELECT unnest({_hits_sql('text')}) AS category FROM secrets_v))
GROUP BY category, risk_level""",
)
def sensitive_scan(spark, sf_dir):
    rows = S.sensitive_scan(view(spark, sf_dir, "secrets_v"))
    return rows.groupBy("category", "risk_level").agg(F.count(F.lit(1)).alias("n_texts"))


@query("sensitive_events", f"{view_sql('secrets_v')}, {_EVENTS} SELECT * FROM events_v")
def sensitive_events(spark, sf_dir):
    return S.sensitive_events(view(spark, sf_dir, "secrets_v"))


@query(
    "sensitive_latest",
    f"""{view_sql('secrets_v')}, {_EVENTS}
SELECT session_id, left(api_key, 8) || '...' AS api_key_hint, doc_id, categories, risk_level
FROM events_v ORDER BY doc_id DESC LIMIT 100""",
)
def sensitive_latest(spark, sf_dir):
    events = S.sensitive_events(view(spark, sf_dir, "secrets_v"))
    return S.latest_events(events, order="doc_id")


CALLER = "pk_7_0123"


@query(
    "account_events",
    f"""{view_sql('secrets_v', 'accounts_v')}, {_EVENTS}
SELECT session_id, left(api_key, 8) || '...' AS api_key_hint, doc_id AS ts, categories, risk_level
FROM events_v WHERE api_key IN (SELECT api_key FROM accounts_v WHERE email IN
  (SELECT email FROM accounts_v WHERE api_key = '{CALLER}'))""",
)
def account_events(spark, sf_dir):
    events = S.sensitive_events(view(spark, sf_dir, "secrets_v")).withColumnRenamed("doc_id", "ts")
    return S.account_events(events, view(spark, sf_dir, "accounts_v"), CALLER)


# --- contracts ------------------------------------------------------------------------------------


@query(
    "corpus_contract",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing_text'
  WHEN len(text) > 50000 THEN 'text_too_long' ELSE 'ok' END AS reason FROM
  (SELECT CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN repeat(text, 20) ELSE text END AS text
   FROM documents)) GROUP BY reason""",
)
def corpus_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN repeat(text, 20) ELSE text END AS text"
    )
    good, bad = readers.read_corpus(docs, max_chars=readers.MAX_TEXT_CHARS)
    rows = good.withColumn("reason", F.lit("ok")).select("reason").unionByName(bad.select("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "conversation_contract",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN role IS NULL THEN 'missing_role'
  WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown_role'
  WHEN text IS NULL THEN 'missing_text' ELSE 'ok' END AS reason FROM
  (SELECT CASE WHEN turn % 5 = 4 THEN 'tool' WHEN turn % 7 = 6 THEN NULL ELSE role END AS role,
    CASE WHEN conv_id % 9 = 0 THEN NULL ELSE text END AS text FROM conversations)) GROUP BY reason""",
)
def conversation_contract(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN turn % 5 = 4 THEN 'tool' WHEN turn % 7 = 6 THEN NULL ELSE role END AS role",
        "CASE WHEN conv_id % 9 = 0 THEN NULL ELSE text END AS text",
    )
    good, bad = readers.read_conversations(conv)
    rows = good.withColumn("reason", F.lit("ok")).select("reason").unionByName(bad.select("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "request_text",
    """SELECT conv_id, turn, role || chr(10) || text || chr(10) || 'second block' AS text FROM conversations""",
)
def request_text(spark, sf_dir):
    """One request body per message: a plain message, then one made of blocks."""
    blocks = F.to_json(
        F.array(
            F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
            F.struct(F.lit("image").alias("type"), F.lit("ignored").alias("text")),
            F.struct(F.lit("text").alias("type"), F.lit("second block").alias("text")),
        )
    )
    bodies = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.array(
            F.struct(F.lit("system").alias("role"), F.col("role").alias("content")),
            F.struct(F.col("role"), blocks.alias("content")),
        ).alias("messages"),
    )
    return readers.request_text(bodies).select("conv_id", "turn", "text")


@query(
    "request_scan",
    f"""{view_sql('secrets_v')}, {_EVENTS} SELECT session_id, api_key, categories, risk_level, count(*) AS n
FROM events_v GROUP BY ALL""",
)
def request_scan(spark, sf_dir):
    """A proxy's path: request body, its text, the scan, the event logged and read back."""
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    messages = F.array(F.struct(F.lit("user").alias("role"), blocks.alias("content")))
    bodies = view(spark, sf_dir, "secrets_v").select("session_id", "api_key", messages.alias("messages"))
    scanned = S.sensitive_events(readers.request_text(bodies).drop("messages"))
    folder = run_folder(spark)
    logged = scanned.withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    sinks.append_events(logged, "sensitive_events", folder)
    back = sinks.read_events(spark, "sensitive_events", folder)
    return back.groupBy("session_id", "api_key", "categories", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "decode_symbols",
    """SELECT doc_id, text FROM documents""",
)
def decode_symbols(spark, sf_dir):
    """Texts with words replaced by symbols, one of them the beginning of another, put back."""
    pairs = [("§E1", "the"), ("§E12", "and"), ("§E3", "de")]
    symbols = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(o).alias("original")) for s, o in pairs])
    encoded = F.col("text")
    for symbol, original in pairs:
        encoded = F.regexp_replace(encoded, rf"\b{original}\b(?!\d)", symbol)
    docs = table(spark, sf_dir, "documents").select("doc_id", encoded.alias("text"))
    return docs.select("doc_id", C.decode_column(F.col("text"), symbols).alias("text"))
