"""Queries over conversations: relevance, pruning, tables, summaries, full optimisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.catalog.base import (
    count_sql,
    density_sql,
    entities_sql,
    in_list,
    key_sql,
    query,
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
from tokenloom.catalog.text_queries import aggressive_sql, intent_sql
from tokenloom.functions import text as T
from tokenloom.operators import context as C
from tokenloom.operators import optimize as O
from tokenloom.operators import relevance as R

CHAT = view_sql("chat_v")
QUERIES_SQL = """queries_v AS (SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS query
  FROM chat_v GROUP BY conv_id)"""
SMALL_BUDGET, SMALL_KEEP = 250, 2


def chat(spark, sf_dir):
    return view(spark, sf_dir, "chat_v")


# --- layout -----------------------------------------------------------------------------------


def _layout_sql(prefix: int, tail: int) -> str:
    return f"""SELECT conv_id, turn, CASE WHEN n <= {prefix + tail} OR i <= {prefix} THEN 'prefix'
  WHEN i > n - {tail} THEN 'tail' ELSE 'middle' END AS segment FROM
  (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"""


@query("kv_layout", _layout_sql(C.KV_PREFIX, C.KV_TAIL))
def kv_layout(spark, sf_dir):
    return C.kv_layout(table(spark, sf_dir, "conversations"))


@query("kv_layout_short", _layout_sql(1, 2))
def kv_layout_short(spark, sf_dir):
    return C.kv_layout(table(spark, sf_dir, "conversations"), 1, 2)


def _ratio_sql(mode: str) -> str:
    base = " ".join(f"WHEN '{r}' THEN {v}::DOUBLE" for r, v in C.ROLE_KEEP.items())
    return f"""SELECT conv_id, turn, age, CASE WHEN role = 'system' THEN 1.0::DOUBLE ELSE
  greatest({C.MIN_KEEP}::DOUBLE, CASE role {base} ELSE 0.75::DOUBLE END * exp(-{C.DECAY[mode]}::DOUBLE * age)) END AS keep_ratio
FROM (SELECT conv_id, turn, role,
  (count(*) OVER c - row_number() OVER (PARTITION BY conv_id ORDER BY turn))::DOUBLE
    / greatest(count(*) OVER c - 1, 1) AS age FROM conversations WINDOW c AS (PARTITION BY conv_id))"""


@query("keep_ratio", _ratio_sql("lossless"))
def keep_ratio(spark, sf_dir):
    return C.keep_ratio(table(spark, sf_dir, "conversations"))


@query("keep_ratio_aggressive", _ratio_sql("aggressive"))
def keep_ratio_aggressive(spark, sf_dir):
    return C.keep_ratio(table(spark, sf_dir, "conversations"), "aggressive")


# --- relevance --------------------------------------------------------------------------------


def _set_sql(text: str, stop) -> str:
    return f"list_filter(list_distinct({words_sql(text)}), lambda w: NOT list_contains({in_list(stop)}, w))"


def _jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"
    )


@query(
    "jaccard",
    f"""{CHAT}, {QUERIES_SQL}
SELECT conv_id, turn, {_jaccard_sql('w', 'q')} AS jaccard FROM
  (SELECT conv_id, turn, {_set_sql('text', T.JACCARD_STOP)} AS w FROM chat_v)
  JOIN (SELECT conv_id, {_set_sql('query', T.JACCARD_STOP)} AS q FROM queries_v) USING (conv_id)""",
)
def jaccard(spark, sf_dir):
    conv = chat(spark, sf_dir)
    return R.jaccard(conv, R.last_user_queries(conv))


@query(
    "word_sets",
    f"""{CHAT}, {QUERIES_SQL}
SELECT conv_id, turn, len(list_intersect(w, q)) AS n_shared,
  len(w) + len(q) - len(list_intersect(w, q)) AS n_either,
  len(w) - len(list_intersect(w, q)) AS n_message_only, len(w) = len(list_intersect(w, q)) AS is_subset
FROM (SELECT conv_id, turn, list_distinct({words_sql('text')}) AS w FROM chat_v)
  JOIN (SELECT conv_id, list_distinct({words_sql('query')}) AS q FROM queries_v) USING (conv_id)""",
)
def word_sets(spark, sf_dir):
    conv = chat(spark, sf_dir)
    return C.word_set_ops(conv, R.last_user_queries(conv))


def _bm25_sql(source: str) -> str:
    return f"""sents AS (SELECT conv_id, turn, CAST(unnest(range(len(s))) AS INTEGER) AS sent_no, unnest(s) AS sent
  FROM (SELECT conv_id, turn, {sentences_sql('text')} AS s FROM {source})),
toks AS (SELECT conv_id, turn, sent_no, {words_sql('sent')} AS w FROM sents),
stats AS (SELECT conv_id, turn, count(*) AS n, greatest(sum(len(w))::DOUBLE / count(*), 1.0) AS mean
  FROM toks GROUP BY conv_id, turn),
tf AS (SELECT conv_id, turn, sent_no, dl, term, count(*) AS tf FROM
  (SELECT conv_id, turn, sent_no, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
df AS (SELECT conv_id, turn, term, count(*) AS df FROM tf GROUP BY ALL),
wanted AS (SELECT conv_id, term, count(*) AS m FROM
  (SELECT conv_id, unnest({words_sql('query')}) AS term FROM queries_v) GROUP BY ALL),
hits AS (SELECT conv_id, turn, sent_no, sum(m * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)
    * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)))) AS score
  FROM tf JOIN wanted USING (conv_id, term) JOIN df USING (conv_id, turn, term)
  JOIN stats USING (conv_id, turn) GROUP BY ALL),
scored AS (SELECT conv_id, turn, sent_no, sent, coalesce(score, 0.0) AS score
  FROM sents LEFT JOIN hits USING (conv_id, turn, sent_no))"""


def _filter_sql(source: str, ratios: str) -> str:
    """``filtered_v``: ``source`` with the sentences kept at the ratio of each message."""
    return f"""{_bm25_sql(source)},
flags AS (SELECT *, sent_no = 0 OR {count_sql('sent', T.PERMANENT_PATTERN)} > 0 AS pinned FROM scored),
sized AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (pinned) AS p FROM flags GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pinned ORDER BY round(score, 9) DESC, sent_no) AS nth
  FROM flags),
held AS (SELECT conv_id, turn, string_agg(sent, ' ' ORDER BY sent_no) AS text FROM ranked
  JOIN sized USING (conv_id, turn) JOIN {ratios} USING (conv_id, turn)
  WHERE pinned OR nth <= greatest(p, round_even(n * keep_ratio, 0)) - p GROUP BY conv_id, turn),
filtered_v AS (SELECT c.conv_id, c.turn, c.role,
    CASE WHEN keep_ratio >= 1 OR coalesce(n, 0) <= 1 THEN c.text ELSE held.text END AS text
  FROM {source} c JOIN {ratios} r ON c.conv_id = r.conv_id AND c.turn = r.turn
    LEFT JOIN sized s ON c.conv_id = s.conv_id AND c.turn = s.turn
    LEFT JOIN held ON c.conv_id = held.conv_id AND c.turn = held.turn)"""


@query(
    "bm25",
    f"""{CHAT}, {QUERIES_SQL}, {_bm25_sql('chat_v')}
SELECT conv_id, turn, sent_no, round(score, 6) AS score FROM scored""",
)
def bm25(spark, sf_dir):
    conv = chat(spark, sf_dir)
    rows = R.bm25(conv, R.last_user_queries(conv))
    return rows.withColumn("score", F.round("score", 6))


@query(
    "sentence_filter",
    f"""{CHAT}, {QUERIES_SQL}, ratios AS ({_ratio_sql('lossless')}), {_filter_sql('chat_v', 'ratios')}
SELECT * FROM filtered_v""",
)
def sentence_filter(spark, sf_dir):
    conv = chat(spark, sf_dir)
    rows = conv.join(C.keep_ratio(conv), ["conv_id", "turn"]).join(
        R.last_user_queries(conv), "conv_id"
    )
    return R.sentence_filter(rows).select("conv_id", "turn", "role", "text")


# --- entity and phrase tables -----------------------------------------------------------------

def _register_sql(source: str) -> str:
    return f"""register AS (SELECT conv_id, rank, entity, '§E' || rank AS symbol, n_messages FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n_messages DESC, entity) AS rank FROM
    (SELECT conv_id, entity, count(*) AS n_messages FROM
      (SELECT conv_id, unnest({entities_sql('text')}) AS entity FROM {source})
     GROUP BY conv_id, entity HAVING count(*) >= 2)))"""


REGISTER_SQL = _register_sql("chat_v")
REGISTER_BLOCK_SQL = """register_blocks AS (SELECT conv_id,
  'ENTITIES: {' || string_agg(symbol || '=' || entity, ', ' ORDER BY rank) || '}' AS entity_register
  FROM register GROUP BY conv_id)"""


def _coded_sql(source: str) -> str:
    """``coded_v``: messages of ``source`` with registered entities replaced."""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY len(entity) DESC, rank) AS step FROM register),
hidden AS (SELECT conv_id, turn, role, text, CAST(0 AS BIGINT) AS step FROM {source}
  UNION ALL SELECT w.conv_id, w.turn, w.role, replace(w.text, o.entity, chr((57600 + o.rank)::INT)), o.step
  FROM hidden w JOIN ordered o ON w.conv_id = o.conv_id AND o.step = w.step + 1),
marked AS (SELECT conv_id, turn, role, max_by(text, step) AS text FROM hidden GROUP BY ALL),
shown AS (SELECT conv_id, turn, role, text, CAST(0 AS BIGINT) AS step FROM marked
  UNION ALL SELECT s.conv_id, s.turn, s.role, replace(s.text, chr((57600 + o.rank)::INT), o.symbol), o.step
  FROM shown s JOIN ordered o ON s.conv_id = o.conv_id AND o.step = s.step + 1),
coded_v AS (SELECT conv_id, turn, role, max_by(text, step) AS text FROM shown GROUP BY ALL)"""


@query("entity_register", f"{CHAT}, {REGISTER_SQL} SELECT * FROM register")
def entity_register(spark, sf_dir):
    return C.entity_register(chat(spark, sf_dir))


@query("register_block", f"{CHAT}, {REGISTER_SQL}, {REGISTER_BLOCK_SQL} SELECT * FROM register_blocks")
def register_block(spark, sf_dir):
    return C.register_block(C.entity_register(chat(spark, sf_dir)))


@query("apply_register", f"{CHAT}, {REGISTER_SQL}, {_coded_sql('chat_v')} SELECT * FROM coded_v")
def apply_register(spark, sf_dir):
    conv = chat(spark, sf_dir)
    return C.apply_register(conv, C.entity_register(conv))


def _phrase_sql(source: str) -> str:
    grams = " UNION ALL ".join(
        f"""SELECT conv_id, {n} AS n, p, array_to_string(w[p:p + {n - 1}], ' ') AS phrase FROM
        (SELECT conv_id, w, unnest(range(1, len(w) - {n - 2})) AS p FROM run)"""
        for n in (3, 2)
    )
    return f"""run AS (SELECT conv_id, flatten(list({words_sql('text')} ORDER BY turn)) AS w FROM {source} GROUP BY conv_id),
grams AS ({grams}),
phrases AS (SELECT conv_id, rank, phrase, '§H' || rank AS symbol, freq, savings FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY savings DESC, n DESC, first) AS rank FROM
    (SELECT conv_id, n, phrase, count(*) AS freq, (n - 1) * count(*) AS savings, min(p) AS first FROM grams
     WHERE len(phrase) > {C.PHRASE_MIN_CHARS} GROUP BY conv_id, n, phrase HAVING count(*) >= {C.PHRASE_MIN_COUNT}))
  WHERE rank <= {C.PHRASE_TOP})"""


@query("phrase_table", f"{CHAT}, {_phrase_sql('chat_v')} SELECT * FROM phrases")
def phrase_table(spark, sf_dir):
    return C.phrase_table(chat(spark, sf_dir))


@query("phrase_table_raw", f"WITH {_phrase_sql('conversations')} SELECT * FROM phrases")
def phrase_table_raw(spark, sf_dir):
    return C.phrase_table(table(spark, sf_dir, "conversations"))


def _phrased_sql(source: str) -> str:
    """``phrased_v``: messages of ``source`` with their phrases coded, and the words saved.

    Words are wrapped in marks so that whole-word matches become literal ones.
    """
    return rf"""phrase_steps AS (SELECT conv_id, symbol, len(string_split(phrase, ' ')) - 1 AS gain,
    chr(2) || replace(phrase, ' ', chr(3) || ' ' || chr(2)) || chr(3) AS marked,
    row_number() OVER (PARTITION BY conv_id ORDER BY len(phrase) DESC, rank) AS step FROM phrases),
phrase_walk AS (SELECT conv_id, turn, role, regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(2) || '\1' || chr(3), 'g') AS text,
    CAST(0 AS BIGINT) AS saved, CAST(0 AS BIGINT) AS step FROM {source}
  UNION ALL SELECT w.conv_id, w.turn, w.role, regexp_replace(w.text, o.marked, o.symbol, 'gi'),
    w.saved + len(regexp_extract_all(w.text, '(?i)' || o.marked)) * o.gain, o.step
  FROM phrase_walk w JOIN phrase_steps o ON o.conv_id = w.conv_id AND o.step = w.step + 1),
phrased_v AS (SELECT conv_id, turn, role, replace(replace(max_by(text, step), chr(2), ''), chr(3), '') AS text,
    max_by(saved, step) AS saved FROM phrase_walk GROUP BY conv_id, turn, role)"""


@query("apply_phrases", f"{CHAT}, {_phrase_sql('chat_v')}, {_phrased_sql('chat_v')} SELECT * FROM phrased_v")
def apply_phrases(spark, sf_dir):
    conv = chat(spark, sf_dir)
    return C.apply_phrases(conv, C.phrase_table(conv))


# --- pruning ----------------------------------------------------------------------------------

NOVELTY_SQL = f"""msgs AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    {entities_sql('text')} AS ents, {_set_sql('text', T.NOVELTY_STOP)} AS words FROM chat_v),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS known, CAST(NULL AS BIGINT) AS turn, true AS kept
    FROM (SELECT DISTINCT conv_id FROM msgs)
  UNION ALL SELECT conv_id, i, CASE WHEN kept THEN list_distinct(list_concat(known, list_concat(ents, words))) ELSE known END, turn, kept
  FROM (SELECT m.conv_id, m.i, w.known, m.ents, m.words, m.turn, m.role = 'system'
      OR len(list_filter(m.ents, lambda e: NOT list_contains(w.known, e))) > 0
      OR len(list_filter(m.words, lambda x: NOT list_contains(w.known, x))) > {C.MIN_NEW_WORDS} AS kept
    FROM walk w JOIN msgs m ON m.conv_id = w.conv_id AND m.i = w.i + 1))"""


@query("delta_prune", f"{CHAT}, {NOVELTY_SQL} SELECT conv_id, turn, kept FROM walk WHERE i > 0")
def delta_prune(spark, sf_dir):
    return C.mark_novel(chat(spark, sf_dir)).select("conv_id", "turn", "kept")


@query("delta_prune_long", f"{CHAT}, {NOVELTY_SQL} SELECT conv_id, turn, kept FROM walk WHERE i > 0")
def delta_prune_long(spark, sf_dir):
    """The distributed form for long conversations, forced on all of two turns and more."""
    return C.mark_novel(chat(spark, sf_dir), limit=1).select("conv_id", "turn", "kept")


def _budget_sql(score: str, source: str, budget: int | str, keep: int) -> str:
    """``pruned_v``: messages of ``source`` within the budget."""
    return f"""weighed AS (SELECT *, {token_count_sql('text')} AS tokens, {score} AS score,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {source} JOIN queries_v USING (conv_id)),
room AS (SELECT conv_id, greatest(0, {budget} - CAST(sum(tokens) FILTER (back <= {keep}) AS BIGINT)) AS room
  FROM weighed GROUP BY conv_id),
head AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS i FROM weighed WHERE back > {keep}),
fill AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, room, CAST(NULL AS BIGINT) AS turn, false AS taken FROM room
  UNION ALL SELECT h.conv_id, h.i, CASE WHEN h.tokens <= w.room THEN w.room - h.tokens ELSE w.room END, h.turn, h.tokens <= w.room
  FROM fill w JOIN head h ON h.conv_id = w.conv_id AND h.i = w.i + 1),
pruned_v AS (SELECT conv_id, turn, role, text FROM weighed WHERE back <= {keep}
  UNION ALL SELECT conv_id, turn, role, text FROM head JOIN fill USING (conv_id, turn) WHERE taken)"""


_BLEND = f"""CASE WHEN query = '' THEN {density_sql('text')} ELSE 0.5::DOUBLE * {_jaccard_sql(
    _set_sql('text', T.JACCARD_STOP), _set_sql('query', T.JACCARD_STOP))} + 0.5::DOUBLE * {density_sql('text')} END"""


def _pruned_query(score: str) -> str:
    return f"{CHAT}, {QUERIES_SQL}, {_budget_sql(score, 'chat_v', SMALL_BUDGET, SMALL_KEEP)} SELECT * FROM pruned_v"


@query("budget_prune", _pruned_query(_BLEND))
def budget_prune(spark, sf_dir):
    conv = chat(spark, sf_dir)
    return C.budget_prune(conv, R.last_user_queries(conv), SMALL_BUDGET, SMALL_KEEP)


@query("budget_prune_by_facts", _pruned_query(density_sql("text")))
def budget_prune_by_facts(spark, sf_dir):
    return C.budget_prune(chat(spark, sf_dir), None, SMALL_BUDGET, SMALL_KEEP)


@query("budget_prune_per_conversation", _pruned_query(_BLEND))
def budget_prune_per_conversation(spark, sf_dir):
    """Budgets as a table: the form whose budget may grow with the conversation."""
    conv = chat(spark, sf_dir)
    budgets = conv.groupBy("conv_id").agg(F.lit(SMALL_BUDGET).alias("budget"))
    queries = R.last_user_queries(conv)
    return C.budget_prune(conv, queries, keep_last=SMALL_KEEP, budgets=budgets)


# --- summaries and constraints ------------------------------------------------------------------

def _said_sql(source: str, name: str = "said", text: str = "text") -> str:
    return f"""{name} AS (SELECT conv_id, turn, role, unnest(range(len(s))) AS sent_no, unnest(s) AS sent
  FROM (SELECT conv_id, turn, role, {sentences_sql(text)} AS s FROM {source}))"""


def _summary_sql(source: str, budget: int) -> str:
    """``summaries_v``: extractive summaries of ``source``."""
    return f"""{_said_sql(source)},
rated AS (SELECT *, CASE WHEN role = 'user' THEN {intent_sql('sent')} ELSE {density_sql('sent')} * 4.0::DOUBLE END AS score,
    {key_sql('sent')} AS key, {token_count_sql('sent')} AS tokens FROM said WHERE role <> 'system'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY score DESC, turn, sent_no) AS nth
  FROM rated WHERE score > 0) WHERE nth = 1),
line AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, sent_no) AS i FROM best),
pick AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({budget} AS BIGINT) AS room, '' AS sent, false AS taken
    FROM (SELECT DISTINCT conv_id FROM {source})
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN r.tokens <= w.room THEN w.room - r.tokens ELSE w.room END, r.sent, r.tokens <= w.room
  FROM pick w JOIN line r ON r.conv_id = w.conv_id AND r.i = w.i + 1),
picked AS (SELECT conv_id, string_agg(sent, ' ' ORDER BY i) AS s FROM pick WHERE taken GROUP BY conv_id),
firsts AS (SELECT conv_id, min_by(sent, (turn, sent_no)) AS s FROM said
  WHERE role = 'user' AND (conv_id, turn) IN (SELECT (conv_id, min(turn)) FROM {source} WHERE role = 'user' GROUP BY conv_id)
  GROUP BY conv_id),
summaries_v AS (SELECT c.conv_id, coalesce(p.s, f.s, '') AS summary FROM (SELECT DISTINCT conv_id FROM {source}) c
  LEFT JOIN picked p ON p.conv_id = c.conv_id LEFT JOIN firsts f ON f.conv_id = c.conv_id)"""


def _summary_query(budget: int) -> str:
    return f"{CHAT}, {_summary_sql('chat_v', budget)} SELECT * FROM summaries_v"


@query("summary", _summary_query(C.SUMMARY_BUDGET))
def summary(spark, sf_dir):
    return C.summarize(chat(spark, sf_dir))


@query("summary_small", _summary_query(30))
def summary_small(spark, sf_dir):
    return C.summarize(chat(spark, sf_dir), budget=30)


_MERGED = f"regexp_extract_all({strip_sql("rtrim(o.summary, ' ' || chr(9) || chr(10) || chr(13)) || ' ' || n.summary")}, '\\S+')"


@query(
    "summary_rolling",
    f"""{CHAT}, early AS (SELECT * FROM chat_v WHERE turn < 4), late AS (SELECT * FROM chat_v WHERE turn >= 4),
o AS (WITH RECURSIVE {_summary_sql('early', 60)} SELECT * FROM summaries_v),
n AS (WITH RECURSIVE {_summary_sql('late', 60)} SELECT * FROM summaries_v)
SELECT conv_id, CASE WHEN coalesce(o.summary, '') = '' THEN {strip_sql('n.summary')}
  WHEN len({_MERGED}) > {int(60 / 1.3)} THEN array_to_string({_MERGED}[-{int(60 / 1.3)}:], ' ')
  ELSE {strip_sql("rtrim(o.summary, ' ' || chr(9) || chr(10) || chr(13)) || ' ' || n.summary")} END AS summary
FROM n LEFT JOIN o USING (conv_id)""",
)
def summary_rolling(spark, sf_dir):
    """Second half of each conversation merged into the summary of the first."""
    conv = chat(spark, sf_dir)
    old = C.summarize(conv.filter("turn < 4"), budget=60)
    return C.summarize(conv.filter("turn >= 4"), old, budget=60)


def _pins_sql(said: str) -> str:
    return f"""pins AS (SELECT conv_id, turn, CAST(sent_no AS INTEGER) AS sent_no, sent FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn, sent_no) AS nth FROM
    (SELECT *, {key_sql('sent')} AS key FROM {said} WHERE role IN ('user', 'system')
      AND {count_sql('sent', T.PERMANENT_PATTERN)} > 0)) WHERE nth = 1)"""


@query("pins", f"{CHAT}, {_said_sql('chat_v')}, {_pins_sql('said')} SELECT * FROM pins")
def pins(spark, sf_dir):
    return C.pinned_sentences(chat(spark, sf_dir))


@query(
    "dropped_messages",
    """SELECT conv_id, turn, role, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations k
  WHERE k.turn % 2 = 0 AND k.conv_id = c.conv_id AND k.role = c.role AND k.text = c.text)""",
)
def dropped_messages(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return C.dropped_messages(conv, conv.filter("turn % 2 = 0"))


@query(
    "assemble",
    f"""SELECT conv_id, turn, role, text, CASE segment WHEN 'tail' THEN 2 WHEN 'middle' THEN 1 ELSE 0 END AS part
FROM conversations JOIN ({_layout_sql(1, 2)}) USING (conv_id, turn)""",
)
def assemble(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    rows = conv.join(C.kv_layout(conv, 1, 2), ["conv_id", "turn"])
    parts = [rows.filter(F.col("segment") == s).drop("segment") for s in ("prefix", "middle", "tail")]
    return C.assemble(*parts)


# --- full job ---------------------------------------------------------------------------------


OPTIMIZE = {"budget": 400, "keep_last": 6, "summarize_at": 6, "prefix": 1, "tail": 2}


def _optimised(spark, sf_dir, **options):
    conv = chat(spark, sf_dir)
    return O.optimize_context(conv, R.last_user_queries(conv), **{**OPTIMIZE, **options})


def _report(rows):
    """The result without the message array: the prompt shows the same messages."""
    return rows.withColumn("n_messages", F.size("messages").cast("long")).drop("messages")


def _optimize_sql(
    mode: str = "lossless", use_kv: bool = True, summary_budget: int = C.SUMMARY_BUDGET, **options
) -> str:
    """The full job step by step over the same views as its parts.

    ``budget`` may be an expression over the conversation's messages.
    """
    o = {**OPTIMIZE, **options}
    prefix, tail = o["prefix"], o["tail"]
    base = " ".join(f"WHEN '{r}' THEN {v}::DOUBLE" for r, v in C.ROLE_KEEP.items())
    if use_kv:
        shape = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    count(*) OVER (PARTITION BY conv_id) AS total FROM pruned_v),
cut AS (SELECT *, CASE WHEN total <= {prefix + tail} OR i <= {prefix} THEN 'prefix' WHEN i > total - {tail} THEN 'tail'
    ELSE 'middle' END AS segment FROM placed),
aged AS (SELECT *, count(*) FILTER (segment = 'middle') OVER (PARTITION BY conv_id) AS mid FROM cut),
shares AS (SELECT conv_id, turn, segment, CASE WHEN segment = 'middle' AND role <> 'system' THEN greatest({C.MIN_KEEP}::DOUBLE,
    CASE role {base} ELSE 0.75::DOUBLE END * exp(-{C.DECAY[mode]}::DOUBLE * (mid - i + {prefix})::DOUBLE / greatest(mid - 1, 1)))
    ELSE 1.0::DOUBLE END AS keep_ratio FROM aged),
{_filter_sql('pruned_v', 'shares')},
shaped_v AS (SELECT f.conv_id, f.turn, f.role, segment, p.text AS before, f.text FROM filtered_v f
  JOIN shares USING (conv_id, turn) JOIN pruned_v p ON p.conv_id = f.conv_id AND p.turn = f.turn)"""
        pins = f"""{_said_sql('shaped_v', 'before_said', 'before')}, {_pins_sql('before_said')},
pin_texts AS (SELECT conv_id, '[CONSTRAINTS]' || chr(10) || string_agg(sent, ' ' ORDER BY turn, sent_no) AS block FROM pins GROUP BY conv_id),
gains AS (SELECT conv_id, sum({token_count_sql('before')} - {token_count_sql('text')}) FILTER (segment = 'middle') AS saved
  FROM shaped_v GROUP BY conv_id),
pin_blocks AS (SELECT conv_id, block AS kv_pinned FROM pin_texts JOIN gains USING (conv_id) WHERE saved > {token_count_sql('block')})"""
    else:
        shape = "shaped_v AS (SELECT *, 'middle' AS segment, text AS before FROM pruned_v)"
        pins = "pin_blocks AS (SELECT conv_id, '' AS kv_pinned FROM queries_v WHERE false)"
    short = aggressive_sql if mode == "aggressive" else str
    return f"""{CHAT}, {QUERIES_SQL}, {NOVELTY_SQL},
kept_v AS (SELECT m.conv_id, m.turn, m.role, m.text FROM msgs m JOIN walk w ON w.conv_id = m.conv_id AND w.i = m.i WHERE w.kept),
{_register_sql('kept_v')}, {REGISTER_BLOCK_SQL}, {_coded_sql('kept_v')},
budgets AS (SELECT conv_id, CAST({o['budget']} AS BIGINT) AS budget FROM chat_v GROUP BY conv_id),
{_budget_sql(_BLEND, '(SELECT * FROM coded_v JOIN budgets USING (conv_id))', 'any_value(budget)', o['keep_last'])},
{shape},
facts AS (SELECT conv_id, query, budget, n_messages, delta_dropped, {tokens_sql(f"words + {token_words_sql('query')}")} AS original_tokens
  FROM queries_v JOIN budgets USING (conv_id) JOIN (SELECT conv_id, count(*) AS n_messages, CAST(sum({token_words_sql('text')}) AS BIGINT) AS words
    FROM chat_v GROUP BY conv_id) USING (conv_id)
  JOIN (SELECT conv_id, count(*) FILTER (NOT kept) AS delta_dropped FROM walk GROUP BY conv_id) USING (conv_id)),
due AS (SELECT conv_id FROM facts WHERE n_messages >= {o['summarize_at']} OR original_tokens > budget),
lost AS (SELECT * FROM coded_v a WHERE NOT EXISTS (SELECT 1 FROM shaped_v s
  WHERE s.conv_id = a.conv_id AND s.role = a.role AND s.text = a.text)),
retold_v AS (SELECT * FROM lost WHERE conv_id IN (FROM due) UNION ALL
  SELECT * FROM coded_v WHERE conv_id IN (FROM due) AND conv_id NOT IN (SELECT conv_id FROM lost)),
{_summary_sql('retold_v', summary_budget)},
{pins},
middle_v AS (SELECT * FROM shaped_v WHERE segment = 'middle'),
{_phrase_sql('middle_v')}, {_phrased_sql('middle_v')},
tables AS (SELECT conv_id, 'SYMBOLS: {{' || string_agg(symbol || '=' || phrase, ', ' ORDER BY rank) || '}}' AS symbols,
    CAST(sum({token_words_sql("symbol || '=' || phrase")}) AS BIGINT) AS words FROM phrases GROUP BY conv_id),
coding AS (SELECT conv_id, symbols, saved FROM tables JOIN (SELECT conv_id, CAST(sum(saved) AS BIGINT) AS saved FROM phrased_v GROUP BY conv_id)
  USING (conv_id) WHERE saved > {tokens_sql('words')}),
said_v AS (SELECT s.conv_id, s.turn, s.role, {short('coalesce(p.text, s.text)')} AS content FROM shaped_v s
  LEFT JOIN (SELECT phrased_v.* FROM phrased_v JOIN coding USING (conv_id)) p ON p.conv_id = s.conv_id AND p.turn = s.turn),
talks AS (SELECT conv_id, count(*) AS n, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY turn) AS talk,
    CAST(sum({token_words_sql('content')}) AS BIGINT) AS words FROM said_v GROUP BY conv_id),
parts AS (SELECT conv_id, {short('query')} AS user, n_messages AS n_all, delta_dropped, original_tokens, coalesce(summary, '') AS new_summary,
    coalesce(entity_register, '') AS entity_register, coalesce(kv_pinned, '') AS kv_pinned, coalesce(symbols, '') AS symbols,
    coalesce(saved, 0) AS huffman_tokens_saved, coalesce(n, 0) AS n_messages, talk, coalesce(words, 0) AS words
  FROM facts LEFT JOIN summaries_v USING (conv_id) LEFT JOIN register_blocks USING (conv_id) LEFT JOIN pin_blocks USING (conv_id)
  LEFT JOIN coding USING (conv_id) LEFT JOIN talks USING (conv_id)),
systems AS (SELECT *, {strip_sql(f"concat_ws(chr(10), nullif(kv_pinned, ''), nullif(new_summary, ''), nullif(entity_register, ''), nullif(symbols, ''))")} AS system,
    {tokens_sql(f"words + {token_words_sql('user')}")} AS optimized_tokens FROM parts)
SELECT conv_id, concat_ws(chr(10) || chr(10), CASE WHEN system <> '' THEN '[CONTEXT]' || chr(10) || system END,
    '[CONVERSATION]' || chr(10) || talk, '[QUERY]' || chr(10) || user) AS optimized_prompt, system, user, new_summary,
  greatest(0, original_tokens - optimized_tokens) AS tokens_saved_estimate, original_tokens, optimized_tokens,
  n_all - n_messages AS messages_pruned, delta_dropped, huffman_tokens_saved, entity_register, kv_pinned, n_messages FROM systems"""


@query("optimize", _optimize_sql())
def optimize(spark, sf_dir):
    return _report(_optimised(spark, sf_dir))


TIGHT = {"budget": 150, "keep_last": 4, "summarize_at": 3}


@query("optimize_tight", _optimize_sql(**TIGHT))
def optimize_tight(spark, sf_dir):
    return _report(_optimised(spark, sf_dir, **TIGHT))


@query("optimize_aggressive", _optimize_sql("aggressive", keep_last=2))
def optimize_aggressive(spark, sf_dir):
    return _report(_optimised(spark, sf_dir, mode="aggressive", keep_last=2))


@query("optimize_without_layout", _optimize_sql(use_kv=False))
def optimize_without_layout(spark, sf_dir):
    return _report(_optimised(spark, sf_dir, use_kv=False))


@query(
    "optimize_original_tokens",
    f"""{CHAT}, {QUERIES_SQL}, {NOVELTY_SQL}
SELECT conv_id, {tokens_sql(f"n + {token_words_sql('query')}")} AS original_tokens, delta_dropped FROM queries_v
JOIN (SELECT conv_id, CAST(sum({token_words_sql('text')}) AS BIGINT) AS n FROM chat_v GROUP BY conv_id) USING (conv_id)
JOIN (SELECT conv_id, count(*) FILTER (NOT kept) AS delta_dropped FROM walk GROUP BY conv_id) USING (conv_id)""",
)
def optimize_original_tokens(spark, sf_dir):
    return _optimised(spark, sf_dir).select("conv_id", "original_tokens", "delta_dropped")


@query(
    "context_stats",
    f"""SELECT 'lossless' AS mode, 'p' || (conv_id % 3) AS platform, count(*) AS n,
  CAST(sum(tokens_saved_estimate) AS BIGINT) AS tokens_saved, CAST(sum(messages_pruned) AS BIGINT) AS messages_pruned
FROM ({_optimize_sql()}) GROUP BY ALL""",
)
def context_stats(spark, sf_dir):
    rows = _optimised(spark, sf_dir).withColumn("mode", F.lit("lossless"))
    return O.context_stats(rows.withColumn("platform", F.concat(F.lit("p"), F.col("conv_id") % 3)))


_PROXY_TOKENS = "greatest(1, {} * 4 // 3)"
_PROXY_SIZE = f"CAST(sum({_PROXY_TOKENS.format(space_words_sql('text'))}) AS BIGINT)"


def _proxy_sql() -> str:
    made = _optimize_sql(
        budget=f"greatest({O.PROXY_MIN_BUDGET}, {_PROXY_SIZE} // 2)",
        keep_last=O.PROXY["keep_last"],
        summarize_at=O.PROXY["summarize_at"],
        summary_budget=O.PROXY["summary_budget"],
        prefix=C.KV_PREFIX,
        tail=C.KV_TAIL,
    )
    size = _PROXY_TOKENS.format(space_words_sql("optimized_prompt"))
    return f"""{CHAT}, made AS ({made}),
sizes AS (SELECT conv_id, {_PROXY_SIZE} AS size FROM chat_v GROUP BY conv_id)
SELECT conv_id, 0 AS part, turn, role, text, CAST(NULL AS BIGINT) AS saved FROM chat_v WHERE role = 'system'
UNION ALL SELECT conv_id, 1, NULL, 'user', optimized_prompt, greatest(0, size - {size}) FROM made JOIN sizes USING (conv_id)
UNION ALL SELECT conv_id, 2, turn, role, text, NULL FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth
  FROM chat_v WHERE role <> 'system') WHERE nth <= {O.PROXY_TAIL}"""


@query("proxy_history", _proxy_sql())
def proxy_history(spark, sf_dir):
    return O.compress_history(chat(spark, sf_dir))
