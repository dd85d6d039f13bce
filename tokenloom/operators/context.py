"""Conversation context: layout, pruning, entity and phrase tables, summaries.

``conv`` is a table of messages ``conv_id, turn, role, text``; ``turn`` gives the order.
Per-conversation collections are either bounded by a token budget or pre-aggregated; the one
strict fold (novelty) is decided by bounds on each token in long conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.columns import let
from tokenloom.plans.groups import (
    HOT_ROWS,
    cut_lineage,
    numbered,
    running_total,
    split_hot,
    walk_in_order,
)

# --- fixed values -----------------------------------------------------------------------------
BUDGET = 3_000
KEEP_LAST = 6
SUMMARIZE_AT = 12
SUMMARY_BUDGET = 400
KV_PREFIX = 2
KV_TAIL = 4
ROLE_KEEP = {"system": 1.0, "user": 0.75, "assistant": 0.42}
DECAY = {"lossless": 0.8, "aggressive": 1.6}
MIN_KEEP = 0.10
MIN_NEW_WORDS = 5
ENTITY_SYMBOL = "§E"
PHRASE_SYMBOL = "§H"
PHRASE_TOP = 8
PHRASE_MIN_COUNT = 3
PHRASE_MIN_CHARS = 5
# --- end of fixed values ------------------------------------------------------------------------

FOLD_TURNS = 256
REGISTER_ARRAY = 1_000


# --- layout -----------------------------------------------------------------------------------


def segment_column(rank: Column, total: Column, prefix: int, tail: int) -> Column:
    """Where message ``rank`` of ``total`` lies; short conversations are all prefix."""
    return (
        F.when((total <= prefix + tail) | (rank <= prefix), "prefix")
        .when(rank > total - tail, "tail")
        .otherwise("middle")
    )


def kv_layout(
    conv: DataFrame, prefix: int = KV_PREFIX, tail: int = KV_TAIL, limit: int = HOT_ROWS
) -> DataFrame:
    """Split each conversation in a verbatim prefix, a middle and a verbatim tail."""
    rows = numbered(conv.select("conv_id", "turn"), ["conv_id"], ["turn"], "rank", "total", limit)
    return rows.select(
        "conv_id",
        "turn",
        segment_column(F.col("rank"), F.col("total"), prefix, tail).alias("segment"),
    )


def age_column(rank: Column, total: Column) -> Column:
    """0 for the newest message, 1 for the oldest."""
    return (total - rank) / F.greatest(total - 1, F.lit(1))


def keep_ratio_column(role: Column, age: Column, mode: str = "lossless") -> Column:
    base = F.when(F.lit(False), F.lit(0.0))
    for name, share in ROLE_KEEP.items():
        base = base.when(role == name, share)
    decay = DECAY.get(mode, DECAY["lossless"])
    return F.greatest(F.lit(MIN_KEEP), base.otherwise(0.75) * F.exp(-decay * age))


def keep_ratio(conv: DataFrame, mode: str = "lossless", limit: int = HOT_ROWS) -> DataFrame:
    """Share of sentences each message keeps, by role and age; system messages keep all."""
    slim = conv.select("conv_id", "turn", "role")
    rows = numbered(slim, ["conv_id"], ["turn"], "rank", "total", limit)
    rows = rows.withColumn("age", age_column(F.col("rank"), F.col("total")))
    ratio = keep_ratio_column(F.col("role"), F.col("age"), mode)
    return rows.select(
        "conv_id",
        "turn",
        "age",
        F.when(F.col("role") == "system", 1.0).otherwise(ratio).alias("keep_ratio"),
    )


# --- novelty ----------------------------------------------------------------------------------


def _novelty_sets(conv: DataFrame) -> DataFrame:
    return conv.withColumn("_ents", T.entities(F.col("text"))).withColumn(
        "_words", T.word_set(F.col("text"), T.NOVELTY_STOP)
    )


def _novelty_fold(conv: DataFrame) -> DataFrame:
    """Strict left-to-right pass over one array per conversation."""
    columns = [c for c in conv.columns if c not in ("_ents", "_words")]
    others = [c for c in columns if c not in ("conv_id", "turn")]
    grouped = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", *others, "_ents", "_words"))).alias("_msgs")
    )

    def step(state: Column, m: Column) -> Column:
        new_words = F.size(F.array_except(m["_words"], state["known"]))
        new_entities = F.size(F.array_except(m["_ents"], state["known"]))
        keep = (m["role"] == "system") | (new_entities > 0) | (new_words > MIN_NEW_WORDS)

        def advance(k: Column) -> Column:
            gained = F.array_union(F.array_union(state["known"], m["_ents"]), m["_words"])
            return F.struct(
                F.when(k, gained).otherwise(state["known"]).alias("known"),
                F.concat(state["kept"], F.array(k)).alias("kept"),
            )

        return let(F.coalesce(keep, F.lit(False)), advance)

    start = F.struct(
        F.array().cast("array<string>").alias("known"),
        F.array().cast("array<boolean>").alias("kept"),
    )
    flags = F.aggregate("_msgs", start, step, lambda s: s["kept"])
    rows = grouped.withColumn("_kept", flags).select(
        "conv_id", F.explode(F.arrays_zip("_msgs", "_kept")).alias("_m")
    )
    return rows.select(
        "conv_id",
        "_m._msgs.turn",
        *[F.col(f"_m._msgs.{c}").alias(c) for c in others],
        F.col("_m._kept").alias("kept"),
    ).select(*columns, "kept")


def _token_rows(messages: DataFrame, *columns: str | Column) -> DataFrame:
    """A row for each entity and word of ``messages``: token, and whether it is an entity."""

    def flagged(tokens: str, entity: bool) -> Column:
        each = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(entity).alias("entity")))
        return F.coalesce(each, F.array().cast("array<struct<token:string,entity:boolean>>"))

    return messages.select(*columns, F.inline(F.concat(flagged("_ents", True), flagged("_words", False))))


def _by_kind(tokens: str | Column) -> tuple[Column, Column]:
    """How many of the tokens are entities, and how many words."""
    return F.size(F.filter(tokens, lambda x: x["entity"])), F.size(F.filter(tokens, lambda x: ~x["entity"]))


def _enough(entities: Column, words: Column) -> Column:
    return (entities > 0) | (words > MIN_NEW_WORDS)


def _novelty_bounds(conv: DataFrame) -> DataFrame:
    """The same decisions for conversations of any length, by bounds that need no order.

    A token is surely new in the first message that has it; messages with enough of those are surely
    kept. Tokens that a surely kept message had before are known; messages without enough others are
    dropped. Both are groupings by token, so a long conversation is spread over all tasks. Only what is
    left in doubt, messages with tokens that dropped or doubtful ones had before, needs the order: it
    walks with those tokens alone.
    """
    keys = ["conv_id", "turn"]
    slim = conv.select(*keys, F.coalesce(F.col("role") == "system", F.lit(False)).alias("_system"), "_ents", "_words")
    first = _token_rows(slim, *keys).groupBy("conv_id", "token").agg(
        F.min("turn").alias("turn"),
        F.min(F.when(F.col("entity"), F.col("turn"))).alias("as_entity"),
        F.min(F.when(~F.col("entity"), F.col("turn"))).alias("as_word"),
    )
    # New tokens and the messages themselves meet in one grouping.
    new = first.select(
        *keys,
        (F.col("as_entity") == F.col("turn")).cast("int").alias("_e"),
        (F.col("as_word") == F.col("turn")).cast("int").alias("_w"),
    )
    judged = slim.unionByName(new, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("_system").alias("_system"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("_ents", "_words")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_e", "_w")],
    )
    sure = F.col("_system") | _enough(F.col("_e"), F.col("_w"))
    judged = judged.select(*keys, "_ents", "_words", sure.alias("sure"))

    bounds = _token_rows(judged, *keys, "sure").groupBy("conv_id", "token").agg(
        F.when(F.min("turn") == F.max("turn"), 1).otherwise(2).alias("_n"), F.min(F.when(F.col("sure"), F.col("turn"))).alias("known")
    )
    rows = _token_rows(judged.filter("NOT sure"), *keys).join(bounds, ["conv_id", "token"])
    rows = rows.filter("known IS NULL OR known >= turn")
    # Tokens of this message alone only count; the others may be known, or become known, through it.
    alone = F.col("_n") == 1
    open_ = rows.groupBy(*keys).agg(
        F.count(F.when(alone & F.col("entity"), 1)).alias("new_entities"),
        F.count(F.when(alone & ~F.col("entity"), 1)).alias("new_words"),
        F.collect_list(F.when(~alone, F.struct("token", "entity"))).alias("tokens"),
    )
    entities, words = _by_kind("tokens")
    possible = _enough(F.col("new_entities") + entities, F.col("new_words") + words)
    doubtful = open_.filter(possible)

    def settle(known: set, message: tuple) -> tuple:
        conv_id, turn, new_entities, new_words, tokens = message
        fresh = [x for x in tokens if x["token"] not in known]
        n = sum(x["entity"] for x in fresh)
        keep = new_entities + n > 0 or new_words + len(fresh) - n > MIN_NEW_WORDS
        if keep:
            known.update(x["token"] for x in fresh)
        return conv_id, turn, keep

    kinds = {c: conv.schema[c].dataType.simpleString() for c in keys}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, kept boolean"
    settled = walk_in_order(doubtful, "conv_id", ["turn"], schema, set, settle)
    marks = judged.filter("sure").select(*keys, F.lit(True).alias("kept")).unionByName(settled)
    out = conv.drop("_ents", "_words").join(marks, keys, "left")
    return out.withColumn("kept", F.coalesce("kept", F.lit(False)))


def mark_novel(conv: DataFrame, limit: int = FOLD_TURNS) -> DataFrame:
    """Add ``kept``: false for a message that brings no new entity and at most five new words.

    Conversations of more than ``limit`` messages are decided by bounds on each token.
    """
    usual, hot = split_hot(conv, ["conv_id"], limit)
    done = _novelty_fold(_novelty_sets(usual))
    if hot is None:
        return done
    return done.unionByName(_novelty_bounds(_novelty_sets(hot)))


def delta_prune(conv: DataFrame, limit: int = FOLD_TURNS) -> DataFrame:
    return mark_novel(conv, limit).filter("kept").drop("kept")


# --- entity register --------------------------------------------------------------------------


def entity_register(conv: DataFrame, min_messages: int = 2, limit: int = HOT_ROWS) -> DataFrame:
    """Entities found in several messages of a conversation, ranked, with their symbols."""
    counts = (
        conv.select("conv_id", F.explode(T.entities(F.col("text"))).alias("entity"))
        .groupBy("conv_id", "entity")
        .agg(F.count(F.lit(1)).alias("n_messages"))
        .filter(F.col("n_messages") >= min_messages)
    )
    ranked = numbered(
        cut_lineage(counts), ["conv_id"], [F.desc("n_messages"), F.asc("entity")], "rank", None, limit
    )
    return ranked.select(
        "conv_id",
        "rank",
        "entity",
        F.concat(F.lit(ENTITY_SYMBOL), F.col("rank").cast("string")).alias("symbol"),
        "n_messages",
    )


def _pairs_block(df: DataFrame, rank: str, left: str, right: str, head: str, out: str) -> DataFrame:
    """``head: {left=right, ...}`` per conversation, in rank order."""
    pairs = F.array_sort(
        F.collect_list(F.struct(F.col(rank), F.concat_ws("=", F.col(left), F.col(right)).alias("p")))
    )
    text = F.array_join(F.transform(pairs, lambda x: x["p"]), ", ")
    return df.groupBy("conv_id").agg(F.concat(F.lit(head + ": {"), text, F.lit("}")).alias(out))


def register_block(register: DataFrame) -> DataFrame:
    return _pairs_block(register, "rank", "symbol", "entity", "ENTITIES", "entity_register")


def _substitute(text: Column, entries: Column) -> Column:
    """Replace ``entries`` (rank, entity) longest first; ties by rank.

    The text is an array of segments; a symbol is a segment of its own that is done, so a later,
    shorter entity cannot match inside one, whatever characters the text has.
    """
    ordered = F.array_sort(
        F.transform(
            entries,
            lambda e: F.struct(
                (-F.length(e["entity"])).alias("shorter"),
                e["rank"].alias("rank"),
                e["entity"].alias("entity"),
            ),
        )
    )

    def segment(done: bool, value: Column) -> Column:
        return F.struct(F.lit(done).alias("done"), value.alias("text"))

    def replace(segments: Column, e: Column) -> Column:
        symbol = F.concat(F.lit(ENTITY_SYMBOL), e["rank"].cast("string"))
        quoted = F.concat(F.lit("\\Q"), F.replace(e["entity"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

        def cut(s: Column) -> Column:
            between = F.transform(
                F.split(s["text"], quoted, -1),
                lambda part, i: F.when(i == 0, F.array(segment(False, part))).otherwise(
                    F.array(segment(True, symbol), segment(False, part))
                ),
            )
            whole = s["done"] | ~F.contains(s["text"], e["entity"])
            return F.when(whole, F.array(s)).otherwise(F.flatten(between))

        return F.flatten(F.transform(segments, cut))

    return F.aggregate(
        ordered,
        F.array(segment(False, text)),
        replace,
        lambda done: F.array_join(F.transform(done, lambda s: s["text"]), ""),
    )


def apply_register(
    conv: DataFrame, register: DataFrame, limit: int = REGISTER_ARRAY
) -> DataFrame:
    """Replace every occurrence of a registered entity by its symbol.

    Registers up to ``limit`` entities travel as one array per conversation. Larger ones are
    joined on the first two characters, so each message meets only entities it may contain.
    """
    entry = F.struct("rank", "entity")
    slim = register.select("conv_id", "rank", "entity")
    usual, hot = split_hot(slim, ["conv_id"], limit)
    arrays = usual.groupBy("conv_id").agg(F.collect_list(entry).alias("_entries"))

    def replaced(rows: DataFrame) -> DataFrame:
        inside = F.filter("_entries", lambda e: F.contains(F.col("text"), e["entity"]))
        text = F.when(F.col("_entries").isNull(), F.col("text")).otherwise(
            _substitute(F.col("text"), inside)
        )
        return rows.withColumn("text", text).drop("_entries")

    if hot is None:
        return replaced(conv.join(arrays, "conv_id", "left")).select(*conv.columns)

    wide = conv.join(hot.select("conv_id").distinct(), "conv_id", "left_semi")
    starts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))),
        lambda i: F.substring(F.col("text"), i, F.lit(2)),
    )
    met = (
        wide.select("conv_id", "turn", "text", F.explode(F.array_distinct(starts)).alias("_start"))
        .join(
            hot.withColumn("_start", F.substring("entity", 1, 2)),
            ["conv_id", "_start"],
        )
        .filter(F.contains(F.col("text"), F.col("entity")))
    )
    own = met.groupBy("conv_id", "turn").agg(F.collect_list(entry).alias("_entries"))
    narrow = conv.join(hot.select("conv_id").distinct(), "conv_id", "left_anti")
    return (
        replaced(narrow.join(arrays, "conv_id", "left"))
        .unionByName(replaced(wide.join(own, ["conv_id", "turn"], "left")))
        .select(*conv.columns)
    )


# --- phrases ----------------------------------------------------------------------------------


def _with_previous_words(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``_before``: the last two words ahead of each message with words."""
    usual, hot = split_hot(rows, ["conv_id"], limit)
    window = Window.partitionBy("conv_id").orderBy("turn")
    end = F.slice("_words", F.greatest(F.size("_words") - 1, F.lit(1)), 2)
    nothing = F.array().cast("array<string>")

    def last_two(earlier: Column, later: Column) -> Column:
        both = F.concat(F.coalesce(earlier, nothing), F.coalesce(later, nothing))
        return F.slice(both, F.greatest(F.size(both) - 1, F.lit(1)), 2)

    usual = usual.withColumn("_end", end).withColumn(
        "_before", last_two(F.lag("_end", 2).over(window), F.lag("_end", 1).over(window))
    )
    if hot is None:
        return usual.drop("_end")
    placed = cut_lineage(numbered(hot.withColumn("_end", end), ["conv_id"], ["turn"], "_pos", None, limit))

    def shifted(by: int, name: str) -> DataFrame:
        return placed.select("conv_id", (F.col("_pos") + by).alias("_pos"), F.col("_end").alias(name))

    rest = (
        placed.join(shifted(1, "_one"), ["conv_id", "_pos"], "left")
        .join(shifted(2, "_two"), ["conv_id", "_pos"], "left")
        .withColumn("_before", last_two(F.col("_two"), F.col("_one")))
    )
    return usual.drop("_end").unionByName(rest.drop("_one", "_two", "_pos", "_end"))


def phrase_table(
    conv: DataFrame,
    top_n: int = PHRASE_TOP,
    min_freq: int = PHRASE_MIN_COUNT,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """The two- and three-word phrases of a conversation that save most when coded.

    Words run on across message borders. Ranked by (words - 1) x count; ties go to three-word
    phrases, then to the earlier first use.
    """
    rows = conv.select("conv_id", "turn", T.words(F.col("text")).alias("_words"))
    rows = _with_previous_words(rows.filter(F.size("_words") > 0), limit)
    rows = rows.select(
        "conv_id",
        "turn",
        F.concat("_before", "_words").alias("_run"),
        F.size("_before").alias("_skip"),
    )

    def grams(run: Column, n: int) -> Column:
        words, skip = run["words"], run["skip"]
        first = F.greatest(F.lit(n), skip + 1)
        ends = F.when(first <= F.size(words), F.sequence(first, F.size(words)))
        return F.transform(
            F.coalesce(ends, F.array().cast("array<int>")),
            lambda e: F.struct(
                F.lit(n).alias("n"),
                F.array_join(F.slice(words, e - (n - 1), F.lit(n)), " ").alias("phrase"),
                (e - skip).alias("pos"),
            ),
        )

    bound = F.struct(F.col("_run").alias("words"), F.col("_skip").alias("skip"))
    found = let(bound, lambda run: F.concat(grams(run, 3), grams(run, 2)))
    counts = (
        rows.select("conv_id", "turn", F.inline(found))
        .filter(F.length("phrase") > PHRASE_MIN_CHARS)
        .groupBy("conv_id", "n", "phrase")
        .agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("turn", "pos")).alias("_first"))
        .filter(F.col("freq") >= min_freq)
        .withColumn("savings", (F.col("n") - 1) * F.col("freq"))
    )
    best = Window.partitionBy("conv_id").orderBy(F.desc("savings"), F.desc("n"), "_first")
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top_n)
        .select(
            "conv_id",
            F.col("rank").cast("long").alias("rank"),
            "phrase",
            F.concat(F.lit(PHRASE_SYMBOL), F.col("rank").cast("string")).alias("symbol"),
            "freq",
            "savings",
        )
    )


def phrase_block(phrases: DataFrame) -> DataFrame:
    return _pairs_block(phrases, "rank", "symbol", "phrase", "SYMBOLS", "symbols")


def apply_phrases(conv: DataFrame, phrases: DataFrame) -> DataFrame:
    """Replace phrases (longest first, whole words, any case) and count the words saved."""
    arrays = phrases.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.length("phrase")).alias("shorter"), "rank", "phrase", "symbol")
            )
        ).alias("_phrases")
    )

    def step(state: Column, p: Column) -> Column:
        pattern = F.concat(F.lit(T.unicode_pattern(r"\b", True)), p["phrase"], F.lit(r"\b"))
        gain = F.regexp_count(state["text"], pattern) * (F.size(F.split(p["phrase"], " ")) - 1)
        return F.struct(
            F.regexp_replace(state["text"], pattern, p["symbol"]).alias("text"),
            (state["saved"] + gain).cast("long").alias("saved"),
        )

    start = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("saved"))
    rows = conv.join(arrays, "conv_id", "left").withColumn(
        "_done",
        F.when(F.col("_phrases").isNull(), start).otherwise(F.aggregate("_phrases", start, step)),
    )
    kept = [c for c in conv.columns if c != "text"]
    return rows.select(*kept, "_done.text", "_done.saved")


# --- budget -----------------------------------------------------------------------------------


def _first_fit(candidates: Column, room: Column) -> Column:
    """Walk the ordered array, taking each entry whose ``tokens`` still fit."""
    start = F.struct(room.cast("long").alias("room"), F.array().cast("array<long>").alias("turns"))

    def step(state: Column, c: Column) -> Column:
        return F.when(
            c["tokens"] <= state["room"],
            F.struct(
                (state["room"] - c["tokens"]).alias("room"),
                F.concat(state["turns"], F.array(c["turn"])).alias("turns"),
            ),
        ).otherwise(state)

    return F.aggregate(candidates, start, step, lambda s: s["turns"])


def _fill_budget(head: DataFrame, room_bound: int | None, limit: int) -> DataFrame:
    """Turns of ``head`` (conv_id, turn, score, tokens, room) chosen first-fit by score.

    Of the entries of equal size only the first ``room / size`` by score can ever be taken, so
    at most room x ln(room) small entries per conversation reach the fold.
    """
    by_score = [F.desc("score"), F.asc("turn")]
    fits = head.filter(F.col("tokens") <= F.col("room"))
    if room_bound is not None:
        same_size = Window.partitionBy("conv_id", "tokens").orderBy(*by_score)
        ranked = fits.withColumn("_nth", F.row_number().over(same_size)).filter(
            F.col("_nth") <= room_bound
        )
    else:
        ranked = numbered(cut_lineage(fits), ["conv_id", "tokens"], by_score, "_nth", None, limit)
    useful = ranked.filter(F.col("_nth") * F.col("tokens") <= F.col("room"))
    grouped = useful.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("loss"), "turn", "tokens"))
        ).alias("_candidates"),
        F.first("room").alias("room"),
    )
    chosen = _first_fit(F.col("_candidates"), F.col("room"))
    return grouped.select("conv_id", F.explode(chosen).alias("turn"))


def _fill_large_budget(head: DataFrame, limit: int) -> DataFrame:
    """As above where the room itself grows with the conversation.

    Everything up to the first entry that does not fit is taken by a running total; what is
    left is smaller than that one entry, so the fold stays small.
    """
    head = cut_lineage(head)
    order = [F.desc("score"), F.asc("turn")]
    summed = cut_lineage(running_total(head, ["conv_id"], order, F.col("tokens"), "_sum", None, limit))
    taken = summed.filter(F.col("_sum") <= F.col("room"))
    used = taken.groupBy("conv_id").agg(F.max("_sum").alias("_used"))
    rest = (
        summed.filter(F.col("_sum") > F.col("room"))
        .join(used, "conv_id", "left")
        .withColumn("room", F.col("room") - F.coalesce("_used", F.lit(0)))
        .select("conv_id", "turn", "score", "tokens", "room")
    )
    return taken.select("conv_id", "turn").unionByName(_fill_budget(rest, None, limit))


def budget_prune(
    conv: DataFrame,
    queries: DataFrame | None = None,
    budget: int = BUDGET,
    keep_last: int = KEEP_LAST,
    budgets: DataFrame | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Fit each conversation into a token budget.

    The last ``keep_last`` messages stay. Older ones are taken by half query overlap and half
    fact density (density only without a query), skipping those that do not fit any more.
    ``budgets`` (conv_id, budget) overrides the common budget.
    """
    budget, keep_last = budget or BUDGET, keep_last or KEEP_LAST
    scored = conv.withColumn("_tokens", T.token_count(F.col("text")))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    tail = (
        scored.select("conv_id", "turn", "_tokens")
        .withColumn("_nth", F.row_number().over(newest))
        .filter(F.col("_nth") <= keep_last)
        .groupBy("conv_id")
        .agg(F.min("turn").alias("_from"), F.sum("_tokens").alias("_tail"))
    )
    if budgets is None:
        tail = tail.withColumn("budget", F.lit(budget))
    else:
        tail = tail.join(budgets.select("conv_id", "budget"), "conv_id")
    room = F.greatest(F.lit(0), F.col("budget") - F.col("_tail")).cast("long")
    limits = tail.select("conv_id", "_from", room.alias("room"))

    density = T.fact_density(F.col("text"))
    if queries is None:
        scored = scored.withColumn("score", density)
    else:
        wanted = queries.select(
            "conv_id",
            F.col("query").alias("_query"),
            T.word_set(F.col("query"), T.JACCARD_STOP).alias("_wanted"),
        )
        overlap = T.jaccard(T.word_set(F.col("text"), T.JACCARD_STOP), F.col("_wanted"))
        scored = scored.join(wanted, "conv_id", "left").withColumn(
            "score",
            F.when(F.coalesce(F.col("_query"), F.lit("")) == "", density).otherwise(
                0.5 * overlap + 0.5 * density
            ),
        )
    head = (
        scored.select("conv_id", "turn", "score", F.col("_tokens").alias("tokens"))
        .join(limits, "conv_id")
        .filter(F.col("turn") < F.col("_from"))
        .drop("_from")
    )
    if budgets is None:
        older = _fill_budget(head, budget, limit)
    else:
        older = _fill_large_budget(head, limit)
    recent = conv.join(limits.select("conv_id", "_from"), "conv_id").filter(
        F.col("turn") >= F.col("_from")
    )
    return recent.drop("_from").unionByName(conv.join(older, ["conv_id", "turn"], "left_semi"))


# --- summaries --------------------------------------------------------------------------------


def scored_sentences(conv: DataFrame) -> DataFrame:
    """Sentences worth keeping: users' by intent, others' by facts, system left out."""
    rows = conv.filter(F.col("role") != "system").select(
        "conv_id", "turn", "role", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sent")
    )
    score = F.when(F.col("role") == "user", T.intent_score(F.col("sent"))).otherwise(
        T.fact_density(F.col("sent")) * 4.0
    )
    return rows.withColumn("score", score).filter(F.col("score") > 0)


def summarize(
    conv: DataFrame,
    prior: DataFrame | None = None,
    budget: int = SUMMARY_BUDGET,
    key_chars: int | None = None,
) -> DataFrame:
    """Extractive summary per conversation, merged with a prior one (conv_id, summary).

    Sentences that agree in their letters (or the first ``key_chars``) count once, with their
    best score. Then sentences are taken by score
    while they fit; the first user sentence stands in when none does.
    """
    rank_key = F.struct((-F.col("score")).alias("loss"), "turn", "sent_no")
    distinct = (
        scored_sentences(conv)
        .withColumn("_key", T.sentence_key(F.col("sent"), key_chars))
        .groupBy("conv_id", "_key")
        .agg(F.min(F.struct(rank_key.alias("at"), F.col("sent"))).alias("_s"))
        .select("conv_id", "_s.at", "_s.sent")
        .withColumn("tokens", T.token_count(F.col("sent")))
        .filter(F.col("tokens") <= budget)
    )
    same_size = Window.partitionBy("conv_id", "tokens").orderBy("at")
    useful = (
        distinct.withColumn("_nth", F.row_number().over(same_size))
        .filter(F.col("_nth") <= budget)
        .filter(F.col("_nth") * F.col("tokens") <= budget)
    )
    start = F.struct(
        F.lit(budget).cast("long").alias("room"), F.array().cast("array<string>").alias("sents")
    )

    def step(state: Column, s: Column) -> Column:
        return F.when(
            s["tokens"] <= state["room"],
            F.struct(
                (state["room"] - s["tokens"]).alias("room"),
                F.concat(state["sents"], F.array(s["sent"])).alias("sents"),
            ),
        ).otherwise(state)

    picked = useful.groupBy("conv_id").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("at", "tokens", "sent"))),
            start,
            step,
            lambda s: F.array_join(s["sents"], " "),
        ).alias("_picked")
    )
    is_user = F.col("role") == "user"
    fallback = conv.groupBy("conv_id").agg(
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("_first")
    )
    first_sentence = F.get(T.sentences(F.coalesce("_first", F.lit(""))), F.lit(0))
    rows = fallback.join(picked, "conv_id", "left").select(
        "conv_id", F.coalesce("_picked", first_sentence, F.lit("")).alias("_new")
    )
    if prior is None:
        return rows.select("conv_id", T.strip(F.col("_new")).alias("summary"))

    rows = rows.join(prior.select("conv_id", F.col("summary").alias("_old")), "conv_id", "left")
    return rows.select("conv_id", merge_summaries("_old", "_new", budget).alias("summary"))


def merge_summaries(old: str, new: str, budget: int = SUMMARY_BUDGET) -> Column:
    """Old summary and new part; only the last words within the budget remain if too long."""
    size = int(budget / T.TOKENS_PER_WORD)
    joined = T.strip(
        F.concat(F.rtrim(F.col(old), F.lit(T.SPACE_CHARS)), F.lit(" "), F.col(new))
    )

    def cut(text: Column) -> Column:
        words = F.split(text, f"[{T.SPACE}]+")
        last = F.slice(words, -size, size)
        return F.when(F.size(words) > size, F.array_join(last, " ")).otherwise(text)

    return F.when(F.coalesce(F.col(old), F.lit("")) == "", T.strip(F.col(new))).otherwise(
        let(joined, cut)
    )


def dropped_messages(everything: DataFrame, kept: DataFrame) -> DataFrame:
    """Messages without an equal (conversation, role, text) among the kept ones."""
    left, right = everything.alias("a"), kept.alias("b")
    same = (
        F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
        & F.col("a.role").eqNullSafe(F.col("b.role"))
        & F.col("a.text").eqNullSafe(F.col("b.text"))
    )
    return left.join(right, same, "left_anti")


def assemble(*parts: DataFrame) -> DataFrame:
    """Message groups one after the other; ``part`` and ``turn`` give the new order."""
    rows = None
    for i, part in enumerate(parts):
        placed = part.withColumn("part", F.lit(i))
        rows = placed if rows is None else rows.unionByName(placed)
    return rows


def word_set_ops(conv: DataFrame, queries: DataFrame) -> DataFrame:
    """Word sets of message and query: shared, either, message only, and the subset test."""
    wanted = queries.select("conv_id", T.word_set(F.col("query")).alias("_q"))
    rows = conv.select("conv_id", "turn", T.word_set(F.col("text")).alias("_w"))
    return rows.join(wanted, "conv_id").select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("_w", "_q")).cast("long").alias("n_shared"),
        F.size(F.array_union("_w", "_q")).cast("long").alias("n_either"),
        F.size(F.array_except("_w", "_q")).cast("long").alias("n_message_only"),
        (F.size(F.array_except("_w", "_q")) == 0).alias("is_subset"),
    )


# --- constraints ------------------------------------------------------------------------------


def pinned_sentences(conv: DataFrame, key_chars: int | None = None) -> DataFrame:
    """Permanent rules said by user or system, where first said; those that agree in their letters
    (or the first ``key_chars``) once."""
    rows = conv.filter(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sent")
    )
    return (
        rows.filter(T.is_permanent(F.col("sent")))
        .groupBy("conv_id", T.sentence_key(F.col("sent"), key_chars).alias("_key"))
        .agg(F.min(F.struct("turn", "sent_no", "sent")).alias("_s"))
        .select("conv_id", "_s.*")
    )


def constraint_block(pinned: DataFrame) -> DataFrame:
    """One ``[CONSTRAINTS]`` text per conversation from its pinned sentences."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "sent_no", "sent")))
    body = F.array_join(F.transform(ordered, lambda s: s["sent"]), " ")
    return pinned.groupBy("conv_id").agg(F.concat(F.lit("[CONSTRAINTS]\n"), body).alias("kv_pinned"))
