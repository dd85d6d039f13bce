"""The full context job: prune, code, summarise and assemble each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators import context as C
from tokenloom.operators.compression import compress_aggressive_column
from tokenloom.operators.relevance import last_user_queries, sentence_filter
from tokenloom.plans.groups import cut_lineage

PROXY = {"keep_last": 4, "summarize_at": 6, "summary_budget": 120}
PROXY_MIN_BUDGET = 300
PROXY_TAIL = 4


def _joined(top: Column, bottom: Column) -> Column:
    """Two blocks on separate lines, or whichever is not empty."""
    return F.array_join(F.filter(F.array(top, bottom), lambda b: b != ""), "\n")


def _compress_middle(pruned: DataFrame, queries: DataFrame, mode: str, prefix: int, tail: int):
    """Mark segments and filter the sentences of the middle by role and age.

    ``pruned`` fits a token budget, so a window per conversation is small.
    """
    whole = Window.partitionBy("conv_id")
    rows = (
        pruned.withColumn("_rank", F.row_number().over(whole.orderBy("turn")))
        .withColumn("_total", F.count(F.lit(1)).over(whole))
        .withColumn("segment", C.segment_column(F.col("_rank"), F.col("_total"), prefix, tail))
    )
    middle_total = F.sum((F.col("segment") == "middle").cast("int")).over(whole)
    age = C.age_column(F.col("_rank") - prefix, F.col("_middle"))
    ratio = F.when(
        (F.col("segment") == "middle") & (F.col("role") != "system"),
        C.keep_ratio_column(F.col("role"), age, mode),
    ).otherwise(1.0)
    rows = rows.withColumn("_middle", middle_total).withColumn("keep_ratio", ratio)
    rows = rows.join(queries.select("conv_id", "query"), "conv_id")
    rows = sentence_filter(rows.withColumn("before", F.col("text")))
    return rows.drop("_rank", "_total", "_middle", "keep_ratio", "query")


def _history_summary(
    after: DataFrame,
    pruned: DataFrame,
    facts: DataFrame,
    summaries: DataFrame,
    summarize_at: int,
    summary_budget: int,
) -> DataFrame:
    """New summaries of the conversations that warrant one."""
    due = facts.filter(
        (F.col("n_messages") >= summarize_at) | (F.col("original_tokens") > F.col("budget"))
    ).select("conv_id")
    lost = C.dropped_messages(after, pruned)
    losing = lost.select("conv_id").distinct()
    fresh = due.join(summaries.filter("summary != ''"), "conv_id", "left_anti")
    intact = after.join(losing, "conv_id", "left_anti").join(fresh, "conv_id", "left_semi")
    source = lost.join(due, "conv_id", "left_semi").unionByName(intact)
    return C.summarize(source, summaries, summary_budget)


def optimize_context(
    conv: DataFrame,
    queries: DataFrame,
    summaries: DataFrame | None = None,
    mode: str = "lossless",
    budget: int = C.BUDGET,
    use_kv: bool = True,
    prefix: int = C.KV_PREFIX,
    tail: int = C.KV_TAIL,
    keep_last: int = C.KEEP_LAST,
    summarize_at: int = C.SUMMARIZE_AT,
    summary_budget: int = C.SUMMARY_BUDGET,
    budgets: DataFrame | None = None,
) -> DataFrame:
    """One optimised prompt per conversation of ``queries`` (conv_id, query).

    Novelty pruning, entity coding and the budget see all messages; from there on a
    conversation holds no more than its budget and its last messages.
    """
    if mode not in C.DECAY:
        raise ValueError('mode must be "lossless" or "aggressive"')
    spark = conv.sparkSession
    conv = conv.select("conv_id", "turn", "role", "text")
    queries = queries.select("conv_id", "query")
    key_type = conv.schema["conv_id"].dataType.simpleString()
    if summaries is None:
        summaries = spark.createDataFrame([], f"conv_id {key_type}, summary string")

    novel = C.mark_novel(conv)
    novel = cut_lineage(novel)
    kept = novel.filter("kept").drop("kept")
    register = C.entity_register(kept)
    after = cut_lineage(C.apply_register(kept, register))

    facts = (
        novel.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n_messages"),
            F.sum(T.token_words(F.col("text"))).alias("_words"),
            F.sum((~F.col("kept")).cast("long")).alias("delta_dropped"),
        )
        .join(queries, "conv_id", "right")
        .withColumn(
            "original_tokens",
            T.tokens_from_words(F.coalesce("_words", F.lit(0)) + T.token_words(F.col("query"))),
        )
        .fillna(0, ["n_messages", "delta_dropped"])
        .drop("_words")
    )
    if budgets is None:
        facts = facts.withColumn("budget", F.lit(budget or C.BUDGET))
    else:
        facts = facts.join(budgets.select("conv_id", "budget"), "conv_id", "left")
    facts = cut_lineage(facts)

    pruned = C.budget_prune(after, queries, budget, keep_last, budgets)
    if use_kv:
        shaped = _compress_middle(pruned, queries, mode, prefix, tail)
    else:
        shaped = pruned.withColumn("before", F.col("text")).withColumn("segment", F.lit("middle"))
    shaped = cut_lineage(shaped)

    blocks = facts.join(C.register_block(register), "conv_id", "left")
    blocks = blocks.join(summaries, "conv_id", "left").fillna("", ["entity_register", "summary"])
    summary = _history_summary(
        after, shaped.select("conv_id", "role", "text"), facts, summaries, summarize_at, summary_budget
    )
    blocks = blocks.join(summary.withColumnRenamed("summary", "_new"), "conv_id", "left")
    blocks = blocks.withColumn("new_summary", F.coalesce("_new", "summary")).drop("_new", "summary")

    if use_kv:
        pins = C.constraint_block(
            C.pinned_sentences(shaped.select("conv_id", "turn", "role", F.col("before").alias("text")))
        )
        in_middle = F.col("segment") == "middle"
        saved = F.sum(
            F.when(in_middle, T.token_count(F.col("before")) - T.token_count(F.col("text")))
        )
        gains = shaped.groupBy("conv_id").agg(saved.alias("_saved"))
        pins = pins.join(gains, "conv_id").filter(
            F.col("_saved") > T.token_count(F.col("kv_pinned"))
        )
        blocks = blocks.join(pins.drop("_saved"), "conv_id", "left").fillna("", ["kv_pinned"])
    else:
        blocks = blocks.withColumn("kv_pinned", F.lit(""))

    middle = shaped.filter(F.col("segment") == "middle")
    phrases = cut_lineage(C.phrase_table(middle))
    coded = C.apply_phrases(middle.select("conv_id", "turn", "text"), phrases)
    table = (
        phrases.groupBy("conv_id")
        .agg(
            F.sum(T.token_words(F.concat_ws("=", "symbol", "phrase"))).alias("_table"),
        )
        .join(coded.groupBy("conv_id").agg(F.sum("saved").alias("huffman_tokens_saved")), "conv_id")
        .filter(F.col("huffman_tokens_saved") > T.tokens_from_words(F.col("_table")))
        .join(C.phrase_block(phrases), "conv_id")
        .drop("_table")
    )
    blocks = blocks.join(table, "conv_id", "left").fillna("", ["symbols"])
    blocks = blocks.fillna(0, ["huffman_tokens_saved"])

    used = coded.join(table.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id", "turn", F.col("text").alias("_coded")
    )
    content = F.coalesce("_coded", "text")
    if mode == "aggressive":
        content = compress_aggressive_column(content)
    final = shaped.join(used, ["conv_id", "turn"], "left").withColumn("content", content)
    messages = final.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_messages")
    )

    out = blocks.join(messages, "conv_id", "left")
    out = out.withColumn(
        "messages",
        F.coalesce(
            F.transform("_messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))),
            F.array().cast("array<struct<role:string,content:string>>"),
        ),
    )
    user = F.col("query")
    if mode == "aggressive":
        user = compress_aggressive_column(user)
    out = out.withColumn("user", user)
    system = _joined(
        _joined(F.col("kv_pinned"), _joined(F.col("new_summary"), F.col("entity_register"))),
        F.col("symbols"),
    )
    out = out.withColumn("system", T.strip(system))
    lines = F.transform("messages", lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    parts = F.array(
        F.when(F.col("system") != "", F.concat(F.lit("[CONTEXT]\n"), F.col("system"))),
        F.when(F.size("messages") > 0, F.concat(F.lit("[CONVERSATION]\n"), F.array_join(lines, "\n"))),
        F.concat(F.lit("[QUERY]\n"), F.col("user")),
    )
    words = F.aggregate(
        "messages", F.lit(0), lambda acc, m: acc + T.token_words(m["content"])
    ) + T.token_words(F.col("user"))
    out = out.withColumn("optimized_tokens", T.tokens_from_words(words))
    return out.select(
        "conv_id",
        F.array_join(parts, "\n\n").alias("optimized_prompt"),
        "system",
        "messages",
        "user",
        "new_summary",
        F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens")).alias(
            "tokens_saved_estimate"
        ),
        "original_tokens",
        "optimized_tokens",
        (F.col("n_messages") - F.size("messages")).alias("messages_pruned"),
        "delta_dropped",
        "huffman_tokens_saved",
        "entity_register",
        "kv_pinned",
    )


def context_stats(optimised: DataFrame, mode: str = "mode", platform: str = "platform") -> DataFrame:
    """Savings of optimised conversations per mode and platform."""
    return optimised.groupBy(mode, platform).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tokens_saved_estimate").alias("tokens_saved"),
        F.sum("messages_pruned").alias("messages_pruned"),
    )


def compress_history(conv: DataFrame) -> DataFrame:
    """What a proxy would send instead: system messages, one context message, last messages.

    The budget is half the history, at least 300 tokens; the last user message is the query.
    """
    conv = conv.select("conv_id", "turn", "role", "text")
    size = conv.groupBy("conv_id").agg(F.sum(T.token_count_proxy(F.col("text"))).alias("_orig"))
    budget = F.greatest(F.lit(PROXY_MIN_BUDGET), F.floor(F.col("_orig") / 2)).cast("long")
    budgets = cut_lineage(size.withColumn("budget", budget))
    queries = cut_lineage(last_user_queries(conv))
    made = optimize_context(conv, queries, budgets=budgets, **PROXY)
    context = made.select("conv_id", F.col("optimized_prompt").alias("text")).join(budgets, "conv_id")
    saved = F.greatest(F.lit(0), F.col("_orig") - T.token_count_proxy(F.col("text")))
    context = context.withColumn("saved", saved.cast("long"))

    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        conv.filter(F.col("role") != "system")
        .withColumn("_nth", F.row_number().over(newest))
        .filter(F.col("_nth") <= PROXY_TAIL)
    )
    columns = ["conv_id", "part", "turn", "role", "text", "saved"]
    nothing = F.lit(None).cast("long")
    parts = [
        conv.filter(F.col("role") == "system").withColumn("part", F.lit(0)).withColumn("saved", nothing),
        context.withColumn("part", F.lit(1)).withColumn("turn", nothing).withColumn("role", F.lit("user")),
        recent.withColumn("part", F.lit(2)).withColumn("saved", nothing),
    ]
    rows = parts[0].select(columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(columns))
    return rows
