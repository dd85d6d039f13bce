import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import context as C
from tokenloom.operators import optimize as O
from tokenloom.operators import relevance as R

WORDS = "alpha beta gamma delta Acme Cloud EU GB 15 42 rate limit must never the ok go".split()


def random_chat(spark, seed, convs=12, turns=14):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            n = rng.choice([1, 2, 6, 15, 30])
            words = [rng.choice(WORDS) + rng.choice(["", "", "", ".", " Corp"]) for _ in range(n)]
            rows.append((c, t, rng.choice(["user", "assistant", "system", "user"]), " ".join(words)))
    rng.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string"
    return spark.createDataFrame(rows, schema).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_layout_boundaries(chat):
    def segments(n):
        rows = C.kv_layout(chat(*[("user", "x")] * n)).orderBy("turn").collect()
        return [r["segment"] for r in rows]

    assert segments(6) == ["prefix"] * 6
    assert segments(7) == ["prefix"] * 2 + ["middle"] + ["tail"] * 4


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_for_long_conversations_agree(spark, seed):
    conv = random_chat(spark, seed)
    pairs = [
        (lambda limit: C.mark_novel(conv, limit).select("conv_id", "turn", "kept")),
        (lambda limit: C.kv_layout(conv, limit=limit)),
        (lambda limit: C.keep_ratio(conv, limit=limit)),
        (lambda limit: C.entity_register(conv, limit=limit)),
        (lambda limit: C.phrase_table(conv, limit=limit)),
    ]
    for form in pairs:
        assert rows_of(form(2)) == rows_of(form(10**6))
    register = C.entity_register(conv)
    assert rows_of(C.apply_register(conv, register, 1)) == rows_of(C.apply_register(conv, register))


def test_symbols_are_protected(chat, spark):
    conv = chat(("user", "15 and 2015 and §E15"))
    register = spark.createDataFrame(
        [(1, i, e) for i, e in [(1, "15"), (2, "2015")]], "conv_id long, rank long, entity string"
    )
    assert C.apply_register(conv, register).first()["text"] == "§E1 and §E2 and §E§E1"


def test_entity_register_decodes_back(spark):
    conv = random_chat(spark, 9)
    register = C.entity_register(conv)
    coded = C.apply_register(conv, register)
    table = register.groupBy("conv_id").agg(
        F.collect_list(F.struct("symbol", F.col("entity").alias("original"))).alias("s")
    )
    from tokenloom.operators.compression import decode_column

    back = coded.join(table, "conv_id", "left").select(
        "conv_id",
        "turn",
        F.when(F.col("s").isNull(), F.col("text"))
        .otherwise(decode_column(F.col("text"), F.col("s")))
        .alias("text"),
    )
    assert rows_of(back) == rows_of(conv.select("conv_id", "turn", "text"))


def test_short_message_fits_after_a_long_one_does_not(chat):
    conv = chat(("user", "one 11 22 33 44 " + "word " * 40), ("user", "short 55"), ("user", "last"))
    kept = C.budget_prune(conv, None, budget=12, keep_last=1)
    assert sorted(r["turn"] for r in kept.collect()) == [1, 2]


def plain_first_fit(messages, budget, keep_last):
    """Brute force over (turn, tokens, score): the expected turns."""
    tail = messages[-keep_last:]
    room = max(0, budget - sum(m[1] for m in tail))
    chosen = {m[0] for m in tail}
    for turn, tokens, _ in sorted(messages[:-keep_last], key=lambda m: (-m[2], m[0])):
        if tokens <= room:
            chosen.add(turn)
            room -= tokens
    return chosen


@pytest.mark.parametrize("budget", [20, 45, 90])
@pytest.mark.parametrize("as_table", [False, True])
def test_budget_against_brute_force(spark, budget, as_table):
    from tokenloom.functions import text as T

    conv = random_chat(spark, budget, convs=8, turns=20)
    queries = R.last_user_queries(conv)
    measured = (
        conv.join(queries, "conv_id")
        .withColumn("tokens", T.token_count(F.col("text")))
        .withColumn("density", T.fact_density(F.col("text")))
        .join(R.jaccard(conv, queries), ["conv_id", "turn"])
        .collect()
    )
    budgets = None
    if as_table:
        budgets = conv.select("conv_id").distinct().withColumn("budget", F.lit(budget))
    got = C.budget_prune(conv, queries, budget, 2, budgets).collect()
    for conv_id in {r["conv_id"] for r in measured}:
        messages = sorted(
            (
                r["turn"],
                r["tokens"],
                r["density"] if r["query"] == "" else 0.5 * r["jaccard"] + 0.5 * r["density"],
            )
            for r in measured
            if r["conv_id"] == conv_id
        )
        found = {r["turn"] for r in got if r["conv_id"] == conv_id}
        assert found == plain_first_fit(messages, budget, 2)


def test_novelty(chat):
    conv = chat(
        ("user", "one two three four five six seven"),
        ("assistant", "one two three eight nine"),
        ("assistant", "use EU now"),
        ("user", "ok EU thanks"),
        ("system", "one two"),
    )
    rows = C.mark_novel(conv).orderBy("turn").collect()
    assert [r["kept"] for r in rows] == [True, False, True, False, True]


def test_phrases_cross_messages_and_match_whole_words(chat):
    conv = chat(("user", "error rate"), ("user", "limit error rate"), ("user", "limit error rate"))
    table = C.phrase_table(conv, min_freq=2).orderBy("rank").collect()
    assert table[0]["phrase"] == "error rate limit" and table[0]["savings"] == 4
    coded = C.apply_phrases(
        chat(("user", "Error rate  limit; error rate limit, error rate limits")),
        C.phrase_table(conv, min_freq=2).filter("rank = 1"),
    ).first()
    assert coded["text"] == "Error rate  limit; §H1, error rate limits"
    assert coded["saved"] == 2


def test_summary_merges_and_falls_back(chat, spark):
    prior = spark.createDataFrame([(1, "old words here  ")], "conv_id long, summary string")
    conv = chat(("user", "hi all. more"), ("assistant", "fine"))
    assert C.summarize(conv).first()["summary"] == "hi all."
    assert C.summarize(conv, prior).first()["summary"] == "old words here hi all."
    long = spark.createDataFrame([(1, "w " * 50)], "conv_id long, summary string")
    merged = C.summarize(conv, long, budget=13).first()["summary"]
    assert merged.split() == ["w"] * 8 + ["hi", "all."]


def test_near_equal_sentences_count_once(chat):
    conv = chat(("user", "I want to build the app now. i want to BUILD the app now!"))
    assert C.summarize(conv).first()["summary"] == "I want to build the app now."
    pins = C.pinned_sentences(chat(("user", "You must go. you MUST go!"), ("assistant", "must")))
    assert [r["sent"] for r in pins.collect()] == ["You must go."]


def test_sentence_filter_keeps_first_pinned_and_best(chat, spark):
    text = "Start here. Blue sky today. You must stop. Red sky later. Green grass."
    df = chat(("assistant", text)).withColumn("query", F.lit("red sky"))
    kept = R.sentence_filter(df.withColumn("keep_ratio", F.lit(0.6))).first()["text"]
    assert kept == "Start here. You must stop. Red sky later."
    same = R.sentence_filter(df.withColumn("keep_ratio", F.lit(1.0))).first()["text"]
    assert same == text


def test_bm25_by_hand(chat, spark):
    from math import log

    queries = spark.createDataFrame([(1, "red red sky")], "conv_id long, query string")
    rows = R.bm25(chat(("user", "red sky. blue sky.")), queries).orderBy("sent_no").collect()
    idf_red, idf_sky = log(1.5 / 1.5 + 1), log(0.5 / 2.5 + 1)
    assert rows[0]["score"] == pytest.approx(2 * idf_red + idf_sky)
    assert rows[1]["score"] == pytest.approx(idf_sky)


def test_optimize_by_hand(chat, spark):
    conv = chat(("user", "We must use EU now"), ("assistant", "EU it is"), ("user", "ok EU"))
    queries = spark.createDataFrame([(1, "which region")], "conv_id long, query string")
    row = O.optimize_context(conv, queries).first()
    assert row["optimized_prompt"] == (
        "[CONVERSATION]\nUSER: We must use EU now\n\n[QUERY]\nwhich region"
    )
    assert row["delta_dropped"] == 2
    assert row["messages_pruned"] == row["delta_dropped"]
    assert row["original_tokens"] == 16


def test_optimize_without_entities_is_verbatim(chat, spark):
    conv = chat(("user", "alpha beta gamma delta epsilon zeta"), ("assistant", "one two three four five six"))
    queries = spark.createDataFrame([(1, "q")], "conv_id long, query string")
    row = O.optimize_context(conv, queries).first()
    assert row["optimized_prompt"] == (
        "[CONVERSATION]\nUSER: alpha beta gamma delta epsilon zeta\n"
        "ASSISTANT: one two three four five six\n\n[QUERY]\nq"
    )
    assert row["tokens_saved_estimate"] == 0 and row["new_summary"] == ""


def test_optimize_empty_conversation(chat, spark):
    conv = chat(("user", "x")).filter("false")
    queries = spark.createDataFrame([(1, "only a query")], "conv_id long, query string")
    row = O.optimize_context(conv, queries).first()
    assert row["optimized_prompt"] == "[QUERY]\nonly a query"
    assert row["messages"] == [] and row["original_tokens"] == 4


def test_optimize_keeps_prefix_and_tail(spark):
    conv = random_chat(spark, 21, convs=6, turns=20)
    queries = R.last_user_queries(conv)
    out = O.optimize_context(conv, queries, budget=60, keep_last=5, summarize_at=4)
    register = C.entity_register(C.delta_prune(conv))
    after = C.apply_register(C.delta_prune(conv), register)
    pruned = C.budget_prune(after, queries, 60, 5).orderBy("turn").collect()
    for row in out.collect():
        expected = [r["text"] for r in pruned if r["conv_id"] == row["conv_id"]]
        got = [m["content"] for m in row["messages"]]
        assert len(got) == len(expected)
        if len(got) <= 6:
            assert got == expected
        else:
            assert got[:2] == expected[:2] and got[-4:] == expected[-4:]


def test_compress_history_order(chat):
    conv = chat(
        ("system", "rules"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")
    )
    rows = O.compress_history(conv).orderBy("part", "turn").collect()
    assert [r["role"] for r in rows] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert rows[1]["text"].endswith("[QUERY]\ne")
    assert [r["text"] for r in rows[2:]] == ["b", "c", "d", "e"]


def test_repeated_phrases_are_coded_when_they_pay(chat, spark):
    phrase = "error rate limit reached in region"
    conv = chat(*[("user", f"Code {i}11 {phrase} and {phrase} and {phrase}") for i in range(1, 15)])
    queries = spark.createDataFrame([(1, "status")], "conv_id long, query string")
    row = O.optimize_context(conv, queries, use_kv=False, keep_last=20).first()
    assert row["huffman_tokens_saved"] > 0
    assert "SYMBOLS: {§H1=" in row["system"] and "§H2" in row["messages"][0]["content"]
    assert row["optimized_tokens"] < row["original_tokens"]
    plain = O.optimize_context(conv.limit(2), queries, use_kv=False).first()
    assert plain["huffman_tokens_saved"] == 0 and "SYMBOLS" not in plain["system"]


def test_symbols_in_texts_with_private_use_characters(spark, chat):
    """Any character may stand in a text: none is taken for a mark."""
    text = "Acme Cloud has 45 GB  and Acme Cloud 45 GB \\E \\Q."
    conv = chat(("user", text), ("user", "Acme Cloud gives 45 GB and 4"))
    register = spark.createDataFrame(
        [(1, 1, "Acme Cloud"), (1, 2, "45 GB"), (1, 3, "1"), (1, 4, "\\E")], "conv_id long, rank int, entity string"
    )
    rows = C.apply_register(conv, register).orderBy("turn").collect()
    assert rows[0]["text"] == "§E1 has §E2  and §E1 §E2 §E4 \\Q."
    assert rows[1]["text"] == "§E1 gives §E2 and 4"


def test_long_conversations_take_the_same_jobs(spark):
    """A chain in which each message shares words with the next, and one of 100,000 messages."""
    n = 100_000
    chain = spark.range(n).selectExpr(
        "1L AS conv_id",
        "id AS turn",
        "'user' AS role",
        "array_join(transform(sequence(id * 3, id * 3 + 5), x -> concat('w', x, 'x')), ' ') AS text",
    )
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = {r["turn"] for r in C.mark_novel(chain).filter("kept").select("turn").collect()}
    assert len(jobs.getJobIdsForGroup("chain")) < 15
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Six new words are news; of the next message three are known, which is too few to tell.
    assert kept == set(range(0, n, 2))


def test_novelty_by_bounds_equals_the_walk(spark):
    """Doubts that reach through whole conversations, random talk, nulls and system messages, against a plain walk."""
    import random

    draw, rows = random.Random(8), []
    for conv in range(4):
        for turn in range((40, 1, 25, 40)[conv]):
            if conv % 2:  # every message holds the words of the one before and of the next
                found = [f"c{conv}w{turn + i}x{k}" for i in range(2) for k in range(3)]
            else:
                found = draw.choices(WORDS, k=draw.randint(0, 9)) + [f"q{draw.randint(0, 40)}" for _ in range(draw.randint(0, 6))]
            role = draw.choice(["user", "assistant", None]) if draw.random() < 0.95 else "system"
            rows.append((conv, turn, role, " ".join(found) if draw.random() < 0.9 else None))
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected, known = {}, {}
    for r in C._novelty_sets(conv).orderBy("conv_id", "turn").collect():
        entities, said, so_far = set(r["_ents"] or ()), set(r["_words"] or ()), known.setdefault(r["conv_id"], set())
        keep = r["role"] == "system" or bool(entities - so_far) or len(said - so_far) > C.MIN_NEW_WORDS
        if keep:
            so_far |= entities | said
        expected[r["conv_id"], r["turn"]] = keep
    assert 0 < sum(expected.values()) < len(expected)
    found = {(r["conv_id"], r["turn"]): r["kept"] for r in C.mark_novel(conv, limit=0).collect()}
    assert found == expected
