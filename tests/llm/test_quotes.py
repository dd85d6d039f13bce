from tokenloom.llm.quotes import link_replies

SCHEMA = "conv_id long, turn long, role string, text string, depth string, up string, digest string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    made = link_replies(df)
    return {(r["conv_id"], r["turn"]): r for r in made.collect()}, made


def test_nested_quotes_and_order(spark):
    rows = [
        (1, 0, "user", "How do I\nsort a list?"),
        (1, 1, "user", "Something  else"),
        (1, 2, "assistant", "On Monday user wrote:\n> How do I\n> sort  a LIST?\n\nCall sort."),
        (1, 3, "user", "a b wrote:\n> Call sort.\n>> how do i sort a list?\nThanks, and then?\n> Call sort.\nmore"),
        (1, 4, "user", "> Something else\n>\nOn that."),
        (1, 5, "user", "> no such text\nnew"),
        (1, 6, "user", "He wrote:\nno quote follows"),
        (2, 0, "user", "> Call sort.\nother conversation"),
    ]
    got, _ = run(spark, rows)
    facts = {k: (r["text"], r["parent_turn"], r["root_turn"], r["depth"], r["position"]) for k, r in got.items()}
    assert facts == {
        (1, 0): ("How do I\nsort a list?", None, 0, 0, 1),
        (1, 2): ("Call sort.", 0, 0, 1, 2),
        (1, 3): ("Thanks, and then?\nmore", 2, 0, 2, 3),
        (1, 1): ("Something  else", None, 1, 0, 4),
        (1, 4): ("On that.", 1, 1, 1, 5),
        (1, 5): ("new", None, 5, 0, 6),
        (1, 6): ("He wrote:\nno quote follows", None, 6, 0, 7),
        (2, 0): ("other conversation", None, 0, 0, 1),
    }


def test_the_first_to_say_it_is_answered(spark):
    rows = [(1, t, "user", "yes") for t in range(4)] + [(1, 4, "user", "> yes\nwhy"), (1, 5, "user", ">yes")]
    got, _ = run(spark, rows)
    assert got[1, 4]["parent_turn"] == 0 and got[1, 5]["parent_turn"] == 0 and got[1, 5]["text"] == ""


def test_parts_of_a_message_are_found(spark):
    rows = [
        (1, 0, "user", "First line of it,\nsecond line.\n\nA second paragraph\nof two lines."),
        (1, 1, "user", "Unrelated"),
        (1, 2, "user", "> First line of it,\nyes\n> second line.\nno"),  # answers between the lines
        (1, 3, "user", "> A  second paragraph\n> OF two lines.\nTrue."),  # one paragraph
        (1, 4, "user", "> second line.\n> [...]\n> of two lines.\nSo what?"),  # trimmed
        (1, 5, "user", "> > First line of it,\n> yes\n> > second line.\n> no\nWhy not?"),  # an answer between lines, quoted
        (1, 6, "user", "> nothing\n> known\nnew"),
        (2, 0, "user", "> second line.\nanother conversation"),
    ]
    got, _ = run(spark, rows)
    assert {k: r["parent_turn"] for k, r in got.items()} == {
        (1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 0, (1, 4): 0, (1, 5): 2, (1, 6): None, (2, 0): None,
    }
    assert got[1, 2]["text"] == "yes\nno" and got[1, 5]["depth"] == 2


def test_a_whole_text_goes_before_its_lines(spark):
    rows = [(1, 0, "user", "yes\nbut"), (1, 1, "user", "yes"), (1, 2, "user", "> yes\nwhy")]
    got, _ = run(spark, rows)
    assert got[1, 2]["parent_turn"] == 1


def test_long_chain(spark):
    rows = [(1, 0, "user", "m0")] + [(1, t, "user", f"> m{t - 1}\nm{t}") for t in range(1, 70)]
    got, _ = run(spark, rows)
    assert [got[1, t]["depth"] for t in range(70)] == list(range(70))
    assert {r["root_turn"] for r in got.values()} == {0}


def test_nulls_repeats_and_none(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, 2, "user", "> \n"), (1, 3, "b", "x"), (1, 3, "a", "x"), (None, 0, "u", "x"), (1, None, "u", "> x\ny")]
    _, made = run(spark, rows)
    listed = sorted(((r["conv_id"], r["turn"], r["role"], r["text"], r["position"]) for r in made.collect()), key=str)
    assert listed == sorted(
        [(1, 0, None, "", 1), (1, 1, "user", "", 2), (1, 2, "user", "", 3), (1, 3, "a", "x", 4), (None, 0, "u", "x", None), (1, None, "u", "> x\ny", None)],
        key=str,
    )
    assert run(spark, [])[0] == {}


def test_only_native_operators(spark):
    _, made = run(spark, [(1, 0, "user", "x")])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
