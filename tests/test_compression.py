import random
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.rewrite import RuleSet, needed_words
from tokenloom.functions.rules import basic, packs, pro, standard, vocabulary
from tokenloom.operators import compression as C
from tokenloom.operators import routing as R

SETS = {
    "basic": RuleSet(basic.BASIC),
    "aggressive": RuleSet(basic.AGGRESSIVE),
    "simplify": RuleSet(standard.SIMPLIFY, True),
    "symbols": RuleSet(standard.SYMBOLS, True),
    "spanish": RuleSet(standard.SPANISH, True),
    "lean": RuleSet(standard.LEAN, True),
    "telegraphic": RuleSet(standard.TELEGRAPHIC, True),
    "openers": RuleSet(pro.OPENERS),
    "verbose": RuleSet(pro.VERBOSE),
    "requests": RuleSet(pro.REQUESTS),
    "math": RuleSet(pro.MATH),
    "units": RuleSet(pro.UNITS),
    "clauses": RuleSet(pro.RELATIVE_CLAUSES),
    **{f"pack {n}": RuleSet(r) for n, r in packs.PACKS.items()},
    **{f"browser {n}": RuleSet(r, True) for n, r in vocabulary.BROWSER_PACKS.items()},
}

# Glued words, outputs that trigger later rules, and every vocabulary phrase.
TRICKY = [
    "DEBUGI WOULD LIKE YOU TO  12",
    "generanecesito que , y",
    "have. just'actuallywere a ver please y",
    "Toucan you see machine learning? misplease me. defix bug and rewrite tests forget it",
    "no explanation, each and every one; given the context: please do not do it, it is not done",
    "Gradient Descent and gradient descent, cost per Click, cost per click, emergency ROOM",
    "Step-by-step with a an the of the end. It is a test. It has not been. it's not, it's fine",
    "grew from 1.5 million to 3 million, fell from 9 K to 7 K, 30 seconds per run, 5 seconds",
    "You should build it. could you please list x? Please Note that y. Make sure to z. \nPlease Go",
    "Eres un experto en SQL. Actúa como un juez, por favor explica la configuración. Está",
    "the team, which is a large group, called Foo Bar, did win, enabling the merge. éclass classé",
    "in 30 seconds, 5 minutes; 2 hours, 3 days. 4 weeks, 6 months, 7 years, 10 percent, 9 ms",
    "For context: a. As we said before, b. Just a quick note: c. To be clear, d. at this point in time",
    "Earnings before interest, taxes and depreciation plus amortization; price-to-earnings",
]


def phrases():
    blocks = [v for k, v in vars(vocabulary).items() if k.isupper() and isinstance(v, str)]
    for block in blocks:
        for line in filter(None, map(str.strip, block.splitlines())):
            phrase = line.partition(" = ")[0]
            yield phrase.replace("(", "").replace(")", "").replace("|", " ")


@pytest.mark.parametrize("name", SETS)
def test_skipping_rules_changes_nothing(spark, name):
    pieces = [part for text in TRICKY for part in re.split(r"(?<=[.,;])", text)]
    texts = TRICKY + pieces + list(phrases()) + [" and ".join(phrases()), " ".join(r[0] for r in SETS[name].rules)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    rows = df.select(
        SETS[name].apply(text).alias("fast"), SETS[name].apply(text, guarded=False).alias("all")
    ).collect()
    for row in rows:
        assert row["fast"] == row["all"]


def test_needed_words():
    assert needed_words(r"\bmachine learning\b") == [({"learning"}, set()), ({"machine"}, set())]
    assert needed_words(r"\bendpoint(s)?\b") == [(set(), {"endpoint"})]
    assert needed_words(r"please ") == [(set(), {"please"})]
    assert needed_words(r" {2,}") == [(set(), {"  "})]
    assert needed_words(r" +") == [(set(), {""})]
    assert needed_words(r"\b(do|did)\b x?") == [({"do", "did"}, set())]
    assert ({"from"}, set()) in needed_words(r"(?:fell|went\s+down)\s+from\s+x")
    assert needed_words(r"\bx(?!\s+(?:per|each))") == [(set(), {"x"})]
    assert needed_words(r"\b(?:a (b|c) )?done\b") == [(set(), {"done"})]
    assert needed_words(r"\bindemnif(y|ication)\b")[0] == (set(), {"indemnif"})


def test_table_sizes():
    assert len(basic.BASIC) == 27 and len(basic.AGGRESSIVE) == 13
    assert len(standard.SIMPLIFY) == 58 and len(standard.LEAN) == 9
    assert [len(packs.PACKS[n]) for n in packs.PACKS] == [20, 12, 15, 12, 12]


def test_case_decides_the_second_word(one):
    symbols = RuleSet(standard.SYMBOLS, True)
    assert one(symbols.apply, "Gradient Descent / gradient descent") == "GB / GD"


def test_basic(one):
    text = "You are an expert in python. Please summarize it. Do not stop."
    assert one(C.compress_basic_column, text) == "§EXP py.\n§ACT ∑ it.\n§NOT stop."


def test_abbreviate(one):
    text = "Documentation (configuration) AUTHENTICATION information! globalization §important small"
    assert one(C.abbreviate_column, text) == (
        "Docs (cfg) AUTHENTICATION info! globalizn §important small"
    )


def test_strip_requests_capitalises(one):
    text = "could you please list it. please go on. ok"
    assert one(C.strip_requests_column, text) == "List it. Go on. Ok"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a (which is a long remark) b", "a b"),
        ("a (only three words) b", "a (only three words) b"),
        ("a (version 2 of the thing) b", "a (version 2 of the thing) b"),
        ("a (see the docs/page for it) b", "a (see the docs/page for it) b"),
        ("a (use class foo in code) b", "a (use class foo in code) b"),
        # An unsafe bracket is consumed as a whole, together with one opened inside it.
        ("a (x 1 (one two three four) b", "a (x 1 (one two three four) b"),
    ],
)
def test_parentheses(one, text, expected):
    assert one(C.drop_parentheses_column, text) == expected


def compressed(spark, text, tier, lang="en", **options):
    df = spark.createDataFrame([(text, lang)], "text string, lang string")
    return C.compress_text(df, tier, **options).first()["compressed"]


def test_standard_by_language(spark):
    assert compressed(spark, "Please compare python with ruby. It is very good.", "standard") == (
        "§DIFF py with rb.\nis good."
    )
    assert compressed(spark, "explica la base de datos", "standard", "es") == "? la BD"
    assert compressed(spark, "please explain", "standard", "fr") == "please explain"


def test_standard_options(spark):
    out = compressed(spark, "The blood pressure is a concern", "standard", browser_packs=["medical"])
    assert out == "The BP is concern"
    out = compressed(spark, "The sky is a blue roof", "standard", telegraphic=True)
    assert out == "sky is blue roof"


def test_pro_and_developer(spark):
    text = (
        "It should be noted that revenue grew from 2 million to 3 million. "
        "The churn of the customer lifetime value (which nobody ever looked at) is known."
    )
    pro_text = compressed(spark, text, "pro")
    assert pro_text.startswith("Note: revenue 2M→3M.\nThe churn of the LTV (which")
    assert "(which" not in compressed(spark, text, "developer")


def test_unknown_tier(spark):
    with pytest.raises(ValueError):
        C.compress_text(spark.createDataFrame([("a", "en")], "text string, lang string"), "ultra")


def test_custom_rules_are_literal(spark):
    df = spark.createDataFrame([("a.b axb A.B $x cost",)], "text string")
    rules = spark.createDataFrame(
        [(0, "a.b", "$1"), (1, "cost", "c\\d")], "pos long, pattern string, replacement string"
    )
    assert C.apply_rules(df, rules).first()["compressed"] == "$1 axb $1 $x c\\d"
    assert [r["hits"] for r in C.rule_hits(df, rules).orderBy("rule").collect()] == [2, 1]


def test_equal_rules_are_counted_each(spark):
    df = spark.createDataFrame([("the end of the day",), ("no",)], "text string")
    rules = spark.createDataFrame(
        [(3, "the", "x"), (7, "the", "y"), (9, "day", "")], "pos long, pattern string, replacement string"
    )
    rows = [tuple(r) for r in C.rule_hits(df, rules).orderBy("rule").collect()]
    assert rows == [(3, 2, 1), (7, 2, 1), (9, 1, 1)]


FRAGMENTS = re.compile(r"[A-Za-z\u00c0-\u024f§µ0-9]+|[^\sA-Za-z0-9]")


@pytest.mark.parametrize("name", sorted(SETS))
def test_glued_words_meet_every_rule(spark, name):
    """Random texts of rule fragments, words often glued: skipping rules changes nothing."""
    chance = random.Random(name)
    rules = SETS[name]
    words = [w for p, r in rules.rules for w in FRAGMENTS.findall(re.sub(r"\\.|\(\?[^)]*\)", " ", p)) + [r] if w]
    words += ["a", "it", "12", "é", ",", ".", "x"]
    texts = []
    for _ in range(1000):
        parts = []
        for _ in range(chance.randint(1, 7)):
            word = chance.choice(words)
            # Four letters beyond ASCII match ASCII ones where case is told by Unicode.
            folded = word.replace(*chance.choice([("s", "ſ"), ("i", "ı"), ("i", "İ"), ("k", "\u212a")]))
            word = chance.choice([word, word, word.upper(), word.capitalize(), folded])
            parts += [word, chance.choice(["", "", " ", " ", "  ", "'", ", "])]
        texts.append(("".join(parts),))
        pattern = chance.choice(rules.rules)[0]
        plain = re.sub(r"\\[bB]|\(\?[a-zA-Z:-]+|[()?|*+\[\]^$]", "", pattern).replace("\\s", " ")
        texts.append((chance.choice(words) + plain + chance.choice(["", " "]) + chance.choice(words),))
    df = spark.createDataFrame(texts, "text string").repartition(4)
    both = df.select(
        "text", rules.apply(F.col("text")).alias("fast"), rules.apply(F.col("text"), guarded=False).alias("slow")
    )
    assert both.filter("fast <> slow").limit(5).collect() == []


def test_decode_reverses_symbols(spark):
    df = spark.createDataFrame([("§E1 and §E12",)], "text string")
    table = F.from_json(
        F.lit('[{"symbol":"§E1","original":"x"},{"symbol":"§E12","original":"y"}]'),
        "array<struct<symbol:string,original:string>>",
    )
    assert df.select(C.decode_column(F.col("text"), table).alias("t")).first()["t"] == "x and y"


def test_language(one):
    assert one(R.detect_language_column, "el perro y la casa de un amigo") == "es"
    assert one(R.detect_language_column, "hello there my friend") == "en"
    assert one(R.detect_language_browser_column, "der Hund und die Katze") == "de"
    assert one(R.detect_language_browser_column, "für für für") == "en"
    # The accent ends a browser word, so these read as the French "est".
    assert one(R.detect_language_browser_column, "está está") == "fr"


def test_domain_and_topic(one):
    assert one(R.detect_domain_column, "revenue and churn") == "finance"
    assert one(R.detect_domain_column, "only revenue here") is None
    assert one(R.topic_column, "What does it COST?") == "pricing"
    assert one(R.topic_column, "zzz") == "other"


def test_joined_rules_equal_listed_rules(spark):
    """Long rule tables: chains of rules, words that grow together, marks, cases, letters beyond ASCII."""
    import random

    chance = random.Random(12)
    words = ["foo", "bar", "baz", "kiss", "sink", "é", "État", "ÉTAT", "ſink", "\u212aiss", "straße", "STRASSE", "a_b", "x1", "日本", "->", "c++", "$5", "a.b"]
    rows = []
    for pos in range(150):
        pattern = chance.choice(["", " ", "-"]).join(chance.choices(words, k=chance.randint(1, 2)))
        pattern = chance.choice([pattern, pattern, pattern + chance.choice("-+."), chance.choice("-(") + pattern])
        put = chance.choice(["", "X", "$1", "\\", chance.choice(words), chance.choice(words) + " " + chance.choice(words), None])
        rows.append((pos, pattern, put))
    rules = spark.createDataFrame(rows, "pos long, pattern string, replacement string")
    texts = ["", None, "foo-bar", "foofoo", "x" * 50_000 + " foo " + "bar " * 5_000]
    for _ in range(400):
        parts = [chance.choice([w, w.upper(), w.lower()]) for w in chance.choices(words, k=chance.randint(1, 9))]
        texts.append("".join(p + chance.choice([" ", " ", "-", "", ", "]) for p in parts))
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, rules string").repartition(4)
    listed = C.apply_rules(df, rules, most=1000)
    joined = C.apply_rules(df, rules, most=0)
    assert joined.columns == listed.columns
    key = lambda r: (r["text"] or "", r["compressed"] or "")
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, listed.collect()), key=str)
    assert sum(key(r)[0] != key(r)[1] for r in listed.collect()) > 100
    hits = [sorted(map(tuple, C.rule_hits(df, rules, most=m).collect())) for m in (0, 1000)]
    assert hits[0] == hits[1] and sum(h[1] for h in hits[0]) > 100
    assert C.apply_rules(df.limit(0), rules, most=0).count() == 0
    assert C.apply_rules(df, rules.limit(0), most=-1).filter("NOT text <=> compressed").count() == 0


def test_a_hundred_thousand_rules(spark):
    n = 100_000
    rules = spark.range(n).selectExpr("id AS pos", "concat('common word', id) AS pattern", "concat('w', id) AS replacement")
    df = spark.range(300).selectExpr("id", "concat('A common word', id * 7, ' and Common Word', id, '; common word') AS text")
    got = {r["id"]: r["compressed"] for r in C.apply_rules(df, rules).collect()}
    assert got == {i: f"A w{i * 7} and w{i}; common word" for i in range(300)}
    hits = C.rule_hits(df, rules).filter("hits > 0").agg(F.sum("hits"), F.count("rule")).first()
    assert tuple(hits) == (600, len({i * k for i in range(300) for k in (1, 7)}))


def test_compress_detects_the_language(spark):
    spanish = "Es necesario que los datos de la empresa se guarden en el sistema para que no se pierdan."
    rows = [(1, "Please explain in detail how the database and the cache work with each other.", None), (2, spanish, "auto"), (3, spanish, "en"), (4, "数据库 cache 数据", "zh"), (5, "", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r["id"]: r for r in C.compress_detected(df, lang="lang").collect()}
    assert {i: r["lang"] for i, r in got.items()} == {1: "en", 2: "es", 3: "en", 4: "zh", 5: "en"}
    # Five ideographs and a word.
    assert got[4]["original_tokens"] == 6 and got[5]["cr"] == 0.0
    for r in got.values():
        assert r["token_savings"] == r["original_tokens"] - r["compressed_tokens"]
    given = {r["id"]: r["compressed"] for r in C.compress(df.filter("id = 1").withColumn("lang", F.lit("en"))).collect()}
    assert got[1]["compressed"] == given[1]
    anew = {r["id"]: r["lang"] for r in C.compress_detected(df.drop("lang"), "pro").collect()}
    assert anew[2] == anew[3] == "es"


def test_telegraphic_patterns_are_constants(spark):
    """A pattern taken from an array of rules is compiled for every row; these are not."""
    texts = ["Currently there is the plan, which was a plan so that it was noted that we simply wait.", "this a b", "", None]
    texts += ["THE end is the  end in order to just see", "xis the yhas an z", "the the a an the x", "ſo that baſically"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = df.select(C.telegraphic_column(F.col("text")).alias("a"))
    assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
    both = df.select(
        C.telegraphic_column(F.col("text")).alias("a"),
        RuleSet(standard.TELEGRAPHIC, ascii=True).apply(F.col("text")).alias("b"),
    )
    assert all(r["a"] == r["b"] for r in both.collect())


def test_tiers_are_compared_from_one_pro_tier(spark, monkeypatch):
    """The developer tier goes on from the pro tier; each tier is as it is for itself."""
    texts = [
        ("en", "You are an expert. Please explain in order to help (which is a rather long remark here) the patient 20 percent."),
        ("en", "The database function is very slow and the server returns json. I want you to fix the bug."),
        ("es", "Por favor explica el resultado."),
        ("de", "Bitte  erklären. "),
        (None, "as is"),
        ("en", None),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, lang string, text string")
    calls, requests = [], C.strip_requests_column
    monkeypatch.setattr(C, "strip_requests_column", lambda text: calls.append(text) or requests(text))
    compared = C.compare_tiers(df)
    assert len(calls) == 1
    found = {(r["id"], r["tier"]): r for r in compared.collect()}
    assert len(found) == 18
    for tier in C.TIERS:
        for row in C.compress(df, tier).collect():
            assert found[row["id"], tier].asDict() == row.asDict() | {"tier": tier}
