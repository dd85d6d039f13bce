"""A user's own rules as a table: literal whole-word substitutions, any number of them.

Rules (``pos, pattern, replacement``) apply in the order of ``pos``, in any case of the letters, each to
what the ones before left. No rule is tried on a text that cannot match it: every rule is filed under its
rarest word, the texts' distinct words are looked up, and only the rules found are tried. All of that is
joins, so the rules are neither collected nor multiplied with the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.columns import let
from tokenloom.functions.rewrite import BORDER, NO_WORD_AFTER, NO_WORD_BEFORE
from tokenloom.plans.groups import cut_lineage

# Letters beyond ASCII that match an ASCII letter where case is told by Unicode.
FOLDING = "ſıİ\u212a"
# Keys that are no words: of every text, and of those with a letter of ``FOLDING``.
ALL, FOLDED = "\x00", "\x01"
UPPER = "".join(map(chr, range(65, 91)))


def ascii_words(text: Column) -> Column:
    """The distinct runs of ASCII letters, digits and underscores, A-Z in lower case."""
    low = F.translate(text, UPPER, UPPER.lower())
    return F.array_distinct(F.filter(F.split(low, r"[^a-z0-9_]+"), lambda w: w != ""))


def other_letters(text: Column) -> Column:
    """The distinct characters beyond ASCII, in their cases."""
    rest = F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), "")
    both = F.concat(F.transform(rest, F.lower), F.transform(rest, lambda c: F.lower(F.upper(c))))
    return F.array_distinct(F.filter(both, lambda c: c != ""))


def has_folding(text: Column) -> Column:
    return text.rlike(f"[{FOLDING}]")


def text_keys(text: Column) -> Column:
    """What a text's rules may be filed under."""
    folded = F.when(has_folding(text), F.array(F.lit(FOLDED))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(ALL)), folded, ascii_words(text), other_letters(text))


def rule_index(rules: DataFrame) -> DataFrame:
    """``rules`` (pos, pattern, replacement) filed: key, pos, regex, put, risky. Several keys a rule are possible.

    A rule is risky if its change can make words that the text did not have: its replacement has another,
    later rule's key, or it begins or ends inside what borders on a word, so that words can grow together.
    """
    pattern, replacement = F.col("pattern"), F.coalesce("replacement", F.lit(""))
    literal = F.regexp_replace(pattern, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    wide = pattern.rlike(r"[^\x00-\x7F]")
    flags = F.when(wide, "(?iu)").otherwise("(?i)")
    spec = rules.filter(pattern.isNotNull()).select(
        F.col("pos").cast("long").alias("pos"),
        F.concat(
            flags,
            F.when(pattern.rlike("^[A-Za-z]"), NO_WORD_BEFORE).otherwise(BORDER),
            literal,
            F.when(pattern.rlike(r"[A-Za-z]\z"), NO_WORD_AFTER).otherwise(BORDER),
        ).alias("regex"),
        F.regexp_replace(replacement, r"([\\$])", r"\\$1").alias("put"),
        ascii_words(pattern).alias("words"),
        other_letters(pattern).alias("others"),
        wide.alias("wide"),
        has_folding(pattern).alias("folding"),
        text_keys(replacement).alias("made"),
        pattern.rlike(r"(?s)^\w(.*\w)?\z").alias("whole"),
    )
    spec = cut_lineage(spec)
    words = spec.select("pos", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # The word that the fewest rules have, of those the longest.
    rank = F.struct("n", (-F.length("word")).alias("size"), "word")
    rarest = words.join(counts, "word").groupBy("pos").agg(F.min(rank)["word"].alias("word"))

    none = F.array().cast("array<string>")
    by_word = F.concat(F.array("word"), F.when(F.col("wide"), F.array(F.lit(FOLDED))).otherwise(none))
    first = F.slice("others", 1, 1)
    # Letters that match ASCII ones are no keys, since texts are not filed under single ASCII letters.
    by_letter = F.when((F.size("others") > 0) & ~F.col("folding"), first).otherwise(F.array(F.lit(ALL)))
    keyed = spec.join(rarest, "pos", "left").withColumn(
        "keys", F.when(F.col("word").isNotNull() & ~F.col("folding"), by_word).otherwise(F.when(F.col("word").isNull(), by_letter).otherwise(F.array(F.lit(ALL))))
    )
    filed = keyed.select("pos", F.explode("keys").alias("key"))
    last = filed.groupBy("key").agg(F.max("pos").alias("last"))
    feeding = spec.select("pos", F.explode("made").alias("key")).filter(F.col("key") != ALL).join(last, "key")
    feeding = feeding.filter(F.col("last") > F.col("pos")).select("pos").distinct().withColumn("feeds", F.lit(True))
    whole = spec.join(feeding, "pos", "left").select(
        "pos", "regex", "put", (F.coalesce("feeds", F.lit(False)) | ~F.col("whole")).alias("risky")
    )
    return cut_lineage(filed.join(whole, "pos"))


def found_rules(texts: DataFrame, index: DataFrame, text: str, *carried: str) -> DataFrame:
    """Per row of ``texts`` (_row) with any, the rules that may match its text, in order: _row, rules."""
    keys = texts.select("_row", *carried, F.explode(text_keys(F.col(text))).alias("key"))
    rows = keys.join(index, "key")
    if carried:
        rows = rows.filter(F.col("pos") > F.col("after"))
    each = rows.select("_row", F.struct("pos", "regex", "put", "risky").alias("rule")).distinct()
    return each.groupBy("_row").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def apply_many(df: DataFrame, rules: DataFrame, text: str = "text", out: str = "compressed") -> DataFrame:
    """Add ``out``: ``text`` after all rules, in order.

    A row tries the rules found for it up to the first risky one that changed it, and looks up the rest anew with
    the words it has then. Rows go round as often as that happens to one of them. A null text stays null;
    rules without a pattern are left out, a null replacement is empty; rows are rows of their own.
    """
    index = rule_index(rules)
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    open_ = rows.select("_row", F.col(text).alias("_text"), F.lit(-(2**63)).cast("long").alias("after"))
    done = []
    while True:
        found = open_.join(found_rules(open_, index, "_text", "after"), "_row", "left")

        def step(state: Column, rule: Column) -> Column:
            def advance(new: Column) -> Column:
                stop = rule["risky"] & (new != state["text"])
                return F.struct(new.alias("text"), F.when(stop, rule["pos"]).alias("stop"))

            changed = F.regexp_replace(state["text"], rule["regex"], rule["put"])
            return F.when(state["stop"].isNotNull(), state).otherwise(let(changed, advance))

        start = F.struct(F.col("_text").alias("text"), F.lit(None).cast("long").alias("stop"))
        tried = F.when(F.col("rules").isNotNull(), F.aggregate("rules", start, step)).otherwise(start)
        tried = cut_lineage(found.select("_row", tried.alias("_s")))
        done.append(tried.filter("_s.stop IS NULL").select("_row", F.col("_s.text").alias(out)))
        open_ = tried.filter("_s.stop IS NOT NULL").select(
            "_row", F.col("_s.text").alias("_text"), F.col("_s.stop").alias("after")
        )
        if open_.isEmpty():
            break
    made = done[0]
    for more in done[1:]:
        made = made.unionByName(more)
    return rows.join(made, "_row").drop("_row")


def count_hits(df: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Matches of every rule in the texts as they are: rule (its pos), hits, texts with a hit."""
    rows = cut_lineage(df.select(F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))
    found = rows.join(found_rules(rows, rule_index(rules), "_text"), "_row")

    def counted(t: Column) -> Column:
        return F.transform("rules", lambda r: F.struct(r["pos"].alias("rule"), F.regexp_count(t, r["regex"]).alias("n")))

    hits = found.select(F.inline(counted(F.col("_text")))).filter("n > 0")
    totals = hits.groupBy("rule").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("texts"))
    every = rules.select(F.col("pos").cast("long").alias("rule"))
    return every.join(totals, "rule", "left").select(
        "rule",
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("texts"),
    )
