"""Quotation linking: conversations in reply order, without quotes. DataFrame operations only.

Each message's lines get the number of quote marks in front of them. Runs of lines of one level are
passages. A message's own text is its lines of level 0, without the line that introduces a quote.
Quoted passages and own texts are normalised (lower case, one space for white space) and hashed; the
hash joins a passage to the message of the conversation that said it first. The earlier message of
the shallowest linked passage is the one replied to.

A passage may be a part of what was said: of passages that are no whole own text, the paragraphs and
then the lines are joined to those of own texts in the same way. A whole text goes before paragraphs,
these before lines, within a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.plans.groups import cut_lineage, numbered

MARKS = r"^((?:[ \t]{0,3}>)+)[ ]?"
INTRODUCES = r"(?i)^\s*(on\s.{1,300}|.{1,80})\swrote:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of lines of one quote level: the keys, nth, level, text (lines without their marks)."""
    lines = messages.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.select(
        *keys,
        "at",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        F.regexp_replace("line", MARKS, "").alias("line"),
    )
    along = Window.partitionBy(*keys).orderBy("at")
    introduces = (F.col("level") < F.lead("level").over(along)) & F.col("line").rlike(INTRODUCES)
    lines = lines.withColumn("introduces", F.coalesce(introduces, F.lit(False)))
    begins = (F.col("level") != F.lag("level", 1, -1).over(along)).cast("int")
    lines = lines.withColumn("begins", begins)
    lines = lines.withColumn("nth", F.sum("begins").over(along)).filter(~F.col("introduces"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    runs = lines.groupBy(*keys, "nth", "level").agg(ordered.alias("lines"))
    return runs.select(*keys, "nth", "level", F.concat_ws("\n", F.transform("lines", lambda x: x["line"])).alias("text"))


def units(texts: DataFrame, keys: list[str]) -> DataFrame:
    """What of each ``text`` can be quoted: the keys, kind (0 the whole, 1 a paragraph, 2 a line), at
    (its place) and digest."""
    whole = F.array(F.col("text"))
    paragraphs, lines = F.split("text", r"\r?\n[ \t]*\r?\n"), F.split("text", r"\r?\n")
    each = lambda kind, found: F.transform(
        found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), normalised(x).alias("plain"))
    )
    made = texts.filter("text IS NOT NULL").select(
        *keys, F.explode(F.concat(each(0, whole), each(1, paragraphs), each(2, lines))).alias("u")
    )
    return made.filter("u.plain <> ''").select(*keys, "u.kind", "u.at", F.sha2("u.plain", 256).alias("digest"))


def link_replies(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations of ``messages`` (conv_id, turn, role, text).

    One row per message: conv_id, turn, role, text (its own, trimmed), parent_turn (the message
    replied to, null for none), root_turn, depth (replies from the root), position (from 1: by root,
    depth, turn). A null or empty text is a message without own text, which nothing is linked to.
    Only earlier turns of the same conversation are linked. Of rows with the same conv_id and turn
    one stays, the least by role and text; rows with a null conv_id or turn stay each, unlinked, at
    position null. Other columns are not read; an empty table gives no row.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    placed = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    one = F.min(F.struct(F.col("role").alias("role"), F.col("text").alias("text"))).alias("m")
    placed = placed.groupBy("conv_id", "turn").agg(one).select("conv_id", "turn", "m.role", "m.text")
    keys = ["conv_id", "turn"]
    parts = passages(placed, keys)
    own = parts.filter("level = 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("own"))
    own = own.select(*keys, F.trim(F.concat_ws("\n", F.transform("own", lambda p: p["text"])), F.lit(" \n\t\r")).alias("own"))
    said = cut_lineage(placed.select(*keys, "role").join(own, keys, "left"))

    originals = units(said.select(*keys, F.col("own").alias("text")), ["conv_id", "turn"])
    originals = originals.groupBy("conv_id", "kind", "digest").agg(F.min("turn").alias("said_turn"))
    quoted = units(parts.filter("level > 0"), [*keys, "level", "nth"])
    linked = quoted.join(originals, ["conv_id", "kind", "digest"]).filter("said_turn < turn")
    # The shallowest passage counts; of several, the one most wholly found, then the first in the text.
    first = F.min(F.struct("level", "kind", "nth", "at", "said_turn"))["said_turn"]
    parents = linked.groupBy(*keys).agg(first.alias("parent_turn"))
    tree = said.join(parents, keys, "left")

    up = tree.select(
        *keys, F.col("parent_turn").alias("up"), F.col("parent_turn").isNotNull().cast("long").alias("steps")
    )
    up = cut_lineage(up.select(*keys, F.coalesce("up", "turn").alias("up"), "steps"))
    # Each round doubles the steps that a message has been followed upwards.
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"), F.col("steps").alias("more"))
        up = cut_lineage(
            up.join(above, ["conv_id", "up"]).select(*keys, F.col("higher").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "more")
        )
        if up.filter("more > 0").isEmpty():
            break
        up = up.drop("more")
    roots = up.select(*keys, F.col("up").alias("root_turn"), F.col("steps").alias("depth"))
    done = tree.join(roots, keys).select(
        *keys, "role", F.coalesce("own", F.lit("")).alias("text"), "parent_turn", "root_turn", "depth"
    )
    done = numbered(done, ["conv_id"], ["root_turn", "depth", "turn"], "position")
    loose = rows.filter("conv_id IS NULL OR turn IS NULL").select(
        *keys, "role", F.coalesce("text", F.lit("")).alias("text"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("parent_turn", done.schema["parent_turn"].dataType), ("root_turn", done.schema["root_turn"].dataType), ("depth", "long"), ("position", "long"))],
    )
    return done.unionByName(loose)


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: each turn quotes the one before it, which quotes the one before that."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    marked = lambda c, marks: F.regexp_replace(c, "(?m)^", marks)
    first, second = F.lag("text", 1).over(along), F.lag("text", 2).over(along)
    rows = conversations.select("conv_id", "turn", "role", "text", first.alias("q1"), second.alias("q2"), F.lag("role").over(along).alias("by"))
    head = F.concat(F.lit("On an earlier day "), F.coalesce("by", F.lit("someone")), F.lit(" wrote:"))
    quoted = F.concat_ws("\n", head, marked(F.col("q1"), "> "), marked(F.col("q2"), ">> "), F.lit(""), "text")
    return rows.select("conv_id", "turn", "role", F.when(F.col("q1").isNull(), F.col("text")).otherwise(quoted).alias("text"))
