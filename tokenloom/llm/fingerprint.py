"""Order MinHash fingerprints, in DataFrame operations only.

A text is cut into tokens of at most eight characters without white space; its k-mers are runs of
``K`` tokens, each numbered by its occurrence in the text. The hashes of numbered k-mers are dealt
out over ``2 * TUPLES`` strata. Tuple i takes the minimal k-mer of the two strata that follow 2i
(the next ones that hold any), keeps the two in text order and hashes them. A fingerprint is the
list of tuple hashes; the likeness of two is the share of equal ones. Moving, inserting or replacing
text changes k-mers, their numbers or their order, so the likeness falls with edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
TUPLES = 32
STRATA = 2 * TUPLES
# A k-mer's value in a stratum: its hash in the upper bits, its place in the text in the lower.
PLACE_BITS = 24


def next_texts(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Add to each row (doc_id, text) the text of the row after it by ascending doc_id; the last has
    the first's. Rows with the same doc_id are ordered by their text's hash; null ids come first.

    Rows are dealt into blocks along doc_id, by quantiles of the ids. The first rows of a block also
    go to the block before as its end, so that no row needs another block.
    """
    spark = docs.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.stat.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.001)
    cuts = sorted({int(c) for c in cuts})
    block = F.lit(0)
    if cuts:
        listed = F.array(*[F.lit(c).cast("long") for c in cuts])
        block = F.coalesce(F.size(F.filter(listed, lambda c: c <= F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("block", block)
    starts = rows.select("doc_id", "block").groupBy("block").agg(
        F.min("doc_id").alias("first"), F.count(F.col("doc_id")).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    firsts = {r["block"]: None if r["n"] < r["rows"] else r["first"] for r in starts.collect()}
    if not firsts:
        return rows.withColumns({"tail": F.lit(False), "next_text": F.lit("")}).drop("block").limit(0)
    filled = sorted(firsts)
    # The block in front of each block; the first block's first rows end the last block.
    ahead = {b: filled[i - 1] for i, b in enumerate(filled)}
    every = range(len(cuts) + 1)
    first = F.get(F.array(*[F.lit(firsts.get(b)).cast("long") for b in every]), F.col("block"))
    before = F.get(F.array(*[F.lit(ahead.get(b)).cast("int") for b in every]), F.col("block"))
    is_first = F.col("doc_id").eqNullSafe(first)
    here = F.struct(F.col("block").alias("block"), F.lit(False).alias("tail"))
    there = F.struct(before.alias("block"), F.lit(True).alias("tail"))
    homes = F.when(is_first, F.array(here, there)).otherwise(F.array(here))
    placed = rows.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.*")
    along = Window.partitionBy("block").orderBy("tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return placed.repartition(F.col("block")).withColumns(
        {"nth": F.row_number().over(along), "next_text": F.lead("text").over(along)}
    )


def numbered_minima(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Per text (``keys``, text): the least k-mer of each stratum, as ``entries`` in stratum order.

    ``texts`` is dealt by a part of the keys, so none of the steps shuffles.
    """
    tokens = F.regexp_extract_all("text", F.lit(r"(\S{1,8})"), F.lit(1))
    listed = texts.select(*keys, tokens.alias("t"))
    kmers = F.when(
        F.size("t") > K, F.transform("t", lambda x, i: F.xxhash64(x, *[F.get("t", i + j) for j in range(1, K)]))
    ).otherwise(F.array(F.xxhash64("t")))
    each = listed.select(*keys, F.size("t").alias("n"), F.posexplode(kmers).alias("place", "kmer"))
    # The last K - 1 starts have no whole k-mer.
    each = each.filter((F.col("n") <= K) | (F.col("place") <= F.col("n") - K))
    along = Window.partitionBy(*keys, "kmer").orderBy("place")
    hashed = F.xxhash64("kmer", F.row_number().over(along))
    each = each.select(*keys, "place", hashed.alias("h"))
    value = F.shiftleft(F.shiftrightunsigned("h", PLACE_BITS + 8), PLACE_BITS).bitwiseOR(
        F.col("place").bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("long")
    )
    least = each.select(*keys, F.pmod("h", F.lit(STRATA)).cast("int").alias("stratum"), value.alias("v"))
    least = least.groupBy(*keys, "stratum").agg(F.min("v").alias("v"))
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stratum", "v"))).alias("entries"))


def tuple_hashes(entries: Column) -> Column:
    """The fingerprint: ``TUPLES`` hashes of two k-mers each, in text order, as hex."""

    def one(i: Column) -> Column:
        skipped = F.size(F.filter(entries, lambda e: e["stratum"] < 2 * i))
        pair = F.slice(F.concat(entries, entries), skipped + 1, F.least(F.lit(2), F.size(entries)))
        low = F.lit(2**PLACE_BITS - 1).cast("long")
        place = lambda e: e["v"].bitwiseAND(low).alias("p")
        kmer = lambda e: F.shiftrightunsigned(e["v"], PLACE_BITS).alias("h")
        ordered = F.array_sort(F.transform(pair, lambda e: F.struct(place(e), kmer(e))))
        return F.substring(F.hex(F.xxhash64(F.transform(ordered, lambda e: e["h"]))), -8, 8)

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda i: F.lpad(one(i), 8, "0")))


def likeness(x: str, y: str) -> Column:
    """Share of equal tuples of two fingerprints."""
    return F.expr(
        f"size(filter(sequence(0, {TUPLES - 1}), i -> substr({x}, 8 * i + 1, 8) = substr({y}, 8 * i + 1, 8))) / {TUPLES}D"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter (rounded down, in code points) replaced by the
    first as many code points of the next document's text, or all of it. Null texts are empty; texts
    without any token share one fingerprint; equal texts have equal fingerprints. The next document
    of the last, and of a single one, is the first. Other columns are not read; an empty table gives
    no row.
    """
    rows = next_texts(docs)
    quarter = "CAST(floor(char_length(text) / 4) AS INT)"
    edited = F.expr(
        f"concat(substring(text, 1, char_length(text) - {quarter}), coalesce(substring(next_text, 1, {quarter}), ''))"
    )
    if "block" not in rows.columns:  # an empty table
        rows = rows.withColumns({"block": F.lit(0), "nth": F.lit(0)})
    plain = F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text"))
    changed = F.struct(F.lit(True).alias("is_edited"), edited.alias("text"))
    texts = rows.select("block", "nth", F.explode(F.array(plain, changed)).alias("x"))
    texts = texts.select("block", "nth", "x.is_edited", "x.text")
    minima = numbered_minima(texts, ["block", "nth", "is_edited"])
    prints = minima.select("block", "nth", "is_edited", tuple_hashes(F.col("entries")).alias("print"))
    prints = prints.groupBy("block", "nth").agg(
        F.max(F.when(~F.col("is_edited"), F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("is_edited"), F.col("print"))).alias("edited_fingerprint"),
    )
    facts = rows.select(
        "block",
        "nth",
        "tail",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
    )
    along = Window.partitionBy("block").orderBy("nth")
    joined = facts.join(prints, ["block", "nth"]).withColumn("next_print", F.lead("fingerprint").over(along))
    return joined.filter(~F.col("tail")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_print").alias("near_next"),
    )
