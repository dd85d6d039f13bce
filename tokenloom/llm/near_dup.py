"""Near duplicates by b-bit MinHash.

1. One pass over the texts: shingle sets, their key, band keys made of whole minima, and the low
   four bits of each minimum packed into longs.
2. Texts with equal sets form a class; one stands for it from here on.
3. Representatives that share a band key are candidates. They are never paired all with all: first
   each is paired with the bucket's central member, the one with most company over all its buckets.
   Bit counts of the packed signatures estimate the similarity, corrected for lanes that agree by
   chance; pairs far below the threshold go, the rest is confirmed on full sets and joined into
   components.
4. What is left are links between components. Members of one component need no further link, so only
   members outside a bucket's largest component are compared with its other components. In a bucket
   of up to ``SMALL`` members they are paired, estimated and confirmed as before. In a larger one,
   members too few of whose shingles any other member of a large bucket has are out at once; the rest
   is compared block by block on full sets, each block giving only links that join components.

Every bucket is treated whole, so no link between components is lost in one. A pair at the threshold
of 0.8 shares none of the 32 band keys with a probability of 5e-8, and its estimate lies below the
cut with one of less than 1e-6.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_runs, stored
from tokenloom.llm.components import components
from tokenloom.llm.shingles import LANE_BITS, Signer, set_key, shingle_sets

# Estimates this far below the threshold are taken as certain: over five standard deviations.
MARGIN = 0.2
ONES = int("1" * 16, 16)
# Members of a bucket up to which they are paired as rows; more are compared in blocks.
SMALL = 64
BLOCK = 1024
COLUMNS = 4096


def signatures(docs: DataFrame, words: int, signer: Signer) -> DataFrame:
    """Per row: doc_id, n_shingles, set key (k1, k2), band keys, packed lanes."""

    def work(run: pa.RecordBatch) -> dict:
        sets = shingle_sets(run.column("text"), words)
        signed = [signer.sign(s) if len(s) else ([], []) for s in sets]
        keys = [set_key(s) for s in sets]
        return {
            "doc_id": run.column("doc_id"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "k1": pa.array([k[0] for k in keys], pa.int64()),
            "k2": pa.array([k[1] for k in keys], pa.int64()),
            "bands": pa.array([s[0] for s in signed], pa.list_(pa.int64())),
            "lanes": pa.array([s[1] for s in signed], pa.list_(pa.int64())),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, k1 long, k2 long, bands array<long>, lanes array<long>"
    return map_runs(docs, ["doc_id", "text"], schema, work)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def work(run: pa.RecordBatch) -> dict:
        sets = [s.view("int64") for s in shingle_sets(run.column("text"), words)]
        return {"id": run.column("doc_id"), "members": pa.array(sets, pa.list_(pa.int64()))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_runs(docs, ["doc_id", "text"], f"id {kind}, members array<long>", work)


def likeness(x: str, y: str, signer: Signer) -> Column:
    """Similarity estimated from packed lanes: lanes that differ are counted as bits, and those that
    agree by chance (one in sixteen) are allowed for."""
    parts = []
    for i in range(signer.longs):
        d = f"({x}[{i}] ^ {y}[{i}])"
        folded = f"({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3))"
        parts.append(f"bit_count({folded} & {ONES}L)")
    equal = F.lit(1.0) - F.expr(" + ".join(parts)) / signer.functions
    chance = 2.0**-LANE_BITS
    return (equal - chance) / (1 - chance)


def links(pairs: DataFrame, lanes: DataFrame, sets: DataFrame, threshold: float, signer: Signer) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, after the estimate has thinned them."""
    left, right = lanes.toDF("a", "la"), lanes.toDF("b", "lb")
    near = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(likeness("la", "lb", signer) >= threshold - MARGIN)
        .select("a", "b")
    )
    both = near.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    union = F.size("ma") + F.size("mb") - shared
    percent = round(100 * threshold)
    return both.filter(100 * shared >= percent * union).select("a", "b")


def buckets_of(one: DataFrame) -> DataFrame:
    """Band keys that several representatives share: key, id, pivot (the central member)."""
    keyed = one.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = stored(keyed.join(stored(shared), "key"))
    company = rows.groupBy("id").agg(F.sum("n").alias("company"))
    central = rows.join(company, "id").groupBy("key").agg(
        (-F.max(F.struct("company", (-F.col("id")).alias("id")))["id"]).alias("pivot")
    )
    return stored(rows.select("key", "id").join(stored(central), "key"))


def crossing_pairs(split: DataFrame) -> DataFrame:
    """Members outside their bucket's largest component, each with the members of other components:
    a, b. ``split``: key, id, component, largest."""
    outside = split.filter("component <> largest")
    outside = outside.select("key", F.col("id").alias("x"), F.col("component").alias("cx"))
    # Two outsiders meet twice: once is enough.
    return (
        outside.join(split.withColumnRenamed("id", "y"), "key")
        .filter("cx <> component AND (component = largest OR x < y)")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def joining_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components among the members of one or two blocks, by full comparison.

    Intersections are counted as a product of the members' columns, some columns at a time.
    """
    ids, components_of = rows["id"].to_numpy(), rows["component"].to_numpy()
    sizes, outside = rows["n"].to_numpy(), (rows["component"] != rows["largest"]).to_numpy()
    lengths = rows["shared"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(rows)), lengths)
    _, column, times = np.unique(np.concatenate(rows["shared"].to_numpy()), return_inverse=True, return_counts=True)
    useful = times > 1
    number = np.cumsum(useful) - 1
    keep = useful[column]
    owner, column = owner[keep], number[column][keep]
    common = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for first in range(0, int(useful.sum()), COLUMNS):
        some = (column >= first) & (column < first + COLUMNS)
        part = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        part[owner[some], column[some] - first] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= (components_of[:, None] != components_of[None, :]) & (outside[:, None] | outside[None, :])
    found, parent = [], {}

    def root(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        p, q = root(components_of[i]), root(components_of[j])
        if p != q:  # one link joins two components
            parent[max(p, q)] = min(p, q)
            found.append((ids[i], ids[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def block_links(split: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between components in large buckets: a, b. ``split``: key, id, component, largest, n."""
    percent = round(100 * threshold)
    members = sets.join(split.select("id").distinct(), "id", "left_semi")
    each = members.select("id", F.explode("members").alias("shingle"))
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("id")).filter("times = 1")
    alone = once.groupBy("id").agg(F.collect_list("shingle").alias("alone"))
    shared = F.array_except("members", F.coalesce("alone", F.array().cast("array<long>")))
    covered = members.join(alone, "id", "left").select("id", F.size("members").alias("n_set"), shared.alias("shared"))
    # Whoever is linked has the threshold's share of its shingles in common with another.
    covered = stored(covered.filter(100 * F.size("shared") >= percent * F.col("n_set")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # Each block meets each block of its bucket, itself included, in a group of its own.
    meets = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")),
    )
    placed = split.withColumn("own", own).select("key", "id", "component", "largest", F.explode(meets).alias("m"))
    placed = placed.select("key", "m.i", "m.j", "id", "component", "largest").join(covered, "id")
    placed = placed.withColumnRenamed("n_set", "n")
    kind = split.schema["id"].dataType.simpleString()
    return placed.groupBy("key", "i", "j").applyInPandas(
        lambda rows: joining_links(rows, percent), f"a {kind}, b {kind}"
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, signer: Signer = Signer()
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``threshold`` (in whole percents); component_id is the smallest doc_id reachable, kept says that
    it is the row's own. Null and empty texts and texts without words have an empty set and no link.
    A row with a null doc_id has a null component_id, is kept and links nothing. Rows that share a
    doc_id are rows of their own. Other columns are not read; an empty table gives no row. Ids are
    whole numbers.
    """
    rows = stored(signatures(docs, words, signer))
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    # One row for each class: its least document's.
    some = linked.withColumnRenamed("doc_id", "id").join(classes, ["k1", "k2", "id"])
    one = some.select("id", "bands", "lanes").dropDuplicates(["id"])

    buckets = buckets_of(one)
    active = stored(buckets.select("id").distinct())
    lanes = stored(one.select("id", "lanes").join(active, "id", "left_semi"))
    texts = docs.select("doc_id", "text").join(active, docs["doc_id"] == active["id"], "left_semi")
    sets = stored(full_sets(texts, words).dropDuplicates(["id"]))

    stars = buckets.filter("id <> pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
    stars = stored(stars.distinct())
    found = stored(links(stars, lanes, sets, threshold, signer))
    first = components(found).toDF("id", "component")

    placed = buckets.join(first, "id", "left")
    placed = stored(placed.select("key", "id", F.coalesce("component", "id").alias("component")))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("m", "component"))["component"].alias("largest"),
        F.sum("m").alias("n"),
        F.count(F.lit(1)).alias("parts"),
    )
    split = stored(placed.join(largest.filter("parts > 1").drop("parts"), "key"))
    crossing = crossing_pairs(split.filter(F.col("n") <= SMALL)).join(stars, ["a", "b"], "left_anti")
    more = links(crossing, lanes, sets, threshold, signer)
    most = block_links(split.filter(F.col("n") > SMALL), sets, threshold)
    joined = components(found.union(stored(more)).union(stored(most))).toDF("id", "component_id")

    named = classes.join(joined, "id", "left")
    named = stored(named.select("k1", "k2", F.coalesce("component_id", "id").alias("component_id")))
    outcome = rows.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return outcome.select(
        "doc_id",
        "n_shingles",
        F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(lone, F.lit(True)).otherwise(F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The whole rows of ``docs`` that stand for their group: one document of each component, and
    every document that is in none. Rows with a null doc_id stay; of rows with the same doc_id and
    text one stays."""
    # Groups of one are kept as they are: only the others' ids need to be known.
    gone = near_duplicates(docs, words, threshold).filter("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    known = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return known.unionByName(left.filter("doc_id IS NULL"))
