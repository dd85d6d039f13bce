"""Merkle manifest of a data set: a tree over each source's rows, one over the sources, a proof per row.

Leaves are hashed in Spark expressions, so texts never leave the scan. A global order by (source,
doc_id, leaf) gives every leaf its place in its source. ``SPAN`` leaves in a row of one source are a
superblock; superblocks that begin close together travel as one block of bounded size, so that neither a large
source nor many small ones make a large or a tiny group.

1. Each block reduces its leaves to the nodes of its superblocks.
2. The outer tree above them is folded in joins and groupings of 16 nodes, first per source, then over
   the sources: per level one row for each run of siblings.
3. Leaves and the outer siblings on their superblock's way to the root meet in a cogroup of a block, which
   finishes the local tree, joins local and outer siblings to proofs, and folds each leaf up to the root.

What a group holds is bounded by the span; the levels grow with the logarithm of the rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stored
from tokenloom.plans.groups import cut_lineage

FANOUT = 16
LOCAL_LEVELS = 3
SPAN = FANOUT**LOCAL_LEVELS
PARTS = 5


def field(value: Column) -> Column:
    """A value as the leaf holds it: ``-`` if null, else its UTF-8 length, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    parts = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*parts, field(text)), 256)


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def is_tampered() -> Column:
    """Where 5 divides the CRC of the id as text; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % PARTS == 0, F.lit(False))


def in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows 0.. along ``order``, with no task holding more than a range of them.

    The rows are range-partitioned and sorted; a row's number is its place in its partition plus the
    sizes of the partitions before, of which there is one number for each task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this id are the partition, the lower 33 the row's place in it.
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + place).drop("_at", "_part", "_start")


def same(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, of which null is a value too."""
    return left.join(right.withColumnRenamed(key, "_same"), F.col(key).eqNullSafe(F.col("_same")), how).drop("_same")


def joined_hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def local_levels(leaves: list[str], alone: bool) -> list[list[str]]:
    """The levels of a superblock's tree, leaves first. ``alone``: it is its source's only one, and
    ends where one node is left; another goes on to its full height."""
    levels = [leaves]
    while len(levels) <= LOCAL_LEVELS and (len(levels[-1]) > 1 or not alone):
        below = levels[-1]
        levels.append([joined_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def superblocks(rows: pd.DataFrame):
    """The superblocks of a block: start, and its rows in order."""
    for start, own in rows.sort_values(["start", "slot"]).groupby("start", sort=False):
        yield start, own


def block_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    made = []
    for start, own in superblocks(rows):
        top = local_levels(own["leaf"].tolist(), bool(own["alone"].iloc[0]))[-1]
        made.append((own["source"].iloc[0], own["number"].iloc[0], start, own["block"].iloc[0], top[0]))
    return pd.DataFrame(made, columns=["source", "number", "start", "block", "node"])


def climb(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Fold the trees of each ``key`` over its ``nodes`` (key, number from 0, node).

    Returns the roots (key, root), and ``nodes`` with ``path``: per level the place among the siblings
    and the siblings' run, the node itself included. Nulls are a key too.
    """
    counts = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    level = same(nodes, counts, key).select(key, "number", "node", "_n")
    most = counts.agg(F.max("_n")).first()[0] or 0
    runs, done = [], level.filter("_n = 1").select(key, F.col("node").alias("root"))
    while most > 1:
        ordered = F.array_sort(F.collect_list(F.struct("number", "node")))
        run = level.filter("_n > 1").groupBy(key, F.expr(f"number div {FANOUT}").alias("number"))
        # At most 16 nodes each.
        run = cut_lineage(run.agg(F.transform(ordered, lambda x: x["node"]).alias("run"), F.max("_n").alias("_n")))
        runs.append(run.select(F.col(key).alias("_key"), F.col("number").alias("_number"), "run"))
        level = run.select(
            key, "number", F.sha2(F.array_join("run", ""), 256).alias("node"), F.ceil(F.col("_n") / FANOUT).alias("_n")
        )
        done = done.unionByName(level.filter("_n = 1").select(key, F.col("node").alias("root")))
        most = -(-most // FANOUT)
    step = "struct<place:int,run:array<string>>"
    found = nodes.withColumn("path", F.array().cast(f"array<{step}>"))
    for i, run in enumerate(runs):
        at = F.expr(f"number div {FANOUT ** (i + 1)}")
        place = F.expr(f"CAST(number div {FANOUT**i} % {FANOUT} AS INT)")
        found = found.join(run, F.col(key).eqNullSafe(F.col("_key")) & (at == F.col("_number")), "left")
        entry = F.struct(place.alias("place"), F.col("run")).cast(step)
        path = F.when(F.col("run").isNull(), F.col("path")).otherwise(F.concat("path", F.array(entry)))
        found = found.withColumn("path", path).drop("_key", "_number", "run")
    return done, found


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    for place, run in path:
        node = joined_hash([*run[:place], node, *run[place + 1 :]])
    return node


def proofs(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proof and folded root of each leaf of a block, given the outer paths of its superblocks."""
    above = {row.start: row for row in outer.itertuples(index=False)}
    made = []
    for start, own in superblocks(leaves):
        top = above[start]
        path = [(step["place"], list(step["run"])) for step in top.path]
        rest = "".join(n for place, run in path for i, n in enumerate(run) if i != place)
        levels = local_levels(own["leaf"].tolist(), bool(own["alone"].iloc[0]))
        rows = zip(own["doc_id"], own["slot"], own["leaf"], own["altered"], strict=True)
        for doc_id, slot, own_leaf, altered in rows:
            local, place = [], slot
            for level in levels[:-1]:
                first = place - place % FANOUT
                local.append((place % FANOUT, level[first : first + FANOUT]))
                place //= FANOUT
            near = "".join(n for at, run in local for i, n in enumerate(run) if i != at)
            proof = hashlib.sha256((near + rest).encode()).hexdigest()
            root = fold(fold(altered, local), path)
            made.append((doc_id, own_leaf, top.subroot, top.root, proof, root, root == top.root))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pd.DataFrame(made, columns=columns)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Nulls in any column are ``-`` in the leaf; a null source is a source, the first; a null doc_id comes
    first in its source and is never tampered with. Rows that share a doc_id follow the order of their
    leaves, so equal rows are leaves of their own. A text of any length is hashed in place. Other
    columns are not read; an empty table gives no row.
    """
    altered = F.when(is_tampered(), leaf(lower_ascii(F.col("text")))).otherwise(F.col("leaf"))
    hashed = docs.withColumn("leaf", leaf(F.col("text"))).select("doc_id", "source", "leaf", altered.alias("altered"))
    # Equal rows are told apart by nothing, so the last key only spreads them.
    order = [F.asc("source"), F.asc("doc_id"), F.asc("leaf"), F.asc("_row")]
    rows = in_order(hashed.withColumn("_row", F.monotonically_increasing_id()), order, "at").drop("_row")
    sources = cut_lineage(rows.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")))
    placed = same(rows, sources, "source")
    place = F.col("at") - F.col("first")
    start = F.col("at") - place % SPAN
    leaves = placed.select(
        "doc_id", "source", "leaf", "altered", start.alias("start"), (place % SPAN).cast("int").alias("slot"),
        F.expr(f"(at - first) div {SPAN}").alias("number"), (F.col("size") <= SPAN).alias("alone"),
    ).withColumn("block", F.expr(f"start div {SPAN}"))

    kind = docs.schema["source"].dataType.simpleString()
    held = leaves.select("block", "source", "number", "start", "slot", "leaf", "alone")
    schema = f"source {kind}, number long, start long, block long, node string"
    nodes = stored(held.groupBy("block").applyInPandas(block_nodes, schema))
    subroots, inner = climb(nodes, "source")
    subroots = same(subroots, sources, "source")
    named = in_order(subroots.select("source", F.col("root").alias("subroot"), "first"), [F.asc("first")], "number")
    named = cut_lineage(named.select(F.lit(0).alias("all"), "number", F.col("subroot").alias("node"), "source"))
    roots, last = climb(named, "all")
    last = last.join(roots, "all").select("source", F.col("node").alias("subroot"), "root", F.col("path").alias("_last"))
    outer = same(inner, last, "source")
    outer = outer.select("block", "start", F.concat("path", "_last").alias("path"), "subroot", "root")

    # As text, since pandas would turn whole numbers beside nulls into floats.
    held = leaves.select("block", F.col("doc_id").cast("string"), "start", "slot", "leaf", "altered", "alone")
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    made = held.groupBy("block").cogroup(outer.groupBy("block")).applyInPandas(proofs, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def manifest_sql(levels: int = 8) -> str:
    """The same in DuckDB, for up to ``16 ** levels`` rows a source and as many sources."""
    upper = "".join(map(chr, range(65, 91)))

    def part(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"

    def whole(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, base: str, key: str) -> str:
        """Levels name0.. of (key, i, n, node), and name with each base row's siblings per level."""
        made = [f"{name}0 AS ({base})"]
        for k in range(levels):
            made.append(
                f"{name}{k + 1} AS (SELECT {key}, i // 16 AS i, (n + 15) // 16 AS n, "
                f"CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node "
                f"FROM (SELECT {key}, i, n, node FROM {name}{k}) GROUP BY {key}, i // 16, n)"
            )
            made.append(
                f"{name}s{k} AS (SELECT x.{key}, x.i, x.n, string_agg(y.node, '' ORDER BY y.i) FILTER (y.i < x.i) AS l, "
                f"string_agg(y.node, '' ORDER BY y.i) FILTER (y.i > x.i) AS r FROM {name}{k} x JOIN {name}{k} y "
                f"ON x.{key} IS NOT DISTINCT FROM y.{key} AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY ALL)"
            )
        return ", ".join(made)

    def way(outer: str, name: str, key: str, start: str, place: str, node: str, proof: str) -> str:
        """Joins of a row's siblings, level by level."""
        made, last = [], start
        for k in range(levels):
            made.append(
                f"{outer}{k} AS (SELECT p.* EXCLUDE ({node}, {proof}), "
                f"p.{proof} || coalesce(s.l, '') || coalesce(s.r, '') AS {proof}, "
                f"CASE WHEN s.n IS NULL THEN p.{node} ELSE sha256(coalesce(s.l, '') || p.{node} || coalesce(s.r, '')) END AS {node} "
                f"FROM {last} p LEFT JOIN {name}s{k} s ON s.{key} IS NOT DISTINCT FROM p.{key} AND s.i = p.{place} // {16**k})"
            )
            last = f"{outer}{k}"
        return ", ".join(made)

    inner = "SELECT source, i, n, leaf AS node FROM placed"
    outer = f"SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, node, source FROM a{levels}"
    return f"""
WITH bits AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), leaves AS (
  SELECT doc_id, source, {whole("text")} AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN {whole(f"translate(text, '{upper}', '{upper.lower()}')")} END AS altered
  FROM documents LEFT JOIN bits USING (doc_id)
), placed AS (
  SELECT doc_id, source, leaf, coalesce(altered, leaf) AS altered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), {tree("a", inner, "source")}, {tree("b", outer.replace(", node, source", ", node"), "one")},
top AS ({outer}),
starts AS (
  SELECT p.doc_id, p.source, p.leaf, p.i AS place, 0 AS one, t.i AS source_place, t.node AS subroot,
    p.altered AS folded_root, '' AS proof
  FROM placed p JOIN top t ON t.source IS NOT DISTINCT FROM p.source
), {way("u", "a", "source", "starts", "place", "folded_root", "proof")},
{way("v", "b", "one", f"u{levels - 1}", "source_place", "folded_root", "proof")}
SELECT doc_id, leaf, subroot, (SELECT node FROM b{levels}) AS root, sha256(proof) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM b{levels}) AS verified
FROM v{levels - 1}
"""
