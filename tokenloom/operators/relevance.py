"""Relevance of sentences and messages to a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions.columns import let

K1 = 1.5
B = 0.75


def last_user_queries(conv: DataFrame) -> DataFrame:
    """The last user message of each conversation as its query; empty without one."""
    return conv.groupBy("conv_id").agg(
        F.coalesce(
            F.max_by(
                F.when(F.col("role") == "user", F.col("text")),
                F.when(F.col("role") == "user", F.col("turn")),
            ),
            F.lit(""),
        ).alias("query")
    )


def with_bm25(
    df: DataFrame, sentences: str, query: str, out: str, k1: float = K1, b: float = B
) -> DataFrame:
    """Add an array of sentence scores; the sentences of one row are the collection.

    One row holds one message, so document frequencies and the mean length need no shuffle.
    Repeated query words count repeatedly.
    """
    df = (
        df.withColumn("_docs", F.transform(sentences, T.words))
        .withColumn("_terms", T.words(F.col(query)))
        .withColumn("_shared", F.array_intersect(F.flatten("_docs"), "_terms"))
    )

    # Columns used inside a lambda are bound first: merged projections would otherwise
    # recompute them for every element.
    def only_shared(shared: Column) -> Column:
        return F.struct(
            F.transform(
                "_docs",
                lambda d: F.struct(
                    F.size(d).alias("size"),
                    F.filter(d, lambda w: F.array_contains(shared, w)).alias("hits"),
                ),
            ).alias("docs"),
            F.filter("_terms", lambda t: F.array_contains(shared, t)).alias("terms"),
            shared.alias("shared"),
        )

    df = df.withColumn("_bm", let(F.col("_shared"), only_shared)).drop("_docs", "_terms", "_shared")
    n = F.size("_bm.docs")
    words = F.aggregate("_bm.docs", F.lit(0), lambda acc, d: acc + d["size"])
    df = df.withColumn("_mean", F.greatest(words / F.greatest(n, F.lit(1)), F.lit(1.0)))

    def weights(bm: Column) -> Column:
        def weight(term: Column) -> Column:
            found = F.size(F.filter(bm["docs"], lambda d: F.array_contains(d["hits"], term)))
            return F.ln((F.size(bm["docs"]) - found + 0.5) / (found + 0.5) + 1)

        return F.map_from_arrays(bm["shared"], F.transform(bm["shared"], weight))

    df = df.withColumn("_weights", let(F.col("_bm"), weights))

    def scores(c: Column) -> Column:
        def score(doc: Column) -> Column:
            norm = k1 * (1 - b + b * doc["size"] / c["mean"])

            def add(acc: Column, term: Column) -> Column:
                tf = F.size(F.filter(doc["hits"], lambda w: w == term))
                gain = F.element_at(c["weights"], term) * (tf * (k1 + 1) / (tf + norm))
                return acc + F.when(tf > 0, gain).otherwise(0.0)

            return F.aggregate(c["bm"]["terms"], F.lit(0.0), add)

        return F.transform(c["bm"]["docs"], score)

    bound = F.struct(
        F.col("_bm").alias("bm"), F.col("_weights").alias("weights"), F.col("_mean").alias("mean")
    )
    return df.withColumn(out, let(bound, scores)).drop("_bm", "_mean", "_weights")


def bm25(conv: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Score of every sentence of every message against the conversation's query."""
    rows = conv.join(queries, "conv_id").withColumn("_sents", T.sentences(F.col("text")))
    rows = with_bm25(rows, "_sents", "query", "_scores", k1, b)
    return rows.select("conv_id", "turn", F.posexplode("_scores").alias("sent_no", "score"))


def jaccard(conv: DataFrame, queries: DataFrame) -> DataFrame:
    """Word-set overlap of every message with the conversation's query."""
    wanted = queries.select(
        "conv_id", T.word_set(F.col("query"), T.JACCARD_STOP).alias("_query")
    )
    rows = conv.select("conv_id", "turn", T.word_set(F.col("text"), T.JACCARD_STOP).alias("_words"))
    return rows.join(wanted, "conv_id").select(
        "conv_id", "turn", T.jaccard(F.col("_words"), F.col("_query")).alias("jaccard")
    )


def sentence_filter(df: DataFrame) -> DataFrame:
    """Keep the sentences of ``text`` that matter for ``query``.

    Needs ``text, query, keep_ratio``. The first sentence and every permanent rule stay; the
    best-scored others fill up to ``keep_ratio`` of the sentences, in their old order.
    """
    rows = df.withColumn("_sents", T.sentences(F.col("text")))
    rows = with_bm25(rows, "_sents", "query", "_scores")
    rows = rows.withColumn(
        "_pinned", F.transform("_sents", lambda s, i: (i == 0) | T.is_permanent(s))
    )
    n_pinned = F.size(F.filter("_pinned", lambda p: p))
    wanted = F.rint(F.size("_sents") * F.col("keep_ratio")).cast("int")
    rows = rows.withColumn("_free", F.greatest(n_pinned, wanted) - n_pinned)

    def choose(c: Column) -> Column:
        losses = F.transform(
            c["scores"],
            lambda x, i: F.struct(F.get(c["pinned"], i).alias("p"), (-x).alias("loss"), i.alias("i")),
        )
        ranked = F.array_sort(F.filter(losses, lambda r: ~r["p"]))
        return F.transform(F.slice(ranked, F.lit(1), c["free"]), lambda r: r["i"])

    bound = F.struct(
        F.col("_scores").alias("scores"),
        F.col("_pinned").alias("pinned"),
        F.col("_free").alias("free"),
    )
    rows = rows.withColumn("_chosen", let(bound, choose))
    bound = F.struct(F.col("_pinned").alias("pinned"), F.col("_chosen").alias("chosen"))
    kept = let(
        bound,
        lambda c: F.filter(
            "_sents", lambda s, i: F.get(c["pinned"], i) | F.array_contains(c["chosen"], i)
        ),
    )
    untouched = (F.col("keep_ratio") >= 1.0) | (F.size("_sents") <= 1)
    rows = rows.withColumn(
        "text", F.when(untouched, F.col("text")).otherwise(F.array_join(kept, " "))
    )
    return rows.drop("_sents", "_scores", "_pinned", "_free", "_chosen")
