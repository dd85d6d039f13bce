import math
import random

import pytest

from tokenloom.llm import top_k as T
from tokenloom.llm.top_k import top_k

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, id string"


def brute(rows, every, k):
    import numpy as np

    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        mine = next(v for i, v in usable if i == q)
        scored = [(-sum(a * b for a, b in zip(mine, v)), i) for i, v in usable if i != q and len(v) == len(mine)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, rows, every, k):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in top_k(df, every=every, k=k).collect())


def test_against_all_scores(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # many ties
    rows += [(2001, None), (2002, []), (2004, [None] * 6), (2006, [math.nan] * 6), (2008, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(3000, [1.0, 2.0]), (3001, [0.5, -1.0])]
    rng.shuffle(rows)
    assert run(spark, rows, 20, 5) == brute(rows, 20, 5)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [1e4, -1e4]), (10, [1e4, 1e4]), (11, [0.0, 0.0])]
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert run(spark, [(0, [1.0])], 10, 5) == []
    assert run(spark, [], 10, 5) == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    assert run(spark, rows, 10, 5) == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 65536)]


@pytest.mark.parametrize("n", [6, 7, 8, 9, 10])
def test_small_blocks_that_hold_the_query(spark, n):
    """One block of a few more rows than k, the query's own among them."""
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in top_k(df, every=2, k=5).collect()) == brute(rows, 2, 5)


def test_a_block_of_equal_vectors(spark):
    # Four vectors lie above the equal ones, of which the fifth winner is the smallest id.
    rows = [(0, [1.0, 0.5])] + [(i, [2.0, 1.0]) for i in range(1, 40)] + [(50 + i, [3.0 + i, 1.0]) for i in range(4)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in reversed(rows)], SCHEMA).coalesce(1)
    assert sorted(tuple(r) for r in top_k(df, every=10, k=5).collect()) == brute(rows, 10, 5)


def test_queries_go_out_in_bounded_groups(spark, monkeypatch):
    """However many lanes there are, a query is sent once a round, with its group."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(900)] + [(1000 + i, [0.5] * 4) for i in range(200)]
    rows += [(2000 + i, [rng.gauss(0, 1), 1.0]) for i in range(20)]
    sizes, sent = [], T.sent

    def counting(queries):
        sizes.append(queries.count())
        return sent(queries)

    monkeypatch.setattr(T, "sent", counting)
    monkeypatch.setattr(T, "GROUP", 60)
    monkeypatch.setattr(T, "CANDIDATE_BLOCK", 300)
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert 0 < max(sizes) < 112 and len(sizes) > 3


@pytest.mark.parametrize("size", [1, 1 << 8, 1 << 20, 1 << 28])
@pytest.mark.parametrize("by_id", [True, False])
def test_best_of_a_task(size, by_id):
    """Scores in floats of either size and in longs, with ties, own rows and an upper end."""
    import numpy as np

    draw = np.random.default_rng(size)
    q_ids, ids = np.arange(7), draw.permutation(3000) % 2000
    q, c = draw.integers(-3, 4, (7, 5)) * size, draw.integers(-3, 4, (3000, 5)) * size
    low, width = draw.integers(-9, 3, 7) * size * size, 12 * size * size
    best = T.Best((q_ids, q, low), 4, None if by_id else width, by_id)
    for at in range(0, 3000, 1100):
        best.add(ids[at : at + 1100], c[at : at + 1100])
    for i in range(7):
        scores = [(sum(int(a) * int(b) for a, b in zip(q[i], v)), int(d)) for v, d in zip(c, ids) if d != i]
        scores = sorted((-s, d) for s, d in scores if s >= low[i] and (by_id or s < low[i] + width))[:4]
        found = [(-int(s), int(d)) for s, d in zip(best.scores[i], best.ids[i]) if s != T.OWN]
        assert found == scores if by_id else [s for s, _ in found] == [s for s, _ in scores]
