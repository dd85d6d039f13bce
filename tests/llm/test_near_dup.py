import random
from collections import defaultdict

import numpy as np
import pytest

from tokenloom.llm.components import components
from tokenloom.llm.near_dup import keep_one_of_each, near_duplicates
from tokenloom.llm.shingles import Signer, shingle_sets

SCHEMA = "doc_id long, text string, component_id string, kept string, key string, id string"


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    """Least id reachable over all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Groups of near copies around the threshold, chains, exact copies, shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 18)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    chain = rng.choices(words, k=100)
    for i in range(15):
        texts.append(" ".join(chain))
        chain[5 * i : 5 * i + 1] = [rng.choice(words)]
    texts += [passage + " " + " ".join(rng.choices(words, k=30)) for _ in range(10)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), "ONE two", "one TWO ", "", " \n", None, "x " * 3000, "x " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, k):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, k, 0.8).collect()}
    expected = {i: (n, c) for i, (n, c) in brute(rows, k, 80).items()}
    assert got == expected


def test_repeated_rows_null_ids_and_whole_rows(spark):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(1, long), (1, long), (2, long + " b"), (None, long), (None, None), (3, ""), (4, "solo")]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)
    made = near_duplicates(df).collect()
    assert len(made) == len(rows)
    assert all(r["kept"] and r["component_id"] is None for r in made if r["doc_id"] is None)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(0, ""), (0, long), (1, long), (3, ""), (4, "solo")]
    )


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_estimate_is_close_to_the_similarity():
    import pyarrow as pa

    rng = random.Random(6)
    signer = Signer()
    errors = []
    for share in (0.0, 0.3, 0.8, 0.95):
        for _ in range(20):
            a = [f"{rng.random()}" for _ in range(300)]
            b = [x if rng.random() < share else f"{rng.random()}" for x in a]
            x, y = shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            p, q = (np.array(signer.sign(s)[1], dtype=np.int64).view(np.uint64) for s in (x, y))
            lanes = [(int(v) >> s) & 15 for v in p ^ q for s in range(0, 64, 4)]
            equal = sum(v == 0 for v in lanes) / len(lanes)
            errors.append((equal - 1 / 16) / (15 / 16) - true)
    assert abs(float(np.mean(errors))) < 0.02 and max(map(abs, errors)) < 0.2
    groups = defaultdict(int)
    for e in errors:
        groups[round(e, 1)] += 1


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """The same classes with buckets of any size compared in blocks of four."""
    from tokenloom.llm import near_dup

    rows = corpus(7)
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "COLUMNS", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 4, 0.8).collect()}
    assert got == brute(rows, 4, 80)
