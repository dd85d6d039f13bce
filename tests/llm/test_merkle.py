import hashlib
import random
import zlib

import duckdb
import pytest

from tokenloom.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return sha("".join(map(part, (row[0], row[2], row[3], row[4], text))))


def climb(nodes):
    """Levels of a tree, until one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def brute(rows):
    """rows: doc_id, text, source, lang, n_chars."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r) for r in by_source[s]), key=lambda x: x[:3])
        trees[s] = ([x[3] for x in own], climb([x[2] for x in own]))
    upper = climb([trees[s][1][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        own, levels = trees[s]
        for i, r in enumerate(own):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node, proof = leaf_of(r, text), ""
            for tree, place in ((levels, i), (upper, at)):
                for level in tree[:-1]:
                    run = level[place // 16 * 16 : place // 16 * 16 + 16]
                    slot = place % 16
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    node = sha("".join([*run[:slot], node, *run[slot + 1 :]]))
                    place //= 16
            root = upper[-1][0]
            out.append((r[0], levels[0][i], levels[-1][0], root, sha(proof), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, leaf int, root string"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    made = M.manifest(docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert made.columns == names
    return sorted(map(tuple, made.collect()), key=str)


def some_rows(n, sources, seed=1):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "Ünder", "x"]
    return [(i, " ".join(draw.choices(words, k=draw.randint(0, 6))), draw.choice(sources), draw.choice(["en", None]), draw.choice([5, None])) for i in range(n)]


@pytest.mark.parametrize(
    ("n", "sources"),
    [(1, ["a"]), (16, ["a"]), (17, ["a", None]), (300, ["a", "b", None, "é", ""]), (700, [f"s{i}" for i in range(300)])],
)
def test_equals_brute_force(spark, n, sources):
    rows = some_rows(n, sources)
    assert run(spark, rows) == brute(rows)


def test_superblocks(spark):
    """A source over several superblocks, one of exactly one, and one of a leaf more."""
    rows = [(i, f"T{i}", "big", "en", 1) for i in range(2 * M.SPAN + 37)]
    rows += [(i + 100_000, "Same", "even", "en", 1) for i in range(M.SPAN)]
    rows += [(i + 200_000, "Same", "more", "en", 1) for i in range(M.SPAN + 1)]
    random.Random(3).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "A", None, None, None), (7, "A", "s", "en", 1), (7, "A", "s", "en", 1), (7, "B", "s", "en", 1)]
    rows += [(2**62 + i, "Long " * 50_000, "s", "en", 250_000) for i in range(3)]
    rows += [(i, "Abc", "s", "en", -1) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_tampering_shows(spark):
    rows = [(i, "Abc", "s", "en", 3) for i in range(60)] + [(i + 60, "abc", "s", "en", 3) for i in range(60)]
    made = run(spark, rows)
    for doc_id, *_, verified in made:
        assert verified == (zlib.crc32(str(doc_id).encode()) % 5 != 0 or doc_id >= 60)


def test_sql_agrees():
    rows = some_rows(600, ["a", "b", None, *(f"s{i}" for i in range(20))], 9) + [(7, "A", "a", "en", 1), (None, "B", "a", None, 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    # A repeated id is joined to itself only where it is one row.
    assert sorted(con.execute(M.manifest_sql(3)).fetchall(), key=str) == brute(rows)
