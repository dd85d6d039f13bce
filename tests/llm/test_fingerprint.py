import hashlib
import random

from tokenloom.llm.fingerprint import fingerprints

SCHEMA = "doc_id long, text string, block string, nth string, fingerprint string, tail string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(3)
    words = ["the", "of", "Ärger", "日本語の文", "🙂", "a", "extraordinarily", "\n", "  "]
    rows = [(3 * i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 80, 400])))) for i in range(60)]
    rows += [(7, None), (8, ""), (1000, rows[4][1]), (1001, "x" * 40_000)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints(make(spark, rows).repartition(4)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[1][:cut]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same = [r["fingerprint"][k : k + 8] == got[following[0]]["fingerprint"][k : k + 8] for k in range(0, 256, 8)]
        assert r["near_next"] == sum(same) / 32
        if edited == text:
            assert r["near_edited"] == 1.0
        if following[1] == text:
            assert r["near_next"] == 1.0
    assert got[1000]["fingerprint"] == got[rows_id(rows, got[1000], ordered)]["fingerprint"]


def rows_id(rows, row, ordered):
    text = dict(ordered)[1000]
    return min(i for i, t in ordered if t == text)


def test_likeness_falls_with_edits_and_moves(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 400)
    moved = base[200:] + base[:200]
    texts = [base, base[:390] + words[:10], base[:200] + rng.sample(words, 200), rng.sample(words, 400), moved]
    rows = []
    for n, t in enumerate(texts):  # each beside the base
        rows += [(10 * n, " ".join(base)), (10 * n + 1, " ".join(t))]
    got = {r["doc_id"]: r["near_next"] for r in fingerprints(make(spark, rows)).collect()}
    near = [got[10 * n] for n in range(5)]
    assert near[0] == 1.0 > near[1] > near[2] > near[3]
    # The same words in another order are less like the text than it is itself.
    assert near[3] < near[4] < 1.0


def test_one_row_repeated_rows_null_ids_and_none(spark):
    one = fingerprints(make(spark, [(5, "a b c d e f g h")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 15
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "x"), (None, "y"), (2, "z")]
    assert fingerprints(make(spark, rows)).count() == 5
    assert fingerprints(make(spark, [])).count() == 0
