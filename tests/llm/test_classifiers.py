import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import quality, toxicity

DOCS = "doc_id long, text string, score string, y string, label string, held_out string"
LABELS = "doc_id long, quality int, toxic int, y string"
BAD = ["idiot", "scum", "moron", "trash"]


def corpus(n, seed):
    """Prose, and junk of repeated words, marks and capitals; some documents hold insults."""
    rng = random.Random(seed)
    syllables = ["ta", "re", "mi", "no", "la", "so", "pu", "ke", "vi"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        good, toxic = rng.random() < 0.8, rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ".", ","])
        if not good:
            kind = rng.randrange(3)
            words = [[w] * 6 if kind == 0 else [w + "###"] if kind == 1 else [w.upper() + "!!"] for w in words]
            words = [w for part in words for w in part]
        docs.append((i, " ".join(words), "a", "b", "c", "d"))
        if rng.random() < 0.7:
            labels.append((i, int(good), int(toxic), "z"))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1500, 1)
    extra = [(-1, None), (-2, ""), (-3, "idiot " * 20_000), (None, "no id"), (5, docs[5][1]), (-4, "\U0001f642 é")]
    docs += [(i, t, "a", "b", "c", "d") for i, t in extra]
    labels += [(None, 1, 1, "z"), (-1, 1, 0, "z"), (6, None, None, "z"), (10**9, 0, 1, "z")]
    return spark.createDataFrame(docs, DOCS).repartition(4).cache(), spark.createDataFrame(labels, LABELS).cache()


@pytest.mark.parametrize(
    ("score", "label", "parts", "held", "threshold"),
    [(quality.score_quality, "quality", 4, 2, 0.7), (toxicity.score_toxicity, "toxic", 5, 0, 0.5)],
)
def test_held_out_accuracy(tables, score, label, parts, held, threshold):
    docs, labels = tables
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    right = []
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {}
    for r in rows:
        i = r["doc_id"]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % parts == held)
        # A score is a matter of the text alone.
        assert scores.setdefault(texts[i] or "", r["score"]) == pytest.approx(r["score"], abs=1e-6)
        if r["held_out"] and i in truth:
            right.append(truth[i] == r["predicted"])
    assert len(right) > 100 and np.mean(right) > 0.97


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels = tables
    for score, label, parts, held in ((quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 5, 0)):
        flipped = labels.selectExpr(
            "doc_id",
            *[f"IF(crc32(CAST(doc_id AS STRING)) % {parts} = {held}, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")],
            "y",
        )
        key = lambda r: (r["doc_id"] is None, r["doc_id"], r["score"])
        a, b = (sorted((tuple(r)[:3] for r in score(docs, x).collect()), key=str) for x in (labels, flipped))
        assert [x[0] for x in a] == [x[0] for x in b]
        assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-9)
        del key, label


def test_without_labels_or_rows(spark, tables):
    docs, _ = tables
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    empty = spark.createDataFrame([], DOCS)
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert score(empty, tables[1]).count() == 0
    for keep in (quality.keep_good, toxicity.keep_harmless):
        assert keep(empty, tables[1]).columns == empty.columns


def test_filters_keep_whole_rows(tables):
    docs, labels = tables
    for keep, score, wanted in ((quality.keep_good, quality.score_quality, 1), (toxicity.keep_harmless, toxicity.score_toxicity, 0)):
        kept = keep(docs, labels)
        assert kept.schema == docs.schema
        ids = sorted(r["doc_id"] or -99 for r in kept.collect())
        assert ids == sorted(r["doc_id"] or -99 for r in score(docs, labels).collect() if r["predicted"] == wanted)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    terms = pa.array([f"t{i}" for i in range(40)])
    index = toxicity.Index(terms, rng.uniform(1, 3, 40), 0.2, 0.1)
    vectors = []
    for _ in range(900):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        vectors.append((t, rng.integers(1, 6, len(t)).astype(float)))
    index.add(vectors, rng.integers(0, 2, 900).astype(float), np.arange(900))
    dense = np.zeros((900, 40))
    for e, (t, c) in enumerate(vectors):
        dense[e, t] = index.weights(t, c)
    for _ in range(60):
        t = np.sort(rng.choice(40, rng.integers(1, 10), replace=False))
        c = rng.integers(1, 6, len(t)).astype(float)
        cosines = dense[:, t] @ index.weights(t, c)
        best = np.lexsort((np.arange(900), -np.round(cosines, 9)))[:15]
        best = best[cosines[best] > 0]
        found, got = index.nearest(t, c, 15)
        assert found.tolist() == best.tolist() and np.allclose(got, cosines[best])


def held_bytes(x) -> int:
    if isinstance(x, np.ndarray):
        return x.nbytes
    return sum(held_bytes(v) for v in (x if isinstance(x, (tuple, list)) else vars(x).values() if hasattr(x, "__dict__") else ()))


def test_examples_of_several_languages_are_indexed_apart():
    """Languages share few words, so that their common words need no matrix over all examples; neighbours are
    exact for texts of one language, of several, of light terms alone, and of unknown ones."""
    rng = np.random.default_rng(5)
    n, each = 4 * 500, 300
    weight = rng.uniform(1, 3, 4 * each + 20)
    weight[:: 7] = 0.01
    index = toxicity.Index(pa.array([f"t{i}" for i in range(len(weight))]), weight, 0.2, 0.1)

    def text(language: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        often = (each * rng.random(size) ** 2).astype(int) + language * each
        t = np.unique(np.concatenate([often, rng.integers(0, len(weight), 2)]))
        return t, rng.integers(1, 6, len(t)).astype(float)

    vectors = [text(e % 4, 150) for e in range(n)]
    index.add(vectors, rng.integers(0, 2, n).astype(float), np.arange(n))
    dense = np.zeros((n, len(weight)))
    for e, (t, c) in enumerate(vectors):
        dense[e, t] = index.weights(t, c)
    both = [np.unique(np.concatenate([text(a, 30)[0], text(a + 1, 30)[0]])) for a in (0, 1, 2)]
    light = [np.array([0]), np.arange(0, 210, 7), np.arange(0, len(weight), 7)]
    asked = [text(a % 4, 5 + a) for a in range(80)] + [(t, np.ones(len(t))) for t in both + light]
    for (t, c), (found, got) in zip(asked, index.nearest_of(asked), strict=True):
        cosines = dense[:, t] @ index.weights(t, c)
        best = np.lexsort((np.arange(n), -np.round(cosines, 9)))[:15]
        best = best[cosines[best] > 0]
        assert found.tolist() == best.tolist() and np.allclose(got, cosines[best])
    # One matrix of the common terms over all examples takes over two MB.
    assert held_bytes(index.by_term) < 4_000_000


def test_a_rare_word_finds_its_examples(spark):
    """Three toxic examples share a word too rare to be told from chance; every term has its weight."""
    rng = random.Random(3)
    filler = lambda: " ".join(f"w{rng.randrange(300)}x" for _ in range(20))
    ids = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5]
    toxic = {i for n, i in enumerate(ids) if n % 8 == 0}
    rare = sorted(toxic)[:3]
    texts = {i: filler() + (" zorgblat" if i in rare else " scum" if i in toxic else "") for i in ids}
    texts |= {5000: "zorgblat", 5001: "Quite zorgblat " + " ".join(filler().split()[:3]), 5002: filler()}
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in texts.items()], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i in toxic), "z") for i in ids], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert set(got[5000]["neighbours"]) == set(rare) and got[5000]["predicted"] == 1
    assert set(got[5001]["neighbours"]) == set(rare) and "zorgblat" in got[5001]["terms"]
    assert got[5002]["neighbours"] and got[5002]["predicted"] == 0
    # Document frequencies are those of the whole table: zorgblat is in five of its rows.
    index = toxicity.build_index(docs, labels)
    share = len(toxic) / len(ids)
    expected = (np.log((len(texts) + 1) / (5 + 1)) + 1) * toxicity.association(np.array([3.0]), np.array([0.0]), share)[0]
    assert index.idf[index.terms.index("zorgblat").as_py()] == pytest.approx(expected)


def test_toxicity_equals_brute_force(spark):
    """Terms, weights, neighbours and votes, from the definition."""
    rng = random.Random(7)
    words = ["Scum!", "scummy", "vile-", "(nice)", "kind", "Garten", "gardens", "état", "ok", "of", "étés", "hates", "hated,"]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(9))) for i in range(160)}
    labels = {i: int("um" in t or rng.random() < 0.1) for i, t in texts.items() if i % 3}
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in texts.items()], DOCS)
    given = spark.createDataFrame([(i, 1, y, "z") for i, y in labels.items()], LABELS)

    def terms(text):
        found = Counter()
        for w in text.lower().split():
            bare = w.strip(toxicity.STRIP)
            if len(bare) > 2:
                found.update([bare, *(bare[:n] + "*" for n in (4, 5) if len(bare) > n)])
        return found

    counts = {i: terms(t) for i, t in texts.items()}
    train = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 5]
    share = sum(labels[i] for i in train) / len(train)
    frequency = Counter(t for c in counts.values() for t in c)
    weight = {}
    for t in {t for i in train for t in counts[i]}:
        n1, n0 = (sum(labels[i] == y for i in train if t in counts[i]) for y in (1, 0))
        told = abs(math.log((n1 + 10 * share) / (n1 + n0 + 10) / share))
        weight[t] = (math.log((len(texts) + 1) / (frequency[t] + 1)) + 1) * max(told, 0.001)

    def vector(i):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in counts[i].items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: v for i in train if (v := vector(i))}
    base = (share * len(train) + 1) / (len(train) + 10)
    blank = [i for i in train if i not in vectors]
    empty = (sum(labels[i] for i in blank) + base) / (len(blank) + 1)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, given).collect()}
    assert len(got) == len(texts)
    for i in texts:
        v, score = vector(i), empty
        cosines = {e: sum(x * u.get(t, 0.0) for t, x in v.items()) for e, u in vectors.items()}
        near = sorted((-round(c, 9), e) for e, c in cosines.items() if c > 0)[:15]
        if near:
            w = [cosines[e] ** 2 for _, e in near]
            told = sum(a * labels[e] for a, (_, e) in zip(w, near, strict=True))
            score = (told + 0.5 * base) / (sum(w) + 0.5)
        assert got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert got[i]["neighbours"] == [e for _, e in near[:3]]


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(1, t, "a", "b", "c", "d") for t in ("vile scum", "vile scum", "zzz scum")] + [(2, "kind words", "a", "b", "c", "d")], DOCS)
    given = spark.createDataFrame([(1, 1, 1, "z"), (2, 1, 0, "z")], LABELS)
    assert toxicity.build_index(docs, given).ids.tolist() == [1, 2]


def test_the_risk_is_learned_from_positives_and_unlabelled():
    """No negative label is needed: two clouds, 70 % of the unlabelled from the positive one."""
    rng = np.random.default_rng(2)
    positive = rng.normal(1, 1, (800, 6))
    hidden = rng.random(3000) < 0.7
    unlabelled = np.where(hidden[:, None], rng.normal(1, 1, (3000, 6)), rng.normal(-1, 1, (3000, 6)))
    model = quality.fit_risk(positive, unlabelled, 0.7)
    assert np.mean((model.margin(unlabelled) > 0) == hidden) > 0.95


def test_features_of_odd_texts():
    made = quality.features(pa.array([None, "", " ", "a a a", "A" * 100_000, "é🙂"], pa.string()))
    assert made.shape == (6, quality.FEATURES) and np.isfinite(made).all()
