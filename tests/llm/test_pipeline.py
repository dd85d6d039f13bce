import random
import zlib

import pytest

import corpus_pipeline
from tokenloom.llm.queries import QUERIES, tokenizer_path
from tokenloom.llm.near_dup import near_duplicates
from tokenloom.llm.packing import pack
from tokenloom.llm.quality import score_quality
from tokenloom.llm.toxicity import score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices(["ta", "re", "mi", "no"], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        good, toxic = rng.random() < 0.85, rng.random() < 0.2
        if toxic:
            words[3] = words[9] = "scum"
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000 + i, docs[i][1] + " end") for i in range(40)] + [(2000, None), (2001, ""), docs[7]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_do_what_the_operators_say(spark, folder):
    docs = corpus_pipeline.table(spark, folder, "documents")
    labels = corpus_pipeline.table(spark, folder, "labels")
    by_stage = dict(corpus_pipeline.STAGES)
    assert list(by_stage) == ["quality", "toxicity", "near_duplicates", "packing"]
    good = by_stage["quality"](spark, docs, folder).cache()
    bad = {r["doc_id"] for r in score_quality(docs, labels).collect() if not r["predicted"]}
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in docs.collect()} - bad and bad
    mild = by_stage["toxicity"](spark, good, folder).cache()
    toxic = {r["doc_id"] for r in score_toxicity(good, labels).collect() if r["predicted"]}
    assert {r["doc_id"] for r in mild.collect()} == {r["doc_id"] for r in good.collect()} - toxic and toxic
    single = by_stage["near_duplicates"](spark, mild, folder).cache()
    kept = [r["doc_id"] for r in near_duplicates(mild).filter("kept").collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(kept))
    for made in (good, mild, single):
        assert made.columns == docs.columns
    packed = {r["doc_id"]: r["doc_tokens"] for r in pack(single, tokenizer_path("word_bpe_49k.json")).collect()}
    final = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert final == packed


def test_planted_documents(spark, folder):
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    labels = {r["doc_id"]: r for r in corpus_pipeline.table(spark, folder, "labels").collect()}
    clean = {i for i, r in labels.items() if r["quality"] and not r["toxic"]}
    assert len(final & clean) >= 0.98 * len(clean)
    assert not [i for i in final if i in labels and labels[i]["toxic"]]
    assert not [i for i in final if 1000 <= i < 1040 and i - 1000 in final]


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11))


def test_remainders_are_those_of_the_text():
    assert zlib.crc32(b"123456789") == 0xCBF43926
