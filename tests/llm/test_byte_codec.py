import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import byte_codec as B
from tokenloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={}
    )


def ids_of(texts):
    return [x[0].tolist() for x in B.codec(PATH).encode(pa.array(texts, pa.string()))]


def test_code_points(library):
    # All of the first blocks, and a part of the others, which hold long runs of one kind.
    points = [*range(0x3400), *range(0x3400, 0xD800, 41), *range(0xE000, 0x20000, 7), *range(0x20000, 0x110000, 997)]
    points = list(map(chr, points))
    for at in range(0, len(points), 8_000):
        some = points[at : at + 8_000]
        lines = ["".join(f"a{c}1{c}!{c} {c}" for c in some), *(f"x {c}b  {c}\n{c}" for c in some)]
        assert ids_of(lines) == [library.encode_ordinary(t) for t in lines]


def test_random_texts(library):
    draw = random.Random(5)
    parts = ["aaa", "ab", "ba", "the", " ", "  ", "\n", "é", "ß", "привет", "日本", "ات", "'s", "'LL", "12", "!!", "🙂", "x" * 40, " ", "<|endoftext|>", "banana", "мама"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(6_000)]
    texts += ["".join(draw.choices("ab", k=draw.randint(1, 60))) for _ in range(3_000)]
    texts += ["".join(draw.choices("лоан", k=draw.randint(1, 40))) for _ in range(2_000)]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]
    assert any(B.repeats(t.encode()) for t in texts) and not B.repeats(b"abcab")


def test_any_text(library):
    @settings(max_examples=300, deadline=None)
    @given(st.text())
    def holds(text):
        assert ids_of([text]) == [library.encode_ordinary(text)]

    holds()


def test_merged_joins_like_the_rank_table(library):
    ranks = B.read_ranks(PATH)
    draw = random.Random(6)
    for _ in range(2_000):
        match = bytes(draw.choices(b"abenrst", k=draw.randint(1, 150)))
        assert B.merged(match, ranks) == library.encode_ordinary(match.decode())


def test_offsets_cover_the_text():
    texts = ["Grüße, 日本語 🙂 banana  bananana\n\tмама мыла раму", "a  b", "", "ééé" * 50]
    for text, (ids, first, last) in zip(texts, B.codec(PATH).encode(pa.array(texts)), strict=True):
        assert len(ids) == len(first) == len(last)
        data = [B.codec(PATH).tokens[i].as_py() for i in ids.tolist()]
        at = 0
        for token, f, e in zip(data, first.tolist(), last.tolist(), strict=True):
            # The span's characters hold the token's bytes.
            begin = len(text[:f].encode())
            assert begin <= at and at + len(token) <= len(text[:e].encode())
            at += len(token)
        assert at == len(text.encode())


def test_round_trip_of_rows(spark, library):
    texts = [None, "", "Hello world", "Hello world", "日本 🙂", "x" * 300_000, "a b " * 200_000, "  \x85"]
    rows = [(i if i else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = {r["doc_id"]: r for r in B.round_trip(docs, PATH).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids, row = library.encode_ordinary(text or ""), found[i if i else None]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in B.decode(B.encode(docs, PATH), PATH).collect()}
    assert back == {i if i else None: t or "" for i, t in enumerate(texts)}
    assert B.round_trip(docs.limit(0), PATH).count() == 0


def test_split_characters(spark):
    encoded = B.encode(spark.createDataFrame([(1, "🙂")], "doc_id long, text string"), PATH)
    ids = encoded.first()["ids"]
    cut = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None)], "doc_id long, ids array<int>")
    texts = {r["doc_id"]: r["text"] for r in B.decode(cut, PATH).collect()}
    assert texts[1] == "🙂" and texts[3] == "" and (len(ids) == 1 or "�" in texts[2])
