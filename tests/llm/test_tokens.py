"""Token counts, word codec and packing against the libraries they must agree with."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tokenloom.llm.common import Table, WordIds
from tokenloom.llm.packing import pack, sequences
from tokenloom.llm.token_counts import count_tokens
from tokenloom.llm.word_codec import decode, encode, round_trip

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string, at string"


def hard_texts(seed, n=400):
    rng = random.Random(seed)
    parts = [*"ab e  \n\t'sτΣς1٣é́ßÅ  \x1c\x85​中文字🙂▁<|>.,!?#\r\x00İ", "<|endoftext|>", "<s>", "the ", "  ", "\n\n", "'re"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", " ", "\n", "x" * 30_000, "word " * 20_000, "The cat, the cat. THE CAT!", "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, repeated rows, a null id, very long texts, clashing extra columns."""
    texts = [None, *hard_texts(1)]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", "x", "y", "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def by_id(df):
    """Rows by text's id; repeated rows agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r["doc_id"], r) == r
    return out


def test_counts_are_the_librarys(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = count_tokens(docs, PIECES, limit=50)
    assert got.count() == docs.count()
    got = by_id(got)
    for r in docs.collect():
        text = r["text"] or ""
        n = len(model.encode(text))
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(text.encode()), n, n > 50)


def test_codec_is_the_librarys(docs):
    tokenizer = Tokenizer.from_file(BYTES)
    ids, texts, digests = by_id(encode(docs, BYTES)), by_id(decode(encode(docs, BYTES), BYTES)), by_id(round_trip(docs, BYTES))
    for r in docs.collect():
        expected = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        data = np.array(expected, dtype="<u4").tobytes()
        text = tokenizer.decode(expected, skip_special_tokens=False)
        i = r["doc_id"]
        assert (ids[i]["n_tokens"], bytes(ids[i]["ids"])) == (len(expected), data)
        assert texts[i]["text"] == text
        assert digests[i]["ids_sha256"] == hashlib.sha256(data).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(docs, size):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = defaultdict(list)
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        expected[r["doc_id"]].append(np.array(ids, dtype="<u4").tobytes())
    rows = pack(docs, WORDS, size=size).collect()
    windows, whole = defaultdict(list), defaultdict(dict)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        # Repeated rows have the same cuts only by chance: keep pieces by place in the stream.
        whole[r["doc_id"]].setdefault(r["sequence_id"] * size + r["offset"] - r["start"], []).append(r)
    for parts in windows.values():  # gapless from 0
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    full = [sum(n for _, n in parts) for _, parts in sorted(windows.items())]
    assert set(full[:-1]) <= {size} and 0 < full[-1] <= size and sorted(windows) == list(range(len(windows)))
    for doc_id, blobs in expected.items():
        copies = [b"".join(bytes(p["ids"]) for p in sorted(c, key=lambda p: p["start"])) for c in whole[doc_id].values()]
        assert sorted(copies) == sorted(blobs)
        assert all(p["doc_tokens"] * 4 == len(copies[0]) for c in whole[doc_id].values() for p in c)


def test_sequences_hold_the_pieces(docs):
    pieces = pack(docs.limit(40), WORDS, size=64).cache()
    total = pieces.agg({"length": "sum"}).first()[0]
    rows = sequences(pieces).orderBy("sequence_id").collect()
    assert [r["n_tokens"] for r in rows[:-1]] == [64] * (len(rows) - 1)
    assert sum(len(r["ids"]) for r in rows) == 4 * total


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for made in (count_tokens(none, PIECES), round_trip(none, BYTES), pack(none, WORDS)):
        assert made.count() == 0


def test_tables_stay_within_their_bound():
    table = Table(len, limit=10)
    for i in range(1000):
        assert table["x" * (i % 37)] == i % 37
        assert len(table) <= 10 and len(table.last) <= 10
    ids = WordIds(BYTES, limit=5)
    ids.learn(["a", "b", "c"])
    ids.learn([f"w{i}" for i in range(20)])
    ids.learn(["next"])
    assert "w3" in ids.last and "a" not in ids.last or len(ids) == 1
