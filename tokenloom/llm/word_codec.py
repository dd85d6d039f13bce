"""BPE encoding and decoding through a table of distinct words.

Spark deals the texts out to tasks. A task cuts the texts of a run into words, codes them against
the table of distinct words, encodes each distinct word once, and joins the ids back by position. Decoding joins ids to the table of pieces.
Words are cut where the tokenizer's own pattern never matches across: before a run of white space
that follows other characters. The table of pieces is as large as the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tokenloom.llm.common import load_tokenizer, map_runs, word_ids
from tokenloom.llm.words import Words, before_space

# White space as the tokenizer's pattern has it: not the four separators Python adds.
_WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

_WIDE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Codec:
    """Byte-level BPE of a ``tokenizers`` file: words, ids of words, bytes of ids."""

    def __init__(self, path: str):
        import json

        tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: an added token takes its surroundings along")
        self.special = [t["content"] for t in added]
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if added else None
        # Texts with special tokens or with white space outside ASCII are cut with their own pattern.
        self.odd = "|".join([_WIDE, *(re.escape(t) for t in self.special)])
        self.ids = word_ids(path)
        letters = byte_letters()
        pieces = {i: piece for piece, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        self.pieces = pa.array(
            [
                bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode()
                for p in (pieces.get(i, "") for i in range(max(pieces) + 1))
            ],
            pa.large_binary(),
        )

    def words(self, text: str) -> list[str]:
        parts = [p for p in self.split.split(text) if p] if self.split else [text]
        return [w for p in parts for w in ([p] if p in self.special else _WORD.findall(p))]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as 32-bit little-endian integers."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        words = Words(pc.if_else(odd, "", texts), before_space)
        self.ids.learn(words.distinct)
        made = [x.tobytes() for x in words.joined([self.ids[w] for w in words.distinct])]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            own = self.words(texts[i].as_py())
            self.ids.learn(own)
            made[i] = b"".join(map(self.ids.__getitem__, own))
        return made

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: each id is joined to its piece, the pieces of a text are one byte string."""
        texts = []
        for one in ids:
            joined = self.pieces.take(pa.array(np.frombuffer(one, dtype="<u4")))
            data = joined.buffers()[2]
            size = joined.buffers()[1] and np.frombuffer(joined.buffers()[1], dtype=np.int64)[len(joined)]
            texts.append(data.to_pybytes()[:size].decode("utf-8", "replace") if len(joined) and data else "")
        return texts


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens and ids (binary, 32-bit little-endian).

    A null or empty text has no ids; strings of special tokens in a text become their ids.
    Repeated rows are encoded each, other columns are not read.
    """

    def work(run: pa.RecordBatch) -> dict:
        ids = codec(tokenizer).encode(run.column("text"))
        return {
            "doc_id": run.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids": pa.array(ids, pa.binary()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_runs(docs, ["doc_id", "text"], f"doc_id {kind}, n_tokens long, ids binary", work)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id and text. Null ids give the empty text; bytes
    that are no UTF-8 become U+FFFD."""

    def work(run: pa.RecordBatch) -> dict:
        ids = [x or b"" for x in run.column("ids").to_pylist()]
        return {"doc_id": run.column("doc_id"), "text": pa.array(codec(tokenizer).decode(ids), pa.string())}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_runs(encoded, ["doc_id", "ids"], f"doc_id {kind}, text string", work, text="ids")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode in one pass. Per row: doc_id, n_tokens, and the hex SHA-256 of the ids and
    of the text decoded from them (``ids_sha256``, ``decoded_sha256``). Nulls as in ``encode``."""

    def work(run: pa.RecordBatch) -> dict:
        coder = codec(tokenizer)
        ids = coder.encode(run.column("text"))
        texts = coder.decode(ids)
        return {
            "doc_id": run.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_runs(docs, ["doc_id", "text"], schema, work)
