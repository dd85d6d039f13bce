"""Byte-level BPE encoding and decoding by a table of ranks, with the tokenizers library.

The ranks become a model of the library: each byte has a letter, a token is the letters of its bytes,
and every way to split a token into two tokens is a merge, in the order of the ranks. That is what a
rank table means: the adjacent pair whose joined bytes have the least rank is joined, the leftmost
first. The library orders the ways to split one token, where a rank table has the leftmost first; this can
only matter where one token could arise at two places of a match by different splits, so only if at
least three bytes repeat in it. Such matches are merged by ``merged`` here instead (``repeats``).

Spark deals Arrow batches out to tasks. A task cuts the texts of a batch before white space, codes
the chunks against the batch's distinct ones and gives those to the library, whose
offsets say which characters a token covers; ids and offsets are joined back by position. Decoding reverses
the table of letters: tokens are joined as bytes, and only then read as UTF-8, so characters split
among tokens come back whole, and incomplete ones become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.llm.common import Table, map_runs
from tokenloom.llm.word_codec import byte_letters
from tokenloom.llm.words import Words, before_space

def before_any_space(data: np.ndarray) -> np.ndarray:
    """Cut in front of ASCII white space that follows anything but white space, in ASCII or beyond: there
    a match of the pattern always ends."""
    cut = before_space(data)
    at = np.flatnonzero(cut)
    if len(at):
        last, second, third = (data[np.maximum(at - i, 0)] for i in (1, 2, 3))
        wide = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
        general = (last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)
        wide |= (third == 0xE2) & (((second == 0x80) & general) | ((second == 0x81) & (last == 0x9F)))
        wide |= (third == 0xE3) & (second == 0x80) & (last == 0x80)
        wide |= (third == 0xE1) & (second == 0x9A) & (last == 0x80)
        cut[at[wide]] = False
    return cut


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(match: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the adjacent pair of least rank is joined, the leftmost first, until none is
    left. A heap holds the pairs, a linked list the parts."""
    if match in ranks:
        return [ranks[match]]
    end = list(range(1, len(match) + 1))
    after, before = list(range(1, len(match) + 1)), list(range(-1, len(match) - 1))
    heap = [(r, i, i + 2) for i in range(len(match) - 1) if (r := ranks.get(match[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        # Parts that were joined in the meantime have other ends.
        if end[i] == 0 or j >= len(match) or end[j] != stop:
            continue
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < len(match):
            before[after[i]] = i
            if (r := ranks.get(match[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(match[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    ids, i = [], 0
    while i < len(match):
        ids.append(ranks[match[i : end[i]]])
        i = after[i]
    return ids


def repeats(match: bytes) -> bool:
    """Do any three bytes of the match come again in it?"""
    return len(set(match)) < len(match) and len(set(zip(match, match[1:], match[2:]))) < len(match) - 2


class ByteCodec:
    """A tokenizer of the library made from a rank file: chunks to ids and offsets, ids to bytes."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path}: a byte has no token of its own")
        self.bytes_of = byte_letters()
        letters = {b: c for c, b in self.bytes_of.items()}
        name = {token: "".join(map(letters.__getitem__, token)) for token in self.ranks}
        merges = [
            (name[token[:i]], name[token[i:]])
            for token in sorted(self.ranks, key=self.ranks.get)
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        vocabulary = {name[token]: rank for token, rank in self.ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True, cache_capacity=0))
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.tokenizer.pre_tokenizer = self.cutter
        by_id = {rank: token for token, rank in self.ranks.items()}
        self.tokens = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())
        self.sizes = [len(by_id.get(i, b"")) for i in range(len(self.tokens))]
        # A chunk's ids, 32 bits each; in decimals, each with a comma; how many begin inside a character.
        self.table: Table = Table(lambda chunk: self.digests([chunk])[0])

    def known(self, chunks: list[str]) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and offsets of chunks."""
        for chunk, e in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
            ids = e.ids
            yield self.by_match(chunk) if len(ids) > 1 and repeats(chunk.encode()) else (ids, e.offsets)

    def digests(self, chunks: list[str]) -> list[tuple[bytes, bytes, int]]:
        made = []
        for chunk, (ids, spans) in zip(chunks, self.known(chunks), strict=True):
            # Tokens of an ASCII chunk never split a character.
            split = 0 if chunk.isascii() else sum(spans[i][1] > spans[i + 1][0] for i in range(len(spans) - 1))
            made.append((array("I", ids).tobytes(), (",".join(map(str, ids)) + ",").encode(), split))
        return made

    def by_match(self, chunk: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and offsets of a chunk, match by match; those in which bytes repeat are merged here."""
        ids, spans = [], []
        for match, (begin, _) in self.cutter.pre_tokenize_str(chunk):
            data = bytes(map(self.bytes_of.__getitem__, match))
            if repeats(data):
                own = merged(data, self.ranks)
            else:
                own = [t.id for t in self.tokenizer.model.tokenize(match)]
            # Which character each byte belongs to: all but UTF-8's continuation bytes begin one.
            starts = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
            owner = (np.cumsum(starts) - 1 + begin).tolist()
            at = 0
            for i in own:
                size = self.sizes[i]
                spans.append((owner[at], owner[at + size - 1] + 1))
                at += size
            ids += own
        return ids, spans

    def chunks(self, texts: pa.Array) -> tuple[Words, list[tuple[bytes, bytes, int]]]:
        """The chunks of the texts, and the digests of the distinct ones."""
        words = Words(texts, before_any_space)
        if len(self.table) >= self.table.limit:
            self.table.turn()
        new = self.table.new(words.distinct)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.table.update(zip(part, self.digests(part), strict=True))
        return words, [self.table[w] for w in words.distinct]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and the code points at which each token's characters begin and end."""
        words = Words(texts, before_any_space)
        ids, first, last = [], [], []
        for own, spans in self.known(words.distinct):
            ids.append(array("I", own).tobytes())
            first.append(array("I", [f for f, _ in spans]).tobytes())
            last.append(array("I", [e for _, e in spans]).tobytes())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        chars = np.fromiter(map(len, words.distinct), np.int64, len(ids))
        out, start = [], 0
        for i, f, e, end in zip(*map(words.joined, (ids, first, last)), words.ends.tolist(), strict=True):
            codes = words.codes[start:end]
            before = np.cumsum(chars[codes]) - chars[codes]
            shift = np.repeat(before, sizes[codes]).astype(np.uint32)
            out.append((i, f + shift, e + shift))
            start = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another."""
        joined = self.tokens.take(pa.array(ids))
        if not len(joined) or joined.buffers()[2] is None:
            return b""
        size = np.frombuffer(joined.buffers()[1], dtype=np.int64)[len(joined)]
        return joined.buffers()[2].to_pybytes()[:size]


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids, and begin and end of each token's
    characters in the text (code points; a character split among tokens is in the span of each).

    A null or empty text has no ids. Strings of special tokens are ordinary text. Rows with a null or a
    repeated doc_id are encoded each; other columns are not read; an empty table gives no row. A text
    of any length is encoded whole, by one task.
    """

    def work(run: pa.RecordBatch) -> dict:
        made = codec(ranks).encode(run.column("text"))
        lists = [pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in range(3)]
        return {
            "doc_id": run.column("doc_id"),
            "n_tokens": pa.array([len(m[0]) for m in made], pa.int64()),
            **dict(zip(("ids", "first", "last"), lists, strict=True)),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, first array<int>, last array<int>"
    return map_runs(docs, ["doc_id", "text"], schema, work)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, data (the tokens' bytes), text (data as UTF-8, what
    is none as U+FFFD). Null ids give the empty text; an id that no token has is an error."""

    def work(run: pa.RecordBatch) -> dict:
        data = [codec(ranks).decode(np.array(x or (), dtype="<u4")) for x in run.column("ids").to_pylist()]
        texts = [d.decode("utf-8", "replace") for d in data]
        return {"doc_id": run.column("doc_id"), "data": pa.array(data, pa.binary()), "text": pa.array(texts, pa.string())}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_runs(encoded, ["doc_id", "ids"], f"doc_id {kind}, data binary, text string", work, text=None)


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode and decode in one pass. Per row: doc_id, n_tokens, the hex SHA-256 of the decimal ids
    joined by commas and of the decoded bytes, and n_split, the tokens that begin inside a character.
    Nulls as in ``encode``."""

    def work(run: pa.RecordBatch) -> dict:
        coder = codec(ranks)
        words, made = coder.chunks(run.column("text"))
        ids = words.joined([m[0] for m in made])
        listed = words.joined([m[1] for m in made], "u1")
        split = words.sums(np.fromiter((m[2] for m in made), np.int64, len(made)))
        return {
            "doc_id": run.column("doc_id"),
            "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in listed], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()),
            "n_split": pa.array(split.astype(np.int64)),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
    return map_runs(docs, ["doc_id", "text"], schema, work)
