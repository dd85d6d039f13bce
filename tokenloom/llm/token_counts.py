"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no vocabulary piece can reach across (in front of spaces, around line ends,
between letters and most marks). Each distinct piece of text starts as a linked list of characters; a heap holds every adjacent pair that
is a piece of the vocabulary, and the pair of lowest rank, leftmost among equals, is merged again
and again. The count is the number of characters less the number of merges; characters that the
vocabulary lacks count one token per byte. No identifiers are made.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tokenloom.llm.common import Table, map_runs
from tokenloom.llm.words import Words

MARK = "▁"  # fixed value: what a space becomes in the vocabulary
# Longer pieces are counted each time, so that the table of counts stays small.
TABLE_CHARS = 64


class MergeCounter:
    """Counts tokens as the ``sentencepiece`` library does for a BPE model with byte fallback.

    The model must leave characters as they are and put a mark in front of the text; others are
    refused when the model is loaded.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = "A  éé Ａﬁ\t​  z\n"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path} changes characters before it merges")
        scores: dict[str, float] = {}
        self.known: set[str] = set()
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                if model.is_unused(i):
                    raise ValueError(f"{path} has unused pieces")
                piece = model.id_to_piece(i).replace(MARK, " ")
                if len(piece) == 1:
                    self.known.add(piece)
                else:
                    scores[piece] = model.get_score(i)
        if max(map(len, scores)) > 63:
            raise ValueError(f"{path} has pieces of more than 63 characters")
        order = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in scores.items()}
        # With pieces that reach across a line end or from a letter to a space, nothing is cut.
        self.cuts = not any(re.search("\n|[^ ] ", p) for p in scores)
        # ASCII marks that follow a letter, digit or character beyond ASCII in no piece.
        after = {b for p in scores for a, b in zip(p, p[1:]) if a.isalnum() or ord(a) > 127}
        marks = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after]
        self.mark = np.isin(np.arange(256), marks)
        self.letter = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
        self.table = Table(self.merged)

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Cut in front of spaces, around line ends, and between letters and marks."""
        if not self.cuts:
            return np.zeros(len(data), dtype=bool)
        space, line = data == 32, data == 10
        cut = space | line
        cut[1:] &= ~(space[1:] & space[:-1])
        cut[1:] |= line[:-1] | (self.mark[data[1:]] & self.letter[data[:-1]])
        return cut

    def merged(self, piece: str) -> int:
        """Tokens of one piece of text: merge pairs by rank until none is left."""
        n, rank = len(piece), self.rank.get
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0: merged away
        before = list(range(-1, n))  # start of the symbol in front of the one that starts here
        # A pair's rank, place and length in one number: the least is the next to be merged.
        heap = []
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                heap.append((r * n + i) << 6 | 2)
        heapify(heap)
        merges = 0
        while heap:
            key = heappop(heap)
            left = (key >> 6) % n
            middle = end[left]
            if not middle or middle == n or end[middle] - left != key & 63:
                continue  # one of the two has been merged since
            stop = end[left] = end[middle]
            end[middle] = 0
            merges += 1
            if stop < n:
                before[stop] = left
                last = end[stop]
                r = rank(piece[left:last])
                if r is not None:
                    heappush(heap, (r * n + left) << 6 | last - left)
            if left:
                first = before[left]
                r = rank(piece[first:stop])
                if r is not None:
                    heappush(heap, (r * n + first) << 6 | stop - first)
        if self.known.issuperset(piece):
            return n - merges
        alone = (c for i, c in enumerate(piece) if end[i] == i + 1 and c not in self.known)
        return n - merges + sum(len(c.encode()) - 1 for c in alone)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: those of its distinct words, joined back by position."""
        texts = pc.replace_substring(texts, MARK, " ")
        empty = pc.equal(pc.binary_length(texts), 0)
        texts = pc.if_else(empty, texts, pc.binary_join_element_wise(" ", texts, ""))
        words = Words(texts, self.starts)
        counts = [self.table[w] if len(w) <= TABLE_CHARS else self.merged(w) for w in words.distinct]
        return words.sums(np.array(counts, dtype=np.int64))


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null doc_id is
    kept. Other columns of ``docs`` are not read. ``model`` is the path of a model file.
    """

    def work(run: pa.RecordBatch) -> dict:
        texts = pc.fill_null(run.column("text"), "")
        counts = merge_counter(model).count(texts)
        return {
            "doc_id": run.column("doc_id"),
            "n_bytes": pc.binary_length(texts).cast(pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array(counts > limit),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return map_runs(docs, ["doc_id", "text"], schema, work)
