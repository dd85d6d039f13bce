"""Distinct words of a run of texts, and joining what is known of each word back by position."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Which bytes of a text start a word, given all bytes; the start of a text always does.
Rule = Callable[[np.ndarray], np.ndarray]


class Words:
    """The words of a run: ``distinct`` words, the ``codes`` of all words in order, and ``ends``,
    the number of words up to and including each text."""

    def __init__(self, texts: pa.Array, rule: Rule):
        texts = pc.fill_null(texts, "").cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            self.distinct, self.codes = [], np.zeros(0, dtype=np.int32)
            self.ends = np.zeros(len(texts), dtype=np.int64)
            return
        data = np.frombuffer(buffer, dtype=np.uint8)[first:last]
        cut = rule(data)
        cut[offsets[:-1][np.diff(offsets) > 0] - first] = True
        starts = np.flatnonzero(cut).astype(np.int32) + first
        bounds = pa.py_buffer(np.append(starts, np.int32(last)))
        coded = pa.StringArray.from_buffers(len(starts), bounds, buffer).dictionary_encode()
        self.distinct = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy()
        self.ends = np.searchsorted(starts, offsets[1:])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of its words' values."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])]) if len(self.codes) else np.zeros(1, np.int64)
        return np.diff(total[self.ends], prepend=0)

    def joined(self, blobs: list[bytes], kind: str = "<u4") -> list[np.ndarray]:
        """Per text, the ids of its words, one after another: ``blobs`` has those of the distinct
        words as 32-bit little-endian integers, or numbers of another ``kind``."""
        if not blobs:
            return [np.zeros(0, dtype=kind) for _ in self.ends]
        ids = np.frombuffer(b"".join(blobs), dtype=kind)
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // np.dtype(kind).itemsize
        begin = np.cumsum(sizes) - sizes
        size = sizes[self.codes]
        after = np.cumsum(size)
        flat = ids[np.repeat(begin[self.codes] - (after - size), size) + np.arange(after[-1])]
        cuts = np.concatenate([[0], after])[self.ends]
        return np.split(flat, cuts[:-1])


def before_space(data: np.ndarray) -> np.ndarray:
    """Cut in front of ASCII white space that follows anything else."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    return cut
