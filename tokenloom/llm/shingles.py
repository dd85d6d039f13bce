"""Word shingles of texts as 64-bit hashes, and b-bit MinHash signatures of shingle sets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tokenloom.llm.words import Words

LANE_BITS = 4
LANES_PER_LONG = 16
# Set members that are hashed under all functions at a time: the products stay in the cache.
BLOCK = 2048


def word_and_space(data: np.ndarray) -> np.ndarray:
    """Cut wherever ASCII white space begins or ends."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = space[1:] != space[:-1]
    return cut


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each number over all 64 bits (the finishing steps of SplitMix64; fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``words`` words, hashed and sorted.

    A-Z are lower-cased, words are runs without ASCII white space. A text with fewer words has its
    whole sequence as its only shingle; one without words has none.
    """
    cut = Words(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string())), word_and_space)
    hashes = np.fromiter(
        (0 if w.isspace() and w.isascii() and w.strip(" \t\n\r\v\f") == "" else xxhash.xxh3_64_intdigest(w) | 1 for w in cut.distinct),
        dtype=np.uint64,
        count=len(cut.distinct),
    )
    if not len(hashes):
        return [np.zeros(0, dtype=np.uint64) for _ in cut.ends]
    every = hashes[cut.codes]
    is_word = every != 0
    flat = every[is_word]
    ends = np.concatenate([[0], np.cumsum(is_word)])[cut.ends]
    factors = odd_numbers(words, 7)
    whole = np.zeros(max(0, len(flat) - words + 1), dtype=np.uint64)
    for j in range(words):
        whole += flat[j : len(flat) - words + 1 + j] * factors[j]
    whole = mixed(whole)
    sets, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= words:
            sets.append(np.unique(whole[start : end - words + 1]))
        elif n:
            total = (flat[start:end] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mixed(np.array([total], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        start = end
    return sets


@dataclass(frozen=True)
class Signer:
    """MinHash with ``bands`` bands of ``rows`` functions."""

    bands: int = 32
    rows: int = 4

    @property
    def functions(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return self.functions // LANES_PER_LONG

    def minima(self, members: np.ndarray) -> np.ndarray:
        a, b = odd_numbers(self.functions, 11)[:, None], odd_numbers(self.functions, 13)[:, None]
        least = np.full(self.functions, np.uint64(2**64 - 1))
        for at in range(0, len(members), BLOCK):
            np.minimum(least, (members[None, at : at + BLOCK] * a + b).min(axis=1), out=least)
        return least

    def sign(self, members: np.ndarray) -> tuple[list[int], list[int]]:
        """Band keys made of whole minima, and the low bits of the (mixed) minima, 16 to a long."""
        least = mixed(self.minima(members))
        rows = least.reshape(self.bands, self.rows)
        keys = mixed((rows * odd_numbers(self.rows, 17)).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))
        lanes = (least & np.uint64(2**LANE_BITS - 1)).reshape(self.longs, LANES_PER_LONG)
        shifts = np.arange(0, 64, LANE_BITS, dtype=np.uint64)
        packed = np.bitwise_or.reduce(lanes << shifts, axis=1)
        return keys.view(np.int64).tolist(), packed.view(np.int64).tolist()


def set_key(members: np.ndarray) -> list[int]:
    """128 bits that stand for the set."""
    return np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
