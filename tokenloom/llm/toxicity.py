"""Toxicity by the nearest labelled examples.

Terms are words and their first four and five letters. A document's vector holds every term that any
labelled example has: TF-IDF, with document frequencies over all documents, times how far the share
of toxic examples with the term is from the share of all (``association``). No term is left out; one
that tells nothing has next to no weight.

An inverted index holds the examples that have a term and the term's counts. The examples lie in blocks of like
ones (those of a language, say); terms that many examples of a block have are a matrix there instead, which
a text with few of them need not be multiplied with in full. Terms that weigh least in the examples, a
hundredth of their squared lengths together, are in neither. A text's neighbours are found exactly: products with
the matrices and the other terms' postings give every example's cosine but for rounding (single precision)
and the light terms, whose share is at most the product of the light parts' lengths; all examples that can be
among the nearest are scored anew with every term. Neighbours vote with their squared cosine,
smoothed by the share of toxic examples; they and the heaviest terms are
the evidence. A text without any known term is as toxic as the examples without one are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_runs
from tokenloom.llm.labelled import keep_rows, labelled_ids, remainder
from tokenloom.llm.words import Words, before_space

PARTS, HELD = 5, 0
# Most labelled documents that the index is built from.
LABELLED = 20_000
THRESHOLD = 0.5
NEIGHBOURS = 15
# Weight of the base rate among the votes.
SMOOTHING = 0.5
# Examples at the share of all that a term's own examples are mixed with; its least association.
PRIOR, LEAST = 10.0, 0.001
# A term is common if more than one in so many examples of a block have it. Texts multiplied at a time; those
# with at most one in so many common terms of a block are multiplied with these terms alone.
COMMON, BATCH, FEW = 10, 256, 24
# Most blocks of like examples; most of the commonest terms that they are told by, and rounds to find them.
BLOCKS, TOLD_BY, ROUNDS = 8, 256, 8
# The light terms' share of the examples' squared lengths. Examples handled at a time.
LIGHT, SOME = 0.003, 512
# Postings of a term that are copied as one slice if there are more.
SHORT = 64
# Words whose terms are counted at a time.
WORDS = 250_000
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
SPACE = " \t\n\v\f\r"


def terms_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of distinct words, and which word each is of: the word without marks around it or white
    space before it, and its first four and five letters."""
    bare = pc.utf8_trim(words, characters=STRIP + SPACE)
    size = pc.utf8_length(bare).to_numpy()
    owners, terms = [np.flatnonzero(size > 2)], [bare.filter(pa.array(size > 2))]
    for n in (4, 5):
        longer = bare.filter(pa.array(size > n))
        owners.append(np.flatnonzero(size > n))
        terms.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(longer, 0, n), "*", ""))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], pa.concat_arrays(terms).take(pa.array(order))


def lower_words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.string())), before_space)


def term_counts(texts: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of each term of each text, and the terms. Only ``known`` terms if given."""
    words = lower_words(texts)
    owner, terms = terms_of(pa.array(words.distinct, pa.string()))
    coded = terms.dictionary_encode()
    ids, listed = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if known is not None:
        ids = pc.fill_null(pc.index_in(listed, value_set=known), -1).to_numpy().astype(np.int64)[ids]
        listed = known
        owner, ids = owner[ids >= 0], ids[ids >= 0]
    none = np.zeros(0, dtype=np.int64)
    if not len(ids):
        return none, none, none, listed
    # Words of one code have several terms: a list of terms for each code.
    size = np.bincount(owner, minlength=len(words.distinct))
    begin = np.cumsum(size) - size
    span, found = max(1, len(listed)), []
    # Texts are taken together until they have WORDS words, so that what is made of them stays small.
    first = 0
    while first < len(words.ends):
        start = int(words.ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(words.ends, start + WORDS, side="right")))
        codes = words.codes[start : words.ends[last - 1]]
        text_of = np.repeat(np.arange(first, last), np.diff(words.ends[first:last], prepend=start))
        has = size[codes] > 0
        codes, text_of = codes[has], text_of[has]
        each = size[codes]
        at = np.repeat(begin[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        found.append(np.unique(np.repeat(text_of * span, each) + ids[at], return_counts=True))
        first = last
    pairs, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    return pairs // span, pairs % span, counts, listed


def association(n1: np.ndarray, n0: np.ndarray, share: float) -> np.ndarray:
    """How far the share of toxic examples among those with a term is from ``share``, as a logarithm."""
    return np.maximum(np.abs(np.log((n1 + PRIOR * share) / (n1 + n0 + PRIOR) / share)), LEAST)


def packed(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """A document's terms, in order, and their counts."""
    return zlib.compress(np.concatenate([np.diff(terms, prepend=0), counts]).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), dtype="<i4")
    return np.cumsum(both[: len(both) // 2], dtype=np.int32), both[len(both) // 2 :]


def at_least(values: np.ndarray, k: int) -> float:
    """A number that k of the values are not below, close to the kth largest; 0 if there are no more than k."""
    if len(values) <= k:
        return 0.0
    # The largest of each of many groups; the kth of these has k values at or above it.
    groups = len(values) // max(1, min(16, len(values) // (4 * k)))
    whole = len(values) // groups * groups
    most = values[:whole].reshape(-1, groups).max(axis=0)
    return float(np.partition(most, len(most) - k)[len(most) - k])


@dataclass
class Lists:
    """Places and counts by key, the keys' own one after another: those of key i from ``begin[i]`` to
    ``begin[i + 1]`` of ``both``, which has the place in the lower ``bits`` and the count above them."""

    begin: np.ndarray
    both: np.ndarray
    bits: int

    @classmethod
    def of_size(cls, begin: np.ndarray, places: int, most: int) -> Lists:
        """Empty lists for up to so many places, and counts up to ``most``."""
        bits = max(1, (places - 1).bit_length())
        return cls(begin, np.empty(begin[-1], dtype=np.uint32 if most < 1 << (32 - bits) else np.uint64), bits)

    def split(self, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and the counts."""
        both = both.astype(np.int64)
        return both & ((1 << self.bits) - 1), both >> self.bits

    def joined(self, places: np.ndarray | int, counts: np.ndarray) -> np.ndarray:
        return places | counts.astype(np.int64) << self.bits

    def taken(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys' places and counts, one key after another, and how many each key has."""
        first, last = self.begin[keys], self.begin[keys + 1]
        both = self.both
        parts = [both[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        return *self.split(np.concatenate(parts) if parts else both[:0]), last - first

    def added(self, keys: np.ndarray, factors: np.ndarray, values: np.ndarray, places: int) -> np.ndarray:
        """By place, the sum of the values of its counts under the keys, times the keys' ``factors``."""
        first = self.begin[keys]
        sizes = self.begin[keys + 1] - first
        # Long lists are copied as slices, short ones place by place.
        long, short = sizes > SHORT, (sizes > 0) & (sizes <= SHORT)
        both, few = self.both, sizes[short]
        parts = [both[a : a + b] for a, b in zip(first[long].tolist(), sizes[long].tolist(), strict=True)]
        at = np.repeat(first[short] - (np.cumsum(few) - few), few)
        at += np.arange(len(at))
        place, counts = self.split(np.concatenate([*parts, both[at]]))
        each = np.repeat(np.concatenate([factors[long], factors[short]]), np.concatenate([sizes[long], few]))
        each *= values[counts]
        return np.bincount(place, each, minlength=places)

    def runs(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of some keys after others: the keys one by one, their places and counts."""
        for i in range(0, len(keys), SOME):
            place, count, sizes = self.taken(keys[i : i + SOME])
            yield np.repeat(keys[i : i + SOME], sizes), place, count


@dataclass
class Block:
    """Like examples, ``first`` to ``last`` in the order of blocks: the row of each term that is common
    among them, or -1, and the matrix of these terms' weights by example."""

    first: int
    last: int
    row: np.ndarray
    matrix: np.ndarray

    def multiply(self, vectors: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], out: np.ndarray) -> None:
        """Put the products of the texts' common terms and the examples' into ``out``."""
        q = np.zeros((len(vectors), len(self.matrix)), dtype=np.float32)
        for i, ((t, _), w) in enumerate(zip(vectors, weights, strict=True)):
            row = self.row[t]
            q[i, row[row >= 0]] = w[row >= 0]
        used = np.count_nonzero(q, axis=1)
        many = used * FEW > len(self.matrix)
        out[many, self.first : self.last] = q[many] @ self.matrix
        for i in np.flatnonzero(~many & (used > 0)):
            some = np.flatnonzero(q[i])
            out[i, self.first : self.last] = q[i, some] @ self.matrix[some]


@dataclass
class Index:
    """Examples' unit vectors by example and by term. ``idf`` is a term's weight: IDF times association."""

    terms: pa.Array
    idf: np.ndarray
    base: float
    empty: float
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    packed: list[bytes] = field(default_factory=list)

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: np.ndarray) -> None:
        self.packed, self.y, self.ids = [packed(t, c) for t, c in vectors], y, ids

    @cached_property
    def rows(self) -> tuple[Lists, np.ndarray]:
        """The terms and counts of each example, and its vector's length. Made by each worker, as all
        else that is cached; the packed form is given up for it."""
        sizes, most = np.zeros(len(self.packed) + 1, dtype=np.int64), 1
        for e, x in enumerate(self.packed):
            both = np.frombuffer(zlib.decompress(x), dtype="<i4")
            sizes[e + 1], most = len(both) // 2, max(most, int(both[len(both) // 2 :].max()))
        self.told = 1 + np.log(np.maximum(np.arange(most + 1), 1))
        rows, length = Lists.of_size(np.cumsum(sizes), len(self.idf), most), np.empty(len(self.packed))
        for e, x in enumerate(self.packed):
            terms, counts = unpacked(x)
            rows.both[rows.begin[e] : rows.begin[e + 1]] = rows.joined(terms, counts)
            length[e] = np.sqrt(((self.told[counts] * self.idf[terms]) ** 2).sum())
        self.packed = []
        return rows, length

    @cached_property
    def light(self) -> tuple[np.ndarray, np.ndarray]:
        """Which terms are light, and the length of each example's light part."""
        rows, length = self.rows
        every, most = np.arange(len(length)), len(self.idf)
        energy, n = np.zeros(most), np.zeros(most)
        for e, terms, counts in rows.runs(every):
            energy += np.bincount(terms, (self.told[counts] * self.idf[terms] / length[e]) ** 2, minlength=most)
            n += np.bincount(terms, minlength=most)
        # Those that weigh least for the work they make: texts have a term as often as examples do.
        order = np.argsort(energy / np.maximum(n, 1) ** 2, kind="stable")
        light = np.zeros(most, dtype=bool)
        light[order[np.cumsum(energy[order]) <= LIGHT * len(length)]] = True
        part = np.zeros(len(length))
        for e, terms, counts in rows.runs(every):
            some = light[terms]
            weight = self.told[counts[some]] * self.idf[terms[some]] / length[e[some]]
            part += np.bincount(e[some], weight**2, minlength=len(part))
        return light, np.sqrt(part)

    def likeness(self) -> np.ndarray:
        """The block of each example, by k-means on which of the commonest terms it has. What is near does
        not hang on it, only how fast that is found."""
        rows, length = self.rows
        every, most = np.arange(len(length)), len(self.idf)
        n = np.zeros(most, dtype=np.int64)
        for _, terms, _ in rows.runs(every):
            n += np.bincount(terms, minlength=most)
        often = np.argsort(-n, kind="stable")[:TOLD_BY]
        row = np.full(most, -1, dtype=np.int16)
        row[often] = np.arange(len(often))
        has = np.zeros((len(length), len(often)), dtype=np.float32)
        for e, terms, _ in rows.runs(every):
            there = row[terms] >= 0
            has[e[there], row[terms[there]]] = 1

        def unit(x: np.ndarray) -> np.ndarray:
            return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

        has = unit(has)
        # Begin with examples that are unlike each other.
        centres = has[:1]
        for _ in range(BLOCKS - 1):
            centres = np.vstack([centres, has[(has @ centres.T).max(axis=1).argmin()]])
        for _ in range(ROUNDS):
            block = (has @ centres.T).argmax(axis=1)
            sums = [has[block == j].sum(axis=0) if (block == j).any() else c for j, c in enumerate(centres)]
            centres = unit(np.array(sums))
        return (has @ centres.T).argmax(axis=1)

    @cached_property
    def by_term(self) -> tuple[np.ndarray, list[Block], Lists]:
        """The examples in the order of blocks; the blocks; the postings of terms outside the blocks'
        matrices, by place in that order. No light terms."""
        (rows, length), (light, _) = self.rows, self.light
        block = self.likeness()
        number = np.argsort(block, kind="stable")
        ends = np.cumsum(np.bincount(block))
        bounds = rows.begin.tolist()
        total, blocks = np.zeros(len(self.idf), dtype=np.int64), []

        for first, last in zip([0, *ends[:-1].tolist()], ends.tolist()):
            n = np.zeros(len(self.idf), dtype=np.int64)
            for _, terms, _ in rows.runs(number[first:last]):
                n += np.bincount(terms, minlength=len(n))
            n[light] = 0
            # A small block's matrix would have a row for most terms of its examples.
            often = np.flatnonzero(n * COMMON > max(last - first, BATCH))
            row = np.full(len(self.idf), -1, dtype=np.int16 if len(often) < 1 << 15 else np.int32)
            row[often] = np.arange(len(often))
            n[often] = 0
            total += n
            if last > first:
                blocks.append(Block(first, last, row, np.zeros((len(often), last - first), dtype=np.float32)))
        postings = Lists.of_size(np.concatenate([[0], np.cumsum(total)]), len(number), len(self.told) - 1)
        free = postings.begin[:-1].copy()
        # Example by example, so that no more memory is used than the lists take.
        for b in blocks:
            for place, e in enumerate(number[b.first : b.last].tolist(), b.first):
                terms, counts = rows.split(rows.both[bounds[e] : bounds[e + 1]])
                heavy = ~light[terms]
                terms, counts = terms[heavy], counts[heavy]
                row = b.row[terms]
                common, rest = row >= 0, terms[row < 0]
                b.matrix[row[common], place - b.first] = self.told[counts[common]] * self.idf[terms[common]] / length[e]
                postings.both[free[rest]] = postings.joined(place, counts[~common])
                free[rest] += 1
        return number, blocks, postings

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine (ties: the earlier example), and the cosines."""
        return self.nearest_of([(terms, counts)], k)[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several texts."""
        rows, length = self.rows
        number, blocks, postings = self.by_term
        n, out, query = len(self.y), [], np.zeros(len(self.idf))
        weights = [self.weights(t, c) for t, c in vectors]
        cosines_of = np.zeros((len(vectors), n), dtype=np.float32)
        for b in blocks:
            b.multiply(vectors, weights, cosines_of)
        light, part = self.light
        shrink, part = 1 / length[number], part[number]
        # No cosine is above 1, so this is above what rounding can add or take.
        slack = (max(len(b.matrix) for b in blocks) + 8) * 2.0**-23
        for (t, _), w, products in zip(vectors, weights, cosines_of, strict=True):
            query[t] = w * self.idf[t]
            near = postings.added(t, query[t], self.told, n) * shrink
            near += products
            least = at_least(near, k) - 2 * slack
            near += np.sqrt((w[light[t]] ** 2).sum()) * part
            left = np.sort(number[np.flatnonzero(near >= least if least > 0 else near > 0)])
            cosines = np.zeros(len(left))
            for i in range(0, len(left), SOME):
                held, counts, sizes = rows.taken(left[i : i + SOME])
                owner = np.repeat(np.arange(len(sizes)), sizes)
                cosines[i : i + SOME] = np.bincount(owner, query[held] * self.told[counts], minlength=len(sizes))
            cosines /= length[left]
            query[t] = 0
            left, cosines = left[cosines > 0], cosines[cosines > 0]
            best = np.lexsort((left, -np.round(cosines, 9)))[:k]
            out.append((left[best], cosines[best]))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines**2
        return float(((w * self.y[found]).sum() + SMOOTHING * self.base) / (w.sum() + SMOOTHING))

    def heaviest(self, terms: np.ndarray, counts: np.ndarray, k: int = 5) -> list[str]:
        """The k terms that weigh most; of equal ones, the first by letters."""
        w = self.weights(terms, counts)
        some = np.flatnonzero(w >= np.partition(w, len(w) - k)[len(w) - k]) if len(w) > k else np.arange(len(w))
        named = zip((-w[some]).tolist(), self.terms.take(pa.array(terms[some])).to_pylist(), strict=True)
        return [name for _, name in sorted(named)[:k]]

    def judge(self, texts: pa.Array) -> list[tuple[float, list[int], list[str]]]:
        """Score, nearest examples' ids and terms found, per text."""
        out: list[tuple[float, list[int], list[str]]] = [(self.empty, [], [])] * len(texts)
        if not len(self.y):
            return out
        text, term, count, _ = term_counts(texts, self.terms)
        cuts = np.flatnonzero(np.diff(text)) + 1
        same: dict[bytes, list[int]] = {}
        vectors = []
        for i, t, c in zip(np.unique(text), np.split(term, cuts), np.split(count, cuts), strict=False):
            rows = same.setdefault(t.tobytes() + c.tobytes(), [])
            if not rows:
                vectors.append((t, c))
            rows.append(i)
        owners = list(same.values())
        for at in range(0, len(vectors), BATCH):
            part = vectors[at : at + BATCH]
            for (t, c), (found, cosines), rows in zip(part, self.nearest_of(part), owners[at : at + BATCH], strict=True):
                score = self.vote(found, cosines) if len(found) else self.empty
                heaviest = self.heaviest(t, c)
                for i in rows:
                    out[i] = (score, self.ids[found[:3]].tolist(), heaviest)
        return out


def vocabulary(sample: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Every term of the sample's documents, those of most documents first, and its association with the
    label. None if the sample lacks either label."""
    totals = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["y"]: r["n"] for r in totals}
    if len(n) < 2:
        return pa.array([], pa.string()), np.zeros(0)

    def work(run: pa.RecordBatch) -> dict:
        text, term, _, names = term_counts(run.column("text"))
        y = run.column("y").to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, dtype=int)
        n1 = np.bincount(term[y == 1], minlength=len(names)) if names else np.zeros(0, dtype=int)
        n0 = np.bincount(term[y == 0], minlength=len(names)) if names else np.zeros(0, dtype=int)
        return {"term": names, "n1": pa.array(n1, pa.int64()), "n0": pa.array(n0, pa.int64())}

    counted = map_runs(sample, ["text", "y"], "term string, n1 long, n0 long", work)
    counted = counted.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # What is looked up most lies together.
    counted = counted.withColumn("n", F.col("n1") + F.col("n0")).toArrow().sort_by([("n", "descending"), ("term", "ascending")])
    n1, n0 = (counted.column(c).to_numpy().astype(float) for c in ("n1", "n0"))
    return pa.array(counted.column("term").to_pylist(), pa.string()), association(n1, n0, n[1] / (n[0] + n[1]))


def document_frequencies(docs: DataFrame, names: Broadcast[pa.Array], terms: int) -> tuple[int, np.ndarray]:
    """The number of rows of ``docs``, and of those with each of the ``terms`` terms."""

    def work(run: pa.RecordBatch) -> dict:
        _, term, _, _ = term_counts(run.column("text"), names.value)
        count = np.bincount(term, minlength=1)
        found = np.flatnonzero(count)
        # Rows as such count under -1.
        return {
            "term": pa.array(np.append(found, -1).astype(np.int32)),
            "n": pa.array(np.append(count[found], run.num_rows).astype(np.int64)),
        }

    counted = map_runs(docs, ["text"], "term int, n long", work).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(terms)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def build_index(docs: DataFrame, labels: DataFrame) -> Index:
    """Index of at most ``LABELLED`` labelled documents outside the held-out part, with every term."""
    chosen = labelled_ids(labels, "toxic", PARTS, HELD, LABELLED)
    # At most LABELLED rows of an id and a label; of several texts of an id the least stands.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    names, associated = vocabulary(sample)
    known = docs.sparkSession.sparkContext.broadcast(names)

    def work(run: pa.RecordBatch) -> dict:
        text, term, count, _ = term_counts(run.column("text"), known.value)
        cuts = np.searchsorted(text, np.arange(run.num_rows + 1))
        made = [packed(term[a:b], count[a:b]) if b > a else b"" for a, b in zip(cuts, cuts[1:])]
        return {"doc_id": run.column("doc_id"), "y": run.column("y"), "held": pa.array(made, pa.binary())}

    rows = map_runs(sample, ["doc_id", "text", "y"], "doc_id long, y int, held binary", work)
    rows = sorted(((r["doc_id"], bytes(r["held"]), r["y"]) for r in rows.collect()))
    y = np.array([r[2] for r in rows], dtype=float)
    base = float((y.sum() + 1) / (len(y) + 10)) if len(y) else 0.0
    blank = np.array([not r[1] for r in rows], dtype=bool)
    empty = float((y[blank].sum() + base) / (blank.sum() + 1)) if len(y) else 0.0
    index = Index(names, np.zeros(len(associated)), base, empty)
    some = [r for r in rows if r[1]]
    index.packed, index.y = [r[1] for r in some], np.array([r[2] for r in some], dtype=float)
    index.ids = np.array([r[0] for r in some], dtype=np.int64)
    if len(names):
        total, df = document_frequencies(docs, known, len(associated))
        index.idf = (np.log((total + 1) / (df + 1)) + 1) * associated
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5), and as
    evidence neighbours (ids of the nearest examples, three at most) and terms (five at most).

    Null and empty texts, and texts without a term of any example, get the share of toxic examples
    among those without one. Without labels of both kinds every score is that share. Rows
    with a null doc_id are scored, not held out; repeated rows are scored each. Labels other than 0
    and 1 are not used; of several for a document the largest is. Other columns are not read; an
    empty table gives no row.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels))

    def work(run: pa.RecordBatch) -> dict:
        judged = index.value.judge(run.column("text"))
        return {
            "doc_id": run.column("doc_id"),
            "score": pa.array([j[0] for j in judged], pa.float64()),
            "neighbours": pa.array([j[1] for j in judged], pa.list_(pa.int64())),
            "terms": pa.array([j[2] for j in judged], pa.list_(pa.string())),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, neighbours array<long>, terms array<string>"
    scored = map_runs(docs, ["doc_id", "text"], schema, work)
    held = F.coalesce(remainder(PARTS) == HELD, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held, "score", predicted, "neighbours", "terms")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, whole."""
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels))
    return keep_rows(docs, lambda texts: np.array([j[0] < THRESHOLD for j in index.value.judge(texts)], dtype=bool))
