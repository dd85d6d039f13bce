"""Quality classifier learned from trusted positives and unlabelled text.

A small network is trained on shape features of whole texts: it minimises the non-negative unbiased
risk of positive-unlabelled learning, in which the risk on negatives is that on unlabelled text less
the positives' share, and is not let below zero. The class prior is the positives' share among the
labelled rows outside the held-out part. The network's output is then calibrated on those rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_runs
from tokenloom.llm.labelled import keep_rows, labelled_ids, remainder, unlabelled_ids
from tokenloom.llm.shingles import word_and_space
from tokenloom.llm.words import Words

PARTS, HELD = 4, 2
# Most labelled and most unlabelled documents that the model is fitted on.
LABELLED, UNLABELLED = 12_000, 12_000
THRESHOLD = 0.7
BYTES = 128
FEATURES = BYTES + 7


def features(texts: pa.Array) -> np.ndarray:
    """Per text: the (root) shares of its ASCII bytes and of other bytes, of capitals and of marks;
    of words that repeat the word before, of distinct words; mean word length; log length."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(t.encode() for t in texts.to_pylist()), dtype=np.uint8)
    text_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text_of * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(ends - (ends - sizes), 1)[:, None]
    shares = np.hstack([counts[:, :BYTES], counts[:, BYTES:].sum(axis=1, keepdims=True)]) / total
    codes = np.arange(BYTES)
    upper = (codes >= 65) & (codes <= 90)
    letter = upper | ((codes >= 97) & (codes <= 122))
    marks = (codes > 32) & (codes < 127) & ~letter & ~((codes >= 48) & (codes <= 57))
    extra = [shares[:, :BYTES][:, upper].sum(axis=1), shares[:, :BYTES][:, marks].sum(axis=1)]

    words = Words(texts, word_and_space)
    is_word = np.array([not w.isspace() for w in words.distinct], dtype=bool)
    chosen = is_word[words.codes] if len(words.codes) else np.zeros(0, dtype=bool)
    flat = words.codes[chosen]
    upto = np.concatenate([[0], np.cumsum(chosen)])[words.ends]
    per = np.diff(upto, prepend=0)
    owner = np.repeat(np.arange(n), per)
    same = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][same], minlength=n)
    pairs = np.unique(owner.astype(np.int64) * max(1, len(words.distinct)) + flat)
    distinct = np.bincount(pairs // max(1, len(words.distinct)), minlength=n)
    each = np.maximum(per, 1)
    extra += [repeats / each, distinct / each, np.minimum(sizes / each, 100) / 100, np.log1p(sizes) / 10]
    return np.hstack([np.sqrt(shares), np.column_stack(extra)]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 400) -> Model:
    """Minimise the non-negative risk with sigmoid loss by Adam over mixed batches."""
    rng = np.random.default_rng(5)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    model = Model(mean, scale, rng.normal(0, 0.15, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, prior=prior)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    second = {k: np.zeros_like(getattr(model, k), dtype=float) for k in names}
    for step in range(1, rounds + 1):
        xp = p[rng.integers(0, len(p), 1024)]
        xu = u[rng.integers(0, len(u), 2048)]
        x = np.vstack([xp, xu])
        h = np.tanh(x @ model.w1 + model.b1)
        f = h @ model.w2 + model.b2
        s = sigmoid(f)
        slope = s * (1 - s)
        n = len(xp)
        # Sigmoid loss: 1 - s as a positive, s as a negative.
        negative_risk = s[n:].mean() - prior * s[:n].mean()
        grad = np.zeros(len(x))
        if negative_risk >= 0:
            grad[:n] = -2 * prior * slope[:n] / n
            grad[n:] = slope[n:] / (len(x) - n)
        else:  # the estimate has gone below zero: take its step back
            grad[:n] = prior * slope[:n] / n
            grad[n:] = -slope[n:] / (len(x) - n)
        back = np.outer(grad, model.w2) * (1 - h * h)
        grads = {"w1": x.T @ back + 1e-5 * model.w1, "b1": back.sum(axis=0), "w2": h.T @ grad + 1e-5 * model.w2, "b2": grad.sum()}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            move = 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, getattr(model, k) - move)
    return model


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels, by damped Newton steps."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        s = sigmoid(a * margins + b)
        g = np.array([((s - t) * margins).sum(), (s - t).sum()])
        w = s * (1 - s)
        hess = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on at most ``LABELLED`` labelled and ``UNLABELLED`` other documents; None without a
    positive."""
    positives = labelled_ids(labels, "quality", PARTS, HELD, LABELLED).withColumn("of", F.lit("label"))
    others = unlabelled_ids(docs, UNLABELLED).select("doc_id", F.lit(None).cast("int").alias("y"), F.lit("none").alias("of"))
    # At most LABELLED + UNLABELLED rows of an id and a label.
    sample = docs.select("doc_id", "text").join(F.broadcast(positives.unionByName(others)), "doc_id")

    def work(run: pa.RecordBatch) -> dict:
        rows = [x.tobytes() for x in features(run.column("text"))]
        return {"x": pa.array(rows, pa.binary()), "y": run.column("y"), "of": run.column("of")}

    made = map_runs(sample, ["text", "y", "of"], "x binary, y int, of string", work).toArrow()
    if not made.num_rows:
        return None
    x = np.frombuffer(b"".join(made["x"].to_pylist()), dtype=np.float32).reshape(made.num_rows, FEATURES).astype(float)
    y = np.array([-1 if v is None else v for v in made["y"].to_pylist()])
    # Rows come in any order: a fixed one makes the fit the same each time.
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y = x[order], y[order]
    if not (y == 1).any():
        return None
    labelled, unlabelled = y >= 0, x[y < 0]
    prior = float(np.clip(y[labelled].mean(), 0.05, 0.98))
    model = fit_risk(x[y == 1], unlabelled if len(unlabelled) else x, prior)
    if (y == 0).any():
        model.slope, model.shift = calibrate(model.margin(x[labelled]), y[labelled])
    return model


def scorer(model: Model | None):
    def score(texts: pa.Array) -> np.ndarray:
        return model.score(features(texts)) if model else np.full(len(texts), 0.5)

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.7).

    Null texts count as empty, which are scored by the same model. Without any positive label every
    score is 0.5. Rows with a null doc_id are scored, not held out; repeated rows are scored each.
    Labels other than 0 and 1 are not used; of several for a document the largest is. Other columns
    are not read; an empty table gives no row.
    """
    score = scorer(train(docs, labels))

    def work(run: pa.RecordBatch) -> dict:
        return {"doc_id": run.column("doc_id"), "score": pa.array(score(run.column("text")), pa.float64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_runs(docs, ["doc_id", "text"], f"doc_id {kind}, score double", work)
    held = F.coalesce(remainder(PARTS) == HELD, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.7, whole."""
    score = scorer(train(docs, labels))
    return keep_rows(docs, lambda texts: score(texts) >= THRESHOLD)
