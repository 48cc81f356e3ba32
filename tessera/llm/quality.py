"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The model is b + sum w_i x_i + sum over i < j of <v_i, v_j> x_i x_j. The pairwise part is scored in linear time as
half of sum over f of (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2. Inputs: presence of selected hashed words, scaled
by the root of their number; statistics of structure; length, the one piece of metadata that may enter. It is trained in
numpy on a bounded sample of labelled rows (``rows``, ``max_chars``), with the logistic loss.

Contract. One row for each row of docs: doc_id, held_out, score in [0, 1], predicted. Null texts count as empty; equal
texts get equal scores. Without labelled rows of both kinds every score is the smoothed share of label 1. Other columns
are ignored. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import SLICE, STATISTICS, Sample, placed, presence, select, statistics, training_rows
from tessera.llm.shared import held_out
from tessera.llm.text import slices
from tessera.llm.toxicity import sigmoid

THRESHOLD = 0.3


class Machine:
    """Weights of a factorisation machine; inputs are the statistics first, then the words."""

    def __init__(self, chosen: np.ndarray, mean: np.ndarray, scale: np.ndarray, b: float, w: np.ndarray, v: np.ndarray):
        self.chosen, self.mean, self.scale, self.b, self.w, self.v = chosen, mean, scale, b, w, v

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def score(self, texts: pa.Array, place: np.ndarray) -> np.ndarray:
        n, k = len(texts), STATISTICS
        x = self.dense(statistics(texts)).astype(np.float64)
        # Sums by row, not matrix products, whose rounding depends on how many rows go in: equal texts get equal scores.
        z = self.b + (x * self.w[:k]).sum(1)
        s, q = (np.stack([(a * c).sum(1) for c in b.T], 1) for a, b in ((x, self.v[:k]), (x**2, self.v[:k] ** 2)))
        if len(self.chosen):
            row, feature = presence(texts, place, with_grams=False)
            value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
            z = z + value * np.bincount(row, self.w[k + feature], n)
            for f in range(self.v.shape[1]):
                vf = self.v[k + feature, f]
                s[:, f] += value * np.bincount(row, vf, n)
                q[:, f] += value**2 * np.bincount(row, vf**2, n)
        return sigmoid(z + 0.5 * (s**2 - q).sum(1))


def fit(sample: Sample, most: int = 768, factors: int = 8, epochs: int = 40, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Train on (texts, label); deterministic."""
    y, n = sample.label, len(sample.label)
    b = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if n < 8 or not 0 < y.sum() < n:
        return Machine(np.zeros(0, np.int64), np.zeros(STATISTICS), np.ones(STATISTICS), b, np.zeros(STATISTICS), np.zeros((STATISTICS, factors)))
    chosen = select(sample.texts, y, most, support=max(4, n // 500), with_grams=False)
    stats = np.zeros((n, STATISTICS), np.float32)
    x = np.zeros((n, STATISTICS + len(chosen)), np.float32)
    place = placed(chosen)
    for i, j in slices(sample.texts):
        stats[i:j] = statistics(sample.texts[i:j])
        if len(chosen):
            row, feature = presence(sample.texts[i:j], place, with_grams=False)
            x[i + row, STATISTICS + feature] = (1 / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1)))[row]
    draw = np.random.default_rng(7)
    m = Machine(chosen, stats.mean(0), stats.std(0) + 1e-3, b, np.zeros(x.shape[1]), draw.normal(0, 0.03, (x.shape[1], factors)))
    x[:, :STATISTICS] = m.dense(stats)
    first = [np.zeros_like(m.w), np.zeros_like(m.v), 0.0]
    second = [np.zeros_like(m.w), np.zeros_like(m.v), 0.0]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for a in range(0, n, 512):
            part = order[a : a + 512]
            xb, step = x[part].astype(np.float64), step + 1
            s = xb @ m.v
            z = m.b + xb @ m.w + 0.5 * (s**2 - (xb**2) @ (m.v**2)).sum(1)
            e = (sigmoid(z) - y[part]) / len(part)
            grads = [xb.T @ e + decay * m.w, xb.T @ (e[:, None] * s) - m.v * ((xb**2).T @ e)[:, None] + 10 * decay * m.v, e.sum()]
            moves = []
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                moves.append(rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
            m.w, m.v, m.b = m.w - moves[0], m.v - moves[1], float(m.b - moves[2])
    return m


def _score(batches: Iterator[pa.RecordBatch], m: Machine) -> Iterator[pa.RecordBatch]:
    place = placed(m.chosen)
    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text, SLICE):
            score = m.score(text[i:j], place)
            part = batch.slice(i, j - i)
            yield pa.record_batch(
                {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}
            )


def _kept(batches: Iterator[pa.RecordBatch], m: Machine) -> Iterator[pa.RecordBatch]:
    place = placed(m.chosen)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for i, j in slices(text, SLICE):
            kept = m.score(text[i:j], place) >= THRESHOLD
            yield pa.RecordBatch.from_arrays(batch.slice(i, j - i).filter(pa.array(kept)).columns[:-1], names=batch.schema.names[:-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = 12_000, max_chars: int = 50_000) -> Machine:
    """A machine from up to about ``rows`` rows of labels(doc_id, quality) outside the held-out fold, with their texts."""
    return fit(training_rows(docs, labels, "quality", rows, max_chars))


def quality(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Scores for docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _score(b, sent.value), "doc_id long, held_out boolean, score double, predicted int"
    )


def good_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps (score at least THRESHOLD)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    return docs.select("*", F.col("text").cast("string").alias("_tessera_text")).mapInArrow(lambda b: _kept(b, sent.value), docs.schema)
