"""Toxicity by non-negative positive-unlabelled learning.

A linear model on the presence of selected hashed words and byte 5-grams is trained in numpy from confirmed toxic
examples (P) and unlabelled text (U). Its risk is pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1)) with the logistic loss,
where pi is the class prior: when the bracket turns negative, which only happens by overfitting, the step climbs it
instead. pi is the share of toxic rows among the labelled training rows unless it is given.

Contract. One row for each row of docs: doc_id, held_out, score in [0, 1], predicted. Null and empty texts have no
features and get the model's base rate; equal texts get equal scores. Without confirmed examples every score is the
prior. Other columns are ignored. Both training samples are bounded (``positives``, ``unlabelled``, ``max_chars``);
scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import SLICE, Sample, placed, presence, select, training_rows, unlabelled_rows
from tessera.llm.shared import FOLDS, held_out
from tessera.llm.text import slices

PRIOR_RANGE = (0.005, 0.6)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(texts: pa.Array, selected: np.ndarray) -> np.ndarray:
    x, place = np.zeros((len(texts), len(selected)), np.float32), placed(selected)
    for i, j in slices(texts):
        row, feature = presence(texts[i:j], place)
        x[i + row, feature] = 1
    return x


def fit(positive: Sample, unlabelled: Sample, prior: float, most: int = 1024, steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> dict:
    """The selected codes, their weights and the bias."""
    base = float(np.log(prior / (1 - prior)))
    n, m = len(positive.texts), len(unlabelled.texts)
    if not n or not m:
        return {"codes": np.zeros(0, np.int64), "w": np.zeros(0), "b": base}
    both = pa.concat_arrays([positive.texts, unlabelled.texts])
    label = np.concatenate([np.ones(n), np.zeros(m)])
    chosen = select(both, label, most, support=max(3, n // 100), least_z=5.0)
    x = _matrix(both, chosen)
    p, u = x[:n], x[n:]
    w, b = np.zeros(len(chosen), np.float32), base
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + np.float32(b), u @ w + np.float32(b)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        on_p, on_u = (sp - 1) * prior / n, su / m
        corrected = np.append(u.T @ on_u - prior * (p.T @ sp) / n, on_u.sum() - prior * sp.mean())
        if negative >= 0:
            grad = np.append(p.T @ on_p, on_p.sum()) + corrected
        else:
            grad = -corrected
        grad[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return {"codes": chosen, "w": w, "b": float(b)}


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    place, w = placed(model["codes"]), model["w"]
    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text, SLICE):
            row, feature = presence(text[i:j], place)
            score = sigmoid(np.bincount(row, w[feature], j - i) + model["b"])
            part = batch.slice(i, j - i)
            yield pa.record_batch(
                {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}
            )


def toxicity(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 3_000, unlabelled: int = 9_000, max_chars: int = 50_000
) -> DataFrame:
    """Scores for docs(doc_id, text), learnt from the rows of labels(doc_id, toxic) outside the held-out fold."""
    if prior is None:
        known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
        seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("p")).first()
        prior = (seen["p"] + 0.5) / (seen["n"] + 5)
    prior = float(np.clip(prior, *PRIOR_RANGE))
    model = fit(training_rows(docs, labels, "toxic", positives, max_chars, only=1), unlabelled_rows(docs, unlabelled, max_chars), prior)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _score(b, sent.value), "doc_id long, held_out boolean, score double, predicted int"
    )


__all__ = ["FOLDS", "fit", "toxicity"]
