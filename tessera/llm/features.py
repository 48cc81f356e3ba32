"""Text features of the classifiers: selected hashed words and byte 5-grams, and statistics of structure."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drawn, held_out
from tessera.llm.text import U64, Words, grams, mix, prefix, utf8, words

BITS = 20
GRAM = 5
#: Bytes of text that are scored at once: the arrays made from them stay in a core's cache.
SLICE = 1 << 17

#: Bytes whose share of a text is a statistic of its own.
SHARES = [b"\n", b"!", b"?", b"#$%&*", b"|", b".,;:", b"<>{}[]\\", b"@", b"/", b"=_-~^+", b"\"'()`"]
STATISTICS = 14 + len(SHARES)


@dataclass
class Sample:
    """A bounded training sample on the driver."""

    texts: pa.Array
    label: np.ndarray


def codes(buf: np.ndarray, off: np.ndarray, with_grams: bool = True) -> tuple[np.ndarray, np.ndarray, Words]:
    """Row and code of every word (below 2**BITS) and, inside words, of every byte 5-gram (from 2**BITS on)."""
    sums = prefix(buf)
    w = words(buf, off, sums)
    mask = U64((1 << BITS) - 1)
    row, code = w.row, (w.hash & mask).astype(np.int64)
    if with_grams and len(buf) >= GRAM:
        longer = np.maximum(w.end - w.start - GRAM + 1, 0)
        at = np.repeat(w.start - np.concatenate([[0], np.cumsum(longer)[:-1]]), longer) + np.arange(longer.sum()) if len(w.start) else w.start
        total, inverse = sums
        h = mix((total[at + GRAM] - total[at]) * inverse[at])
        row = np.concatenate([row, np.repeat(w.row, longer)])
        code = np.concatenate([code, (h & mask).astype(np.int64) + (1 << BITS)])
    return row, code, w


def presence(column: pa.Array, place: np.ndarray, with_grams: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the selected features that each text holds, each once. place: feature of a code, or -1."""
    buf, off = utf8(column, lower=True)
    row, code, _ = codes(buf, off, with_grams)
    feature = place[code]
    kept = feature >= 0
    both = np.unique(row[kept] * (1 << 22) + feature[kept])
    return both >> 22, both & ((1 << 22) - 1)


def placed(selected: np.ndarray) -> np.ndarray:
    out = np.full(2 << BITS, -1, np.int32)
    out[selected] = np.arange(len(selected))
    return out


def document_counts(column: pa.Array, weight: np.ndarray, with_grams: bool = True) -> np.ndarray:
    """For each code, the weighted number of texts that hold it."""
    buf, off = utf8(column, lower=True)
    row, code, _ = codes(buf, off, with_grams)
    both = np.unique(row * (2 << BITS) + code)
    return np.bincount(both % (2 << BITS), weight[both // (2 << BITS)], 2 << BITS)


def distinct_share(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The share of different values among each row's values; 1 for none."""
    seen = np.unique((row.astype(U64) << U64(44)) | (h >> U64(20)))
    total = np.bincount(row, minlength=n)
    return np.where(total > 0, np.bincount((seen >> U64(44)).astype(np.int64), minlength=n) / np.maximum(total, 1), 1.0)


def repeats(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of words that equal the one before, and log(1 + the longest run of one word)."""
    if not len(w.hash):
        return np.zeros(n), np.zeros(n)
    same = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]))
    at = np.arange(len(same))
    run = at - np.maximum.accumulate(np.where(same, 0, at)) + 1
    longest = np.zeros(n)
    np.maximum.at(longest, w.row, run)
    return np.bincount(w.row, same, n) / np.maximum(np.diff(w.first), 1), np.log1p(longest)


def statistics(column: pa.Array) -> np.ndarray:
    """Statistics of structure and of length, one row for each text; all are finite for empty texts too."""
    n = len(column)
    buf, off = utf8(column)
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    table = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256)
    share = table / np.maximum(size, 1)[:, None]
    low, low_off = utf8(column, lower=True)
    w = words(low, low_off)
    count = np.diff(w.first)
    length = np.bincount(w.row, w.end - w.start, n) / np.maximum(count, 1)
    pair_row, pair = grams(w, 2)
    lines = table[:, 10] + 1
    out = [
        np.log1p(size), np.log1p(count), length, share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1),
        share[:, 128:].sum(1), share[:, 32], distinct_share(w.row, w.hash, n), distinct_share(pair_row, pair, n),
        np.log1p(size / lines), np.log1p(lines), *repeats(w, n),
    ]
    out += [share[:, list(s)].sum(1) for s in SHARES]
    return np.stack(out, 1).astype(np.float32)


def select(column: pa.Array, label: np.ndarray, most: int, support: int, with_grams: bool = True, least_z: float = 3.0) -> np.ndarray:
    """Codes whose share of texts differs most between label 1 and the rest, by a two-sample z statistic."""
    a = np.zeros(2 << BITS)
    b = np.zeros(2 << BITS)
    from tessera.llm.text import slices

    for i, j in slices(column):
        a += document_counts(column[i:j], label[i:j].astype(float), with_grams)
        b += document_counts(column[i:j], 1.0 - label[i:j], with_grams)
    p, q = max(label.sum(), 1), max((1 - label).sum(), 1)
    pooled = (a + b + 1) / (p + q + 2)
    z = np.abs(a / p - b / q) / np.sqrt(pooled * (1 - pooled).clip(1e-9) * (1 / p + 1 / q))
    z[np.maximum(a, b) < support] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= least_z])


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: int, max_chars: int, only: int | None = None) -> Sample:
    """Up to about ``most`` labelled rows outside the held-out fold, drawn by a hash of doc_id, with their texts.

    The labels are read by doc_id alone; a doc_id with several labels takes the largest, one with a null label none.
    Texts of over ``max_chars`` aren't trained on, and a doc_id with several texts is trained on with the smallest. The
    draw is a threshold on the hash, set from the number of rows, so the sample stays at this bound however many rows are
    labelled and however often a doc_id repeats.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    if only is not None:
        known = known.where(F.col("label") == only)
    total = known.count()
    chosen = drawn(known, total, most, "doc_id").withColumnRenamed("doc_id", "_id")
    ids = docs.sparkSession.createDataFrame(chosen.toPandas(), chosen.schema)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.where(F.length("text") <= max_chars).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return _ordered(got.groupBy("_id", "label").agg(F.min("text").alias("text")).toArrow())


def unlabelled_rows(docs: DataFrame, most: int, max_chars: int) -> Sample:
    """Up to about ``most`` texts outside the held-out fold, drawn by a hash of the row without regard to labels; rows that repeat count once."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.where(F.length("text") <= max_chars).where(~held_out())
    got = drawn(text, text.count(), most, "doc_id", "text").groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h")).agg(F.any_value("text").alias("text"))
    return _ordered(got.select("_id", "text", F.lit(0).alias("label")).toArrow())


def _ordered(got: pa.Table) -> Sample:
    got = got.sort_by([("_id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string())
    return Sample(text, got["label"].to_numpy().astype(np.float64))
