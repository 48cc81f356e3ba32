"""Embedding whitening from an exact integer scatter matrix.

Every entry c becomes the integer x = floor(64 * c) + 1000000. Over the distinct x vectors (the fit list, n vectors) each
task subtracts the shift and adds up sums and cross-products as integers: matrix products in floating point of parts so
small that every partial sum is below 2**53 and so exact, joined as integers of any size. Between tasks they are added as
columns of limbs of 30 bits, so no sum can overflow. n * XᵀX - SSᵀ is formed from Python integers on the driver, one matrix of
d x d; only its quotient by n² becomes floating point, correctly rounded, and goes to ``eigh``. The shift cancels in it.

A second pass over the fit list measures the covariance of the whitened vectors themselves, and a third projects all rows.

Contract. Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of each length are a fit list of
their own, with its n and its components; vectors of no entries have no components and so no rows. 64 * c is held within
2**62, so huge entries stay integers. A component without variance (all vectors alike, one vector, dependent entries: an
eigenvalue below 1e-13 of the largest for each dimension) has null as whitened and 0 as explained, and doesn't count in
identity_error, which is 0 without any other. A deviation beyond 64 bits is null. Repeated rows come out once each; ids may be null
or repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import discard, stage

SCALE, SHIFT, MOST = 64.0, 1_000_000, 16
LIMB = 30
#: Parts of a number that are multiplied in floating point, and rows whose products are summed in it: 2 * PART + log2(ROWS) <= 53.
PART, ROWS = 21, 2_048
FLAT = 1e-13


@dataclass(frozen=True)
class Fit:
    """n vectors of one length: their sums without the shift, eigenvalues and eigenvectors (columns), falling, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def firm(self) -> np.ndarray:
        """Which components have a variance."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * FLAT * len(self.sums)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exactly, as 64-bit integers if they hold it and as Python's otherwise."""
        most = self.n * (int(np.abs(y).max(initial=0)) + 1) + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Coordinates of y's rows (without the shift) on the first components, NaN where there is no variance."""
        k = min(MOST, len(self.sums))
        x = (self.centred(y) / self.n).astype(np.float64)
        out = np.full((len(y), k), np.nan)
        firm = self.firm[:k]
        out[:, firm] = (x @ self.vectors[:, :k][:, firm]) / np.sqrt(self.values[:k][firm])
        return out

    def deviations(self, y: np.ndarray) -> list[int | None]:
        d = self.centred(y)
        if d.dtype != object and len(self.sums) * (int(np.abs(d).max(initial=0)) ** 2) < 1 << 62:
            return (d * d).sum(1).tolist()
        found = (d.astype(object) ** 2).sum(1).tolist() if d.shape[1] else [0] * len(d)
        return [int(x) if x < 1 << 63 else None for x in found]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their x without the shift) of the column's whole vectors, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), -1)
    flat = column.flatten()
    begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    entries = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        c = entries[begin[rows][:, None] + np.arange(length)]
        whole = np.isfinite(c).all(1)
        yield rows[whole], np.floor(np.clip(c[whole] * SCALE, -(2.0**62), 2.0**62)).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's integers as bytes: 16 bits an entry if that holds all of the vector's, else 64."""
    for batch in batches:
        for _, y in integers(batch.column(0)):
            small = (y >= -(1 << 15)).all(1) & (y < 1 << 15).all(1)
            for own, kind in ((y[small], "<i2"), (y[~small], "<i8")):
                if len(own):
                    raw = pa.py_buffer(own.astype(kind).tobytes())
                    width = own.shape[1] * int(kind[-1])
                    yield pa.record_batch({"length": np.full(len(own), own.shape[1], np.int32), "y": pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(own), [None, raw]).cast(pa.binary())})


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The vectors of a batch of (length, y), as matrices of one length each."""
    length, y = batch.column("length").to_numpy(), batch.column("y")
    width = y.cast(pa.binary()).to_pylist()
    for n in np.unique(length).tolist():
        for size, kind in ((2, "<i2"), (8, "<i8")):
            own = [b for b, k in zip(width, length.tolist(), strict=True) if k == n and len(b) == size * n]
            if own:
                yield np.frombuffer(b"".join(own), kind).reshape(len(own), n).astype(np.int64)


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows as Python integers."""
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i in range(0, len(y), ROWS):
        rest, parts = y[i : i + ROWS], []
        while len(parts) == 0 or rest.any():
            low = ((rest + (1 << (PART - 1))) & ((1 << PART) - 1)) - (1 << (PART - 1))  # signed, at most 2**20
            parts.append(low.astype(np.float64))
            rest = (rest - low) >> PART
        for a, p in enumerate(parts):
            sums += p.sum(0).astype(np.int64).astype(object) * (1 << PART * a)
            for b, q in enumerate(parts):
                products += (p.T @ q).astype(np.int64).astype(object) * (1 << PART * (a + b))
    return sums, products


def _limbs(numbers: np.ndarray) -> np.ndarray:
    """Numbers as five limbs each, lowest first; all but the last are not negative."""
    out = np.zeros((len(numbers), 5), np.int64)
    for k in range(5):
        out[:, k] = numbers if k == 4 else numbers & ((1 << LIMB) - 1)
        numbers = numbers >> LIMB
    return out


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, limbs): for each length the task's number of vectors (-1, -1), sums (-1, j) and cross-products (i <= j)."""
    found: dict[int, list] = {}
    for batch in batches:
        for y in _unpacked(batch):
            d = y.shape[1]
            own = found.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            sums, products = scatter(y)
            own[0] += len(y)
            own[1] += sums
            own[2] += products
    for d, (n, sums, products) in found.items():
        i, j = np.triu_indices(d)
        limbs = _limbs(np.concatenate([np.array([n], object), sums, products[i, j]]))
        at = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
        yield pa.record_batch({"length": np.full(len(limbs), d, np.int32), "i": at[0].astype(np.int32), "j": at[1].astype(np.int32), **{f"l{k}": limbs[:, k] for k in range(5)}})


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(length, y): the distinct integer vectors as bytes, without the shift, staged."""
    packed = vectors.select(F.col(column).cast("array<double>").alias("v")).where("v is not null").mapInArrow(_vectors, "length int, y binary")
    return stage(packed.distinct(), "whitening-fit")


def fits(listed: DataFrame) -> dict[int, Fit]:
    """The fit of each length. Each task sends sums and cross-products, and the driver gets one matrix of d x d a length."""
    added = listed.mapInArrow(_scattered, "length int, i int, j int, l0 long, l1 long, l2 long, l3 long, l4 long").groupBy("length", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(5)])
    got = added.toArrow()
    value = sum((got[f"l{k}"].to_numpy().astype(object) * (1 << LIMB * k) for k in range(5)), np.zeros(got.num_rows, object))
    length, at_i, at_j = (got[c].to_numpy() for c in ("length", "i", "j"))
    out = {}
    for d in np.unique(length).tolist():
        own = length == d
        i, j, x = at_i[own], at_j[own], value[own]
        n = int(x[(i < 0) & (j < 0)][0])
        sums, m = np.zeros(d, object), np.zeros((d, d), object)
        one, two = (i < 0) & (j >= 0), i >= 0
        sums[j[one]] = x[one]
        m[i[two], j[two]] = x[two]
        m[j[two], i[two]] = x[two]
        exact = m * n - np.outer(sums, sums)
        v = (exact / (n * n)).astype(np.float64)
        e, vectors = np.linalg.eigh(v)
        out[d] = Fit(n, [int(s) for s in sums], e[::-1].copy(), vectors[:, ::-1].copy(), int(np.trace(exact)) / (n * n))
    return out


def _moments(batches: Iterator[pa.RecordBatch], fitted: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, s): the task's sums (-1, j) and cross-products of whitened vectors."""
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for y in _unpacked(batch):
            f = fitted[y.shape[1]]
            w = f.whitened(y)[:, f.firm[:MOST]]
            own = found.setdefault(y.shape[1], [np.zeros(w.shape[1]), np.zeros((w.shape[1],) * 2)])
            own[0] += w.sum(0)
            own[1] += w.T @ w
    for d, (sums, products) in found.items():
        k = len(sums)
        i, j = np.divmod(np.arange(k * k), max(k, 1))
        yield pa.record_batch(
            {"length": np.full(k + k * k, d, np.int32), "i": np.concatenate([np.full(k, -1), i]).astype(np.int32), "j": np.concatenate([np.arange(k), j]).astype(np.int32), "s": np.concatenate([sums, products.ravel()])}
        )


def identity_errors(listed: DataFrame, fitted: dict[int, Fit]) -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance, taken over the fit list, minus the identity."""
    got = listed.mapInArrow(lambda b: _moments(b, fitted), "length int, i int, j int, s double").groupBy("length", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    length, at_i, at_j, s = (got[c].to_numpy() for c in ("length", "i", "j", "s"))
    out = {}
    for d, f in fitted.items():
        own, k = length == d, int(f.firm[:MOST].sum())
        i, j, x = at_i[own], at_j[own], s[own] / f.n
        mean, cov = np.zeros(k), np.zeros((k, k))
        mean[j[i < 0]] = x[i < 0]
        cov[i[i >= 0], j[i >= 0]] = x[i >= 0]
        out[d] = float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return out


def _projected(batches: Iterator[pa.RecordBatch], fitted: dict[int, Fit], errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, y in integers(batch.column("v")):
            if not len(rows):
                continue
            d = y.shape[1]
            f, k = fitted[d], min(MOST, d)
            w = f.whitened(y).ravel()
            share = np.where(f.firm[:k], f.values[:k] / f.trace if f.trace else 0.0, 0.0)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
                    "n": np.full(len(w), f.n, np.int64), "deviation": pa.array(f.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    "whitened": pa.array(w, mask=np.isnan(w)), "explained": np.tile(share, len(rows)), "identity_error": np.full(len(w), errors[d]),
                }
            )


def whitening(vectors: DataFrame) -> DataFrame:
    """For each row of vectors(vec_id, embedding) and component up to 16: vec_id, component, n, deviation, whitened, explained, identity_error."""
    listed = fit_list(vectors)
    fitted = fits(listed)
    errors = identity_errors(listed, fitted)
    discard(listed)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    return own.mapInArrow(lambda b: _projected(b, fitted, errors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
