"""Vectorised views of Arrow text columns: words, shingles and byte n-grams as 64-bit hashes.

A word is a longest run of ASCII letters, ASCII digits, underscores and characters outside ASCII. Texts are lowered by
Arrow's ``utf8_lower`` first. Null counts as the empty text. Hashes are polynomials over the UTF-8 bytes modulo 2**64
(prefix sums make every substring's hash two look-ups), finished by a bit mixer; they don't depend on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xBF58476D1CE4E5B9 | 1
SLICE_BYTES = 1 << 20

WORD = np.zeros(256, bool)
WORD[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"]] = True
WORD[128:] = True

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = n + n // 8
        for name, b in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, U64(b))
            x[0] = 1
            globals()[name] = np.cumprod(x, dtype=U64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes and 8,192 rows at most each; a longer text is a range of its own."""
    _, off = utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), i + 8192)
        yield i, j
        i = j


@dataclass
class Words:
    """Words in order. row: of the text or segment that holds each; first: where each row's words start (n + 1)."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences, times the inverse power at the start, are the hashes of substrings."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:-1], out=sums[1:])
    return sums, inverse


def words(buf: np.ndarray, off: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    n = len(off) - 1
    inside = WORD[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    before &= ~cut[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    total, inverse = sums or prefix(buf)
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * U64(_STEP))
    row = np.searchsorted(off, start, "right") - 1
    return Words(row, hashed, start, end, np.searchsorted(row, np.arange(n + 1)))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of k words. A row of 1 to k - 1 words has one run, of all of them."""
    n, power = len(w.hash), pow(_STEP, 3, 1 << 64)
    h = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        h = h * U64(power) + w.hash[j : j + len(h)]
    size = np.diff(w.first)
    whole = w.row[: len(h)] == w.row[k - 1 : k - 1 + len(h)]
    row, h = w.row[: len(h)][whole], h[whole]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        x = np.zeros(len(short), U64)
        for j in range(k - 1):
            more = size[short] > j
            x[more] = x[more] * U64(power) + w.hash[w.first[short[more]] + j]
        row, h = np.concatenate([row, short]), np.concatenate([h, x + size[short].astype(U64)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, mix(h)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of k words."""
    for i, j in slices(column):
        buf, off = utf8(column[i:j], lower=True)
        row, h = grams(words(buf, off), k)
        at = np.searchsorted(row, np.arange(j - i + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(h[a:b])


def brute_words(text: str | None) -> list[str]:
    """The same words as strings, for tests and small tables."""
    out, word = [], ""
    for c in pc.utf8_lower(pa.scalar(text or "")).as_py():
        if ord(c) > 127 or c.isalnum() or c == "_":
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out
