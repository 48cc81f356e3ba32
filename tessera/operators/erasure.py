"""Erasure by containment: phrases that are kept as keyed digests only, found again wherever a text holds them as whole words.

A marker of an erased phrase has its length, a rolling hash whose base follows from a secret key, the hash of its first 2**k
characters (its anchor), and a keyed digest (HMAC-SHA256); the phrase itself isn't kept. A text is hashed once by prefix
sums. Windows that begin where a word begins are looked up by anchor in a bitmap of bounded size, those that it lets
through are hashed at each length that markers have and looked up in a second bitmap, and what is left, hardly more than
true hits, meets the markers in a join on length and rolling hash. The digest of the window then decides.

Texts and phrases are compared in lower case, with white space as single spaces and none at the ends. Characters of words are
letters, numbers and the underscore.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Characters of a text that are hashed together, beside the longest marker; phrases may have up to MOST.
PART, MOST = 1 << 20, 8_000
#: Windows that a task holds before it passes them on.
HELD = 20_000
#: A bitmap has eight bits a key, and 2**BITS (2 MiB) at most; with more keys it lets more through, and the join drops it.
BITS = 24


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def digest(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 of a text, lower-case hexadecimal, in functions of the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    within = F.unhex(F.sha2(F.concat(F.lit(inner), text.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), within), 256)


@dataclass(frozen=True)
class Roller:
    """Rolling hashes of all windows of texts, from prefix sums; odd numbers have inverses modulo 2**64."""

    base: int

    @staticmethod
    def of(key: bytes) -> Roller:
        return Roller(int.from_bytes(hmac.digest(key, b"rolling", "sha256")[:8], "big") | 1)

    def sums(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        power, inverse = _powers(self.base, n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((points.astype(U64) + U64(1)) * power[:n], out=sums[1:])
        return sums, inverse[: n + 1]


@lru_cache(maxsize=4)
def _grown(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(size, U64(b))
        x[0] = 1
        out.append(np.cumprod(x, dtype=U64))
    return out[0], out[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _grown(base, 1 << max(12, (n - 1).bit_length()))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point belongs to words."""
    return np.array([chr(c).isalnum() or c == 0x5F for c in range(0x110000)])


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _marked(batches: Iterator[pa.RecordBatch], roller: Roller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("phrase").to_pylist():
            points = points_of(text)
            size = 1 << (len(points).bit_length() - 1)
            sums, _ = roller.sums(points)
            rows.append((len(points), int(sums[len(points)].astype(np.int64)), size, int(sums[size].astype(np.int64))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        extra = {n: pa.array(c, t) for n, c, t in zip(("length", "rolling", "anchor_size", "anchor"), columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)}
        yield pa.record_batch({**{n: batch.column(n) for n in batch.schema.names}, **extra})


def markers(phrases: DataFrame, key: bytes, phrase: str = "phrase", substring: bool = True) -> DataFrame:
    """What is kept of erased phrases: the other columns, digest, length, rolling, anchor_size, anchor, substring. Each row once.

    Empty phrases and those above MOST characters erase nothing. substring: whether texts that hold more than the phrase count.
    """
    own = phrases.withColumn("phrase", normal(F.col(phrase)))
    own = own.where(F.char_length("phrase").between(1, MOST)).distinct()
    schema = own.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    hashed = own.mapInArrow(lambda b: _marked(b, Roller.of(key)), f"{schema}, length int, rolling long, anchor_size int, anchor long")
    return hashed.withColumns({"digest": digest(key, F.col("phrase")), "substring": F.lit(substring)}).drop("phrase")


def _bits(keys: DataFrame, first: str, second: str) -> np.ndarray:
    """A bitmap of pairs (a small number, a hash), combined where the markers are; 2 MiB reach the driver at most."""
    n = keys.count()
    bits = min(BITS, max(16, (8 * n).bit_length()))
    mixed = f"(({second} ^ shiftrightunsigned({second}, 29) ^ ({first} * 2654435761)) & {(1 << bits) - 1})"
    words = keys.select(F.expr(f"shiftright({mixed}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({mixed} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def _maybe(bits: np.ndarray, first: int, second: np.ndarray) -> np.ndarray:
    h = second.astype(U64)
    at = ((h ^ (h >> U64(29)) ^ U64(first * 2654435761)) & U64(len(bits) * 64 - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


@dataclass(frozen=True)
class Search:
    """What tasks need to find windows: bitmaps of anchors and of whole markers, and the lengths by size of the anchor."""

    roller: Roller
    anchors: np.ndarray
    wholes: np.ndarray
    lengths: dict[int, list[int]]

    def windows(self, text: str, begin: int = 0, limit: int | None = None) -> list[tuple[int, int, int]]:
        """(start, length, rolling) of what may be a marker, from whole word to whole word; starts from begin up to limit."""
        points = points_of(text)
        n = len(points)
        sums, inverse = self.roller.sums(points)
        inside = word_characters()[points]
        starts = np.flatnonzero(~np.concatenate([[False], inside[:-1]])) if n else np.zeros(0, np.int64)
        starts = starts[(starts >= begin) & (starts < (n if limit is None else limit))]
        free = np.append(~inside, True)  # a marker may end before such a place
        found = []
        for size, lengths in self.lengths.items():
            s = starts[starts + size <= n]
            s = s[_maybe(self.anchors, size, (sums[s + size] - sums[s]) * inverse[s])]
            for length in lengths if len(s) else ():
                own = s[s + length <= n]
                own = own[free[own + length]]
                h = (sums[own + length] - sums[own]) * inverse[own]
                hit = _maybe(self.wholes, length, h)
                found += [(a, length, b) for a, b in zip(own[hit].tolist(), h[hit].astype(np.int64).tolist(), strict=True)]
        return found


def _searched(batches: Iterator[pa.RecordBatch], search: Search, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each different window of a text that may be a marker, with the row's columns; whole: it is all of the text."""
    longest = max((x for own in search.lengths.values() for x in own), default=0)

    def passed(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        own = batch.select(names).take(pa.array(rows, pa.int64()))
        extra = {n: pa.array(c, t) for n, c, t in zip(("length", "rolling", "_window", "_whole"), columns, (pa.int32(), pa.int64(), pa.string(), pa.bool_()), strict=True)}
        return pa.record_batch({**{n: own.column(n) for n in names}, **extra})

    for batch in batches:
        rows, out = [], []
        for i, text in enumerate(batch.column("_text")):
            seen, text = set(), text.as_py()
            for a in range(0, max(len(text), 1), PART):  # a character before, and what the longest marker and its end need after
                lead = min(a, 1)
                part = text[a - lead : a + PART + longest + 1]
                for start, length, rolling in search.windows(part, lead, lead + PART):
                    if (length, rolling) not in seen:
                        seen.add((length, rolling))
                        rows.append(i)
                        out.append((length, rolling, part[start : start + length], length == len(text)))
                if len(out) >= HELD:
                    yield passed(batch, rows, out)
                    rows, out = [], []
        yield passed(batch, rows, out)


def hits(rows: DataFrame, known: DataFrame, key: bytes, ids: list[str], text: str, owner: str | None = None, moment: str | None = None) -> DataFrame:
    """(ids, digest) of the markers that each row's text holds, each once.

    owner: a column of rows and markers that must be equal. moment: a column of rows that must not be later than the marker's
    column of that name: what was written after an erasure stays. Null texts hold nothing.
    """
    names = [*ids, *([owner] if owner else []), *([moment] if moment else [])]
    lengths: dict[int, list[int]] = {}
    for x in known.select("anchor_size", "length").distinct().collect():  # MOST lengths at most
        lengths.setdefault(x[0], []).append(x[1])
    search = Search(Roller.of(key), _bits(known.select("anchor_size", "anchor"), "anchor_size", "anchor"), _bits(known.select("length", "rolling"), "length", "rolling"), {k: sorted(v) for k, v in lengths.items()})
    own = rows.select(*names, normal(F.col(text)).alias("_text"))
    schema = own.select(*names).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    found = own.mapInArrow(lambda b: _searched(b, search, names), f"{schema}, length int, rolling long, _window string, _whole boolean")
    other = known.select("length", "rolling", "digest", "substring", *[F.col(c).alias(f"_{c}") for c in (owner, moment) if c])
    both = found.join(other, ["length", "rolling"])
    true = (F.col("substring") | F.col("_whole")) & (digest(key, F.col("_window")) == F.col("digest"))
    if owner:
        true &= F.col(owner).eqNullSafe(F.col(f"_{owner}"))
    if moment:
        true &= F.col(moment) <= F.col(f"_{moment}")
    return both.where(true).select(*ids, "digest").distinct()


def without_contained(rows: DataFrame, known: DataFrame, key: bytes, ids: list[str], text: str, owner: str | None = None, moment: str | None = None) -> DataFrame:
    """Rows whose text holds no erased phrase; ids must name a row."""
    return rows.join(hits(rows, known, key, ids, text, owner, moment).select(*ids).distinct(), ids, "left_anti")
