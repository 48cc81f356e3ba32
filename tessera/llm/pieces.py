"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The piece lattice of a text has an edge for every piece of the vocabulary that occurs in it; a character that no piece
spells has one edge, of its UTF-8 bytes as byte pieces. A segmentation's probability is proportional to the product of
its pieces' weights raised to ``alpha``, where the weight of a piece falls as 1 / (rank + 10) and a byte weighs as much as
the last rank. The forward pass sums the weights of all segmentations up to each position; the backward pass draws
pieces from the end, so a draw has exactly that probability. The draws are hashes of (seed, row key, position): the same
row gives the same pieces wherever and whenever it runs.

Spaces are written as U+2581 and so are never dropped or merged; a U+2581 of the text itself goes through byte pieces.
No piece has another character before U+2581, so texts are cut there into units that are filtered once per distinct unit.

Contract. Null texts count as empty and have no pieces. decode(encode(text)) equals the text, whatever it holds. Rows that
repeat a key and a text get the same pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import pair_blocks
from tessera.llm.text import U64, mix, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110001
LONG = 32
#: Positions of a longer unit that are worked on at once.
STEP = 1 << 16
#: Bytes of text encoded together: distinct units are fewer the more texts share them.
SLICE = 1 << 19
SLOT_BITS, TRIPLE_BITS = 19, 17
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _hashes(points: np.ndarray, power: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * power[: len(points)], out=sums[1:])
    return sums


def triples(points: np.ndarray) -> np.ndarray:
    """A small hash of every run of three characters."""
    p = points.astype(np.uint32)
    h = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA77) + p[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - TRIPLE_BITS)).astype(np.int64)


class Vocabulary:
    """Pieces of a SentencePiece model with their weights, found by the hash of a run of characters."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        first = 1 + max([i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)], default=-1)
        found = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                found.append((piece, i))
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.most = max(len(p) for p, _ in found)
        self.byte_weight = -alpha * np.log(n - first + 10.0)
        self.known = np.zeros(0x110002, bool)
        self.ids = np.array([i for _, i in found], np.int32)
        self.weight = -alpha * np.log(self.ids - first + 10.0)
        self.plain, self.lift = np.exp(self.weight), 300.0**alpha
        self.grow(64)
        self.hash = np.zeros(len(found), U64)
        for x, (piece, _) in enumerate(found):
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            self.hash[x] = self.key(_hashes(points, self.power)[-1:], np.array([len(points)]))[0]
            if len(points) == 1:
                self.known[points[0]] = True
        # Of runs of three characters, the lengths of the pieces that begin and end with them, as bits: what to look up at all.
        self.begins, self.ends = np.full(1 << TRIPLE_BITS, 6, np.uint32), np.full(1 << TRIPLE_BITS, 6, np.uint32)
        for piece, _ in found:
            if len(piece) >= 3:
                h = triples(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
                self.begins[h[0]] |= np.uint32(1 << len(piece))
                self.ends[h[-1]] |= np.uint32(1 << len(piece))
        slots = (self.hash & U64((1 << SLOT_BITS) - 1)).astype(np.int64)
        self.slot, self.after = np.full(1 << SLOT_BITS, -1, np.int32), np.full(len(found), -1, np.int32)
        for x, at in enumerate(slots.tolist()):
            self.after[x], self.slot[at] = self.slot[at], x

    def grow(self, n: int) -> None:
        for name, b in (("power", _BASE), ("inverse", _INVERSE)):
            x = np.full(n, U64(b))
            x[0] = 1
            setattr(self, name, np.cumprod(x, dtype=U64))

    @staticmethod
    def key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h * U64(0x9E3779B97F4A7C15) + n.astype(U64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        x = self.slot[(h & U64((1 << SLOT_BITS) - 1)).astype(np.int64)]
        open_ = np.flatnonzero(x >= 0)
        open_ = open_[self.hash[x[open_]] != h[open_]]
        while len(open_):
            x[open_] = self.after[x[open_]]
            open_ = open_[x[open_] >= 0]
            open_ = open_[self.hash[x[open_]] != h[open_]]
        return x


@lru_cache(maxsize=4)
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, spaces and U+2581 recoded, and the n + 1 offsets."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    literal = flat == SPACE
    flat[flat == 32] = SPACE
    flat[literal] = LITERAL
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _lattice(v: Vocabulary, masks: tuple[np.ndarray, np.ndarray], sums: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For units of one size, all of known characters: by unit, position and piece length the running sums of the weights of
    all segmentations that end there with a piece of that length or less, and the pieces' ids; and the sums by position.

    Pieces are looked up for all units and positions at once, one length after another, where some piece of that length
    begins and ends as the text does. Every character's weight is raised alike (``lift``), so that sums stay in range.
    """
    n, width = len(start), min(v.most, size)
    at = start[:, None] + np.arange(size + 1)
    first, last = masks[0][at], masks[1][at]
    ways, ids = np.zeros((n, size + 1, width)), np.zeros((n, size + 1, width), np.int32)
    for k in range(1, width + 1):
        unit, a = np.nonzero(first[:, : size - k + 1] & last[:, k:] & np.uint32(1 << k))
        c = start[unit] + a
        x = v.find(v.key((sums[c + k] - sums[c]) * v.inverse[c], np.full(1, k)))
        hit = np.flatnonzero(x >= 0)
        unit, a, x = unit[hit], a[hit], x[hit]
        ways[unit, a + k, k - 1] = v.plain[x] * v.lift**k
        ids[unit, a + k, k - 1] = v.ids[x]
    total = np.zeros((n, size + 1))
    total[:, 0] = 1
    for e in range(1, size + 1):
        w = min(e, width)
        np.cumsum(total[:, e - w : e][:, ::-1] * ways[:, e, :w], axis=1, out=ways[:, e, :w])
        total[:, e] = ways[:, e, w - 1]
    return ways, ids, total


def _uniform(seed: int, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = mix(mix(key + U64(seed)) + (at + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
    return (h >> U64(11)).astype(np.float64) / 2.0**53


def encode(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' ids, and the n + 1 offsets of the texts' pieces among them. keys: a 64-bit key for each text."""
    flat, off = _points(texts)
    n = len(flat)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    if len(v.power) < n + 1:
        v.grow(n + n // 8 + 1)
    sums = _hashes(flat, v.power)
    known = v.known[flat]
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    cut = row_start[:n].copy()
    cut[1:] |= (flat[1:] == SPACE) & (flat[:-1] != SPACE)
    cut[1:] |= ~known[1:] | ~known[:-1]
    unit = np.flatnonzero(cut)
    size = np.diff(np.append(unit, n))
    row = np.searchsorted(off, unit, "right") - 1
    plain = known[unit]
    chosen = np.full(n, -1, np.int32)
    h = v.key((sums[unit + size] - sums[unit]) * v.inverse[unit], size)
    short = plain & (size <= LONG)
    t = triples(flat) if n > 2 else np.zeros(0, np.int64)
    edge = np.full(3, 6, np.uint32)
    masks = np.concatenate([v.begins[t], edge]), np.concatenate([edge, v.ends[t], edge])
    for length in np.unique(size[short]).tolist():
        s = np.flatnonzero(short & (size == length))
        _, first, which = np.unique(h[s], return_index=True, return_inverse=True)
        ways, ids, total = _lattice(v, masks, sums, unit[s[first]], length)
        begin, pos, key = unit[s], size[s].copy(), keys[row[s]]
        origin = off[row[s]]
        while len(pos):
            draw = _uniform(seed, key, begin + pos - origin) * total[which, pos]
            width = ways.shape[2]
            # Sums never exceed the draw where no piece is longer than the position: these are 0 and counted off.
            k = (ways[which, pos] <= draw[:, None]).sum(1) - (width - np.minimum(pos, width))
            chosen[begin + pos - k - 1] = ids[which, pos, k]
            pos = pos - k - 1
            more = pos > 0
            which, begin, pos, key, origin = (x[more] for x in (which, begin, pos, key, origin))
    for u in np.flatnonzero(plain & (size > LONG)).tolist():
        _long(v, sums, int(unit[u]), int(size[u]), int(off[row[u]]), keys[row[u]], seed, chosen)
    spelt = np.flatnonzero(~known)
    point = flat[spelt]
    point = np.where(point == LITERAL, SPACE, point)
    length = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
    count = (chosen >= 0).astype(np.int64)
    count[spelt] = length
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.int32)
    whole = np.flatnonzero(chosen >= 0)
    out[at[whole]] = chosen[whole]
    for k in range(4):  # byte k of the characters that have one
        x = length > k
        c, n = point[x].astype(np.int64), length[x]
        lead = np.where(n == 1, c, (0xF00 >> n) & 0xFF | c >> 6 * (n - 1))
        out[at[spelt[x]] + k] = v.byte_id[lead if k == 0 else 0x80 | c >> 6 * (n - 1 - k) & 0x3F]
    return out, at[off]


def _long(v: Vocabulary, sums: np.ndarray, start: int, size: int, origin: int, key: np.uint64, seed: int, chosen: np.ndarray) -> None:
    """The same for one unit of any length: beside one number a character only a block of ``STEP`` positions is held."""

    def found(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For the positions after a up to b: the weights of the pieces of each length that end there, and their places in the vocabulary."""
        at = np.full((b - a, v.most), -1, np.int32)
        for k in range(1, min(v.most, b) + 1):
            end = np.arange(max(a + 1, k), b + 1)
            c = start + end - k
            at[end - a - 1, k - 1] = v.find(v.key((sums[c + k] - sums[c]) * v.inverse[c], np.full(1, k)))
        return np.where(at >= 0, v.weight[at], -np.inf), at

    alpha = np.full(size + 1, -np.inf)
    alpha[0] = 0
    for a in range(0, size, STEP):
        weight, _ = found(a, min(a + STEP, size))
        for end in range(a + 1, min(a + STEP, size) + 1):
            k = min(end, v.most)
            score = alpha[end - k : end][::-1] + weight[end - a - 1, :k]
            top = score.max()
            alpha[end] = top + np.log(np.exp(score - top).sum())
    pos = size
    for a in range((size - 1) // STEP * STEP, -1, -STEP):
        b = min(a + STEP, size)
        weight, at = found(a, b)
        draws = _uniform(seed, np.full(b - a, key), start - origin + np.arange(a + 1, b + 1))
        while pos > a:
            k = min(pos, v.most)
            p = np.cumsum(np.exp(alpha[pos - k : pos][::-1] + weight[pos - a - 1, :k] - alpha[pos]))
            k = min(int((p / p[-1] <= draws[pos - a - 1]).sum()), k - 1)
            chosen[start + pos - k - 1] = v.ids[at[pos - a - 1, k]]
            pos -= k + 1


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text that the pieces spell."""
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode()


def spelt_as(ids: np.ndarray, at: np.ndarray, column: pa.Array, v: Vocabulary) -> np.ndarray:
    """Whether each row's pieces, at[i] to at[i + 1] of ids, spell its text, byte by byte."""
    text, off = utf8(column)
    size = v.size[ids]
    begin = np.concatenate([[0], np.cumsum(size)])
    same = begin[at] == off
    if same.all():
        wrong = np.flatnonzero(v.flat[pair_blocks(v.first[ids], v.first[ids] + size)] != text)
        same = np.ones(len(at) - 1, bool)
        same[np.searchsorted(off, wrong, "right") - 1] = False
        return same
    return np.array([decode(ids[a:b].tolist(), v).encode() == text[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], off[:-1], off[1:], strict=True)])


def row_keys(column: pa.Array) -> np.ndarray:
    """64-bit keys of ids; null has one of its own."""
    ids = column.fill_null(0).to_numpy().view(U64)
    return mix(ids) ^ np.where(column.is_null().to_numpy(zero_copy_only=False), U64(0x5851F42D4C957F2D), U64(0))


def _encoded(batches: Iterator[pa.RecordBatch], model: str, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model, alpha)
    for batch in batches:
        text, doc = batch.column("text"), batch.column("doc_id")
        for i, j in slices(text, SLICE):
            texts = [t or "" for t in text[i:j].to_pylist()]
            ids, at = encode(texts, row_keys(doc[i:j]), v, seed)
            yield pa.record_batch(
                {
                    "doc_id": doc[i:j], "n_chars": np.array([len(t) for t in texts], np.int64), "n_pieces": np.diff(at),
                    "pieces": pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), "lossless": spelt_as(ids, at, text[i:j], v),
                }
            )


def encode_documents(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 20_240_229) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_chars, n_pieces, pieces, and whether decoding gave the text again."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(
        lambda b: _encoded(b, model, alpha, seed), "doc_id long, n_chars long, n_pieces long, pieces array<int>, lossless boolean"
    )


def _known(ids: list[int | None], v: Vocabulary) -> str | None:
    """The text of ids from outside; None if an id is null or unknown or the bytes are no text."""
    try:
        return decode(ids, v) if all(i is not None and 0 <= i < len(v.bytes_of) for i in ids) else None
    except UnicodeDecodeError:
        return None


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model, 1.0)
    for batch in batches:
        texts = [None if p is None else _known(p, v) for p in batch.column("pieces").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, pieces). Null pieces, null or unknown ids and bytes that are no UTF-8 give a null text."""
    return encoded.select("doc_id", "pieces").mapInArrow(lambda b: _decoded(b, model), "doc_id long, text string")
