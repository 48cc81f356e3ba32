"""Byte-pair encoding by an index of pairs to all their places, and decoding, as a tokenizer file of the tokenizers library defines them.

Texts are normalised (NFC, white space as one separator, lower case by single characters) and cut into words: runs of
letters, single digits, runs of other signs, and the English contractions. All distinct words of a slice that the task
hasn't met before are laid out in one array of symbols, the last of each word with its end mark. The index maps every pair
that has a rank to all its places in that array. Active ranks are taken in ascending order: a rank's pair is merged at all
its places at once, from the left where places overlap, and only the lists of the pairs that this makes or ends are touched.
Merges come after those that make their parts (checked on loading), so new pairs always have later ranks and one ascending
pass gives what merging word by word gives.

Contract. Null texts count as empty and have no tokens. Special tokens are taken from the text as it stands, before it is
normalised. Texts of any length are whole: long ones are worked on in parts cut at spaces. Rows that repeat give
the same result each time. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import pair_blocks
from tessera.llm.text import U64, mix, slices

NAME = "word_bpe_49k.json"
#: What this module can follow; a file that says anything else is refused.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Second letters of the contractions of one and of two letters.
ONE, TWO = "stmd", ("re", "ve", "ll")
APOSTROPHE, DOTTED_I = 0x27, "İ"
SPACE, LETTER, DIGIT, SIGN, SPECIAL = range(5)
#: Special tokens stand in for themselves as code points that no text holds.
MARK = 0xD800
#: Characters of text that are worked on together, and words that a task remembers.
SLICE, WORDS = 1 << 21, 1 << 19
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, ranked merges and the classes of characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal, cuts = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in normal["normalizers"]]
        patterns = [x["pattern"]["Regex"] for x in cuts["pretokenizers"] if x["type"] == "Split"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if model["type"] != "BPE" or kinds != NORMALISERS or patterns != [PATTERN] or spec["decoder"] or not plain:
            raise ValueError(f"{path} describes another kind of tokenizer")
        end = model["end_of_word_suffix"]
        self.token = [""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.token[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.token[i] = token
        self.special_ids = np.array(list(self.special.values()), np.int32)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner = np.array([model["vocab"][c] for c in letters], np.int32)
        self.last = np.array([model["vocab"][c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.product = (np.array([model["vocab"][t] for t in ts], np.int32) for ts in (*zip(*pairs), [a + b for a, b in pairs]))
        made = np.full(len(self.token), -1)
        made[self.product] = np.arange(len(pairs))
        if len(np.unique(self.product)) < len(pairs) or (np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} merges tokens before they are made")
        key = self.left.astype(np.int64) << 32 | self.right
        self.rank = np.argsort(key).astype(np.int32)
        self.keys = key[self.rank]
        self._characters()

    def _characters(self) -> None:
        """Lower case and class of every code point, as the library has them."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) != DOTTED_I], np.uint32)
        text = points.tobytes().decode("utf-32-le")
        low = np.frombuffer(normalizers.Lowercase().normalize_str(text).encode("utf-32-le"), np.uint32)
        if len(low) != len(points):
            raise ValueError("lower case changes the number of characters")
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.lower[points] = low
        self.kind = np.full(0x110000, SIGN, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                self.kind[points[a:b]] = kind
        self.kind[MARK : MARK + len(self.special)] = SPECIAL
        self.nfc = normalizers.NFC()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], np.int32(-1))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str, v: Vocabulary) -> str:
    """The text as its words are cut from it, but for lower case; special tokens as marks."""
    if text.isascii() and "<|" not in text:
        return text

    def plain(t: str) -> str:
        t = t if t.isascii() or unicodedata.is_normalized("NFC", t) else v.nfc.normalize_str(t)
        return t.replace(DOTTED_I, "i̇")

    parts = v.specials.split(text)
    order = list(v.special)
    return "".join(chr(MARK + order.index(p)) if i % 2 else plain(p) for i, p in enumerate(parts))


def cut(points: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of texts that follow each other; off: the n + 1 offsets of the texts."""
    n = len(points)
    kind = np.append(v.kind[points], np.uint8(SPACE))
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:n] != kind[: n - 1]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    new |= edge
    new[:n] |= (kind[:n] == DIGIT) | (kind[:n] == SPECIAL)
    # A contraction begins where an apostrophe begins a word; its letters go with it.
    p = np.flatnonzero((points == APOSTROPHE) & new[:n])
    padded = np.append(points, np.zeros(2, points.dtype))
    one = np.isin(padded[p + 1], [ord(c) for c in ONE]) & ~edge[np.minimum(p + 1, n)]
    two = np.zeros(len(p), bool)
    for pair in TWO:
        two |= (padded[p + 1] == ord(pair[0])) & (padded[p + 2] == ord(pair[1]))
    two &= ~edge[np.minimum(p + 1, n)] & ~edge[np.minimum(p + 2, n)]
    for which, length in ((p[one], 1), (p[two], 2)):
        new[which + 1] = False
        new[which + 1 + length] = True
    start = np.flatnonzero(new[:n])
    end = np.append(start[1:], n)
    word = kind[start] != SPACE
    return start[word], end[word]


def merged(sym: np.ndarray, start: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of words given as symbols (start: the n + 1 offsets of the words), and their number in each word."""
    n = len(sym)
    sym = np.append(sym, np.int32(-1))  # place n stands for what lies beyond a word
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[start[1:] - 1], before[start[:-1]] = n, n
    after[n] = n
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(places: np.ndarray) -> None:
        rank = v.ranks(sym[places], sym[after[places]])
        places, rank = places[rank >= 0], rank[rank >= 0]
        if not len(places):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, own in zip(rank[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(own)

    enter(np.arange(n))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[r], v.right[r]
        q = after[p]
        whole = (sym[p] == a) & (sym[q] == b)
        p, q = p[whole], q[whole]
        if a == b and len(p) > 1:  # of places that overlap, every other one counts
            k = np.arange(len(p))
            first = np.append(True, q[:-1] != p[1:])
            even = (k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0
            p, q = p[even], q[even]
        if not len(p):
            continue
        beyond = after[q]
        sym[p], sym[q] = v.product[r], -1
        after[p], before[beyond] = beyond, p
        enter(np.concatenate([before[p], p]))
    alive = sym[:n] >= 0
    return sym[:n][alive], np.add.reduceat(alive, start[:-1]) if len(start) > 1 else np.zeros(0, np.int64)


class Encoder:
    """Encodes slices of texts; remembers the tokens of up to WORDS words by a 64-bit hash of their characters."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.power = self.inverse = np.ones(1, U64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, b in (("power", _BASE), ("inverse", _INVERSE)):
                x = np.full(n + n // 8, U64(b))
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' ids, and the n + 1 offsets of the texts' tokens among them."""
        v = self.v
        whole = [normalised(t, v) for t in texts]
        off = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
        points = v.lower[np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start, end = cut(points, off, v)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        self._grow(len(points) + 1)
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum((points.astype(U64) + U64(1)) * self.power[: len(points)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xBF58476D1CE4E5B9))
        words, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(words) > WORDS:
            self._forget()
        number = np.array(list(map(self.known.get, words.tolist())), dtype=float)
        new = np.isnan(number)
        if new.any():
            number[new] = len(self.known) + np.arange(int(new.sum()))
            self.known.update(zip(words[new].tolist(), number[new].astype(int).tolist(), strict=True))
            self._learn(points, start[first[new]], end[first[new]])
        w = number.astype(np.int64)[which]
        ids = self.ids[pair_blocks(self.begin[w], self.begin[w] + self.count[w])]
        at = np.concatenate([[0], np.cumsum(self.count[w])])
        return ids, at[np.searchsorted(start, off)]

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        v = self.v
        flat, size = points[pair_blocks(start, end)], end - start
        special = v.kind[points[start]] == SPECIAL
        data = np.where(v.kind[flat] == SPECIAL, ord("?"), flat).astype(np.uint32).tobytes().decode("utf-32-le").encode()
        width = 1 + (flat > 0x7F) + (flat > 0x7FF) + ((flat > 0xFFFF) & (flat < 0x110000))
        width[v.kind[flat] == SPECIAL] = 1
        at = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        raw = np.frombuffer(data, np.uint8)
        sym = v.inner[raw]
        sym[at[1:] - 1] = v.last[raw[at[1:] - 1]]
        ids, count = merged(sym, at, v)
        begin = np.cumsum(count) - count
        ids[begin[special]] = v.special_ids[points[start[special]] - MARK]
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])


def parts(text: str, most: int = SLICE) -> list[str]:
    """A long text cut before spaces that stand between ASCII characters, so that no word and no composed character is split."""
    out, i = [], 0
    while len(text) - i > most:
        j = i + most
        while (j := text.find(" ", j)) >= 0 and not (text[j - 1].isascii() and text[j + 1 : j + 2].isascii()):
            j += 1
        if j < 0:
            break
        out.append(text[i:j])
        i = j
    return [*out, text[i:]]


def decode(ids: list[int], v: Vocabulary) -> str:
    """The tokens of the ids, with a space between each two."""
    return " ".join(map(v.token.__getitem__, ids))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    encoder = Encoder(v)
    for batch in batches:
        text, doc = batch.column("text"), batch.column("doc_id")
        for i, j in slices(text, SLICE):
            texts = [t or "" for t in text[i:j].to_pylist()]
            if j - i == 1 and len(texts[0]) > SLICE:
                ids = np.concatenate([encoder.encode([p])[0] for p in parts(texts[0])])
                at = np.array([0, len(ids)])
            else:
                ids, at = encoder.encode(texts)
            listed = ids.tolist()
            decoded = [decode(listed[a:b], v) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": doc[i:j], "n_tokens": np.diff(at), "ids": pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), "decoded": pa.array(decoded, pa.string())})


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, ids, and the text that decoding the ids gives. path: a tokenizer file that all executors can read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = path or default_path()
    return own.mapInArrow(lambda b: _encoded(b, path), "doc_id long, n_tokens long, ids array<int>, decoded string")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        texts = [None if ids is None or any(i is None or not 0 <= i < len(v.token) for i in ids) else decode(ids, v) for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from rows of (doc_id, ids). Null ids, and lists that hold a null or an unknown id, give a null text."""
    path = path or default_path()
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, path), "doc_id long, text string")
