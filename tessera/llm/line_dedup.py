"""Line dedup by an exact set-similarity join of lines.

Contract. A text's lines are what newlines part. A line's tokens are its distinct words (``text.py``); lines of fewer than
``least`` tokens stay as they are. Lines are ordered by doc_id (null last), then line number, then a hash of their tokens,
then a hash of the document. A line is removed if an earlier line holds the same token set, or if an earlier first
occurrence of another token set has a Jaccard similarity of at least ``threshold`` with it, whether or not that line is
itself removed. What is left is joined by newlines again. Null and empty texts stay as they are. Rows that repeat both
doc_id and text count as one document and are cut alike. Clashing names of other columns don't matter: they pass through.
Words are compared by 32-bit hashes, token sets and documents by 64-bit ones.

Plan. One pass counts words over all texts in 2**20 hash buckets, an array of fixed size that orders tokens by rarity
(any total order gives exact results). The second pass sorts each line's tokens by rarity and keeps the prefix, the
positions and a signature of the set. Prefix tokens that occur once in all texts can't match and aren't sent. A token of
at least ``hot`` occurrences is refined: it is sent joined with each later token of the prefix one longer, since a pair
whose rarest common token is hot also shares its second-rarest common token there; from ``hot`` squared on, with two later
tokens of the prefix two longer. Lines meet under their keys and pass the length, positional and signature filters (all
are bounds: none loses a match). Rows travel in columnar blobs, one for each share of the keys, and each share is a task;
their number grows with the words counted. For each later line the few likest candidates are verified on full token sets
from a third pass; the rare lines that none of them removes and that have more candidates are compared with all lines
under their keys.

Hot groups. A task sends a line's place and prefix once for each token set, unless an earlier place of it turns up; later
places are copies for certain and are named at once, so a line that a third of all documents hold costs a row a task.
Under a refined key with more than ``crowd`` lines each line is compared with the ``PIVOTS`` earliest only, which settle a
group of near copies; lines that these don't remove are compared with all lines of the key, dealt over as many tasks as
the number of pairs asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bitmap, maybe, pair_blocks, sorted_groups
from tessera.llm.text import U64, mix, slices, utf8, words
from tessera.plans.staging import discard, release, stage

BITS = 20
HOT = 4096
CROWD, PIVOTS = 8192, 64
#: Ranks are logarithms of counts in steps of 2**(1/1024), which tell counts of any size apart in 16 bits.
STEPS = 1024
#: Sizes and positions from here on are only known to be at least so large, and pass the filters that need them.
CLIP = (1 << 16) - 1
#: How many candidates a line sends, by the share of the difference allowed that the likest one's signature shows: about
#: three fifths of the tokens that differ show, so up to .6 the likest nearly always verify. Lines of fewer than 8 or more
#: than 2048 tokens, whose signatures tell little, count as the last row.
SENT = ((0.15, 2), (0.4, 6), (0.6, 24), (float("inf"), 4096))
TELLING = (8, 2048)
#: Bytes of a share: the first figure up to 2,000 shares, then more, up to the second.
SHARE_BYTES = (24e6, 128e6)
#: Bytes of text worked on at once: the arrays made from them stay in a core's cache.
SLICE = 1 << 16
GATHERED, WORDS = 16, 200_000
_LINES = 60_000
_SLOTS = 1 << 17
_LIGHT = {"key": "<u8", "set": "<u8", "ord": "<i8", "line": "<i4", "n": "<u2", "pos": "<u2"}
_PLACES = {"set": "<u8", "ord": "<i8", "dk": "<i8", "line": "<i4"}
_COPIES = {"ord": "<i8", "dk": "<i8", "line": "<i4"}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        text = batch.column("text")
        for i, j in slices(text, SLICE):
            buf, off = utf8(text[i:j], lower=True)
            np.add.at(total, (words(buf, off).hash >> U64(32)).astype(np.int64) & ((1 << BITS) - 1), 1)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 100_000):
        yield pa.record_batch({"b": at[i : i + 100_000].astype(np.int32), "n": total[at[i : i + 100_000]]})


def word_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences in all texts for each bucket of word hashes."""
    got = texts.mapInArrow(_counted, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rarity of a bucket as 16 bits: 0 for at most one occurrence."""
    return (np.log2(np.maximum(counts, 1)) * STEPS).astype(np.uint16)


def sig_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the signature of a set of n tokens: at least two bits a token, and a power of two from 2 to 64."""
    return (1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 32)), 1, 6).astype(np.int64)).astype(np.int64)


def signatures(token: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures' words one after another, and where each begins (n + 1): a bit is set for each token."""
    width = sig_words(size)
    begin = np.concatenate([[0], np.cumsum(width)])
    word = np.repeat(begin[:-1], size) + ((token >> U64(6)) & (np.repeat(width, size) - 1).astype(U64)).astype(np.int64)
    out = np.zeros(begin[-1], U64)
    np.bitwise_or.at(out, word, U64(1) << (token & U64(63)))
    return out, begin


def apart(sig: np.ndarray, begin: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """For pairs of sets, i's not larger: a number of tokens by which they differ at least; counted on to the bound only.

    A signature twice as long is folded: a token's bit is its hash modulo the length.
    """
    out = np.zeros(len(i), np.int64)
    wide_i, wide_j = begin[i + 1] - begin[i], begin[j + 1] - begin[j]
    for w in np.unique(wide_i).tolist():
        live = np.flatnonzero(wide_i == w)
        for k in range(w):
            a, b = begin[i[live]] + k, begin[j[live]] + k
            out[live] += np.bitwise_count(sig[a] ^ (sig[b] | sig[np.where(wide_j[live] > w, b + w, b)]))
            if bound is not None:
                live = live[out[live] <= bound[live]]
    return out


class Blobs:
    """Columns gathered row by row and given out as one blob for each share."""

    def __init__(self, layout: dict[str, str], offset: int, rows: int = 150_000):
        self.layout, self.offset, self.rows, self.parts, self.n = layout, offset, rows, [], 0

    def add(self, share: np.ndarray, sig: np.ndarray | None = None, begin: np.ndarray | None = None, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """sig and begin: the rows' signatures, of ``sig_words`` of column n."""
        order = np.argsort(share.astype(np.uint16) if len(share) and share.max() < 1 << 16 else share, kind="stable")
        if sig is not None:
            sig = sig[pair_blocks(begin[:-1][order], begin[1:][order])]
        self.parts.append((share[order], [columns[c][order].astype(t) for c, t in self.layout.items()], sig))
        self.n += len(share)
        if self.n >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Parts are sorted by share already; a share's rows of all parts make one blob, columns first, then signatures."""
        if not self.n:
            return
        pieces: dict[int, list] = {}
        for share, columns, sig in self.parts:
            at = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(share) else np.zeros(0, np.int64)
            begin = np.concatenate([[0], np.cumsum(sig_words(columns[list(self.layout).index("n")]))]) if sig is not None else None
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(share)], strict=True):
                pieces.setdefault(int(share[a]), []).append([c[a:b] for c in columns] + ([sig[begin[a] : begin[b]]] if sig is not None else []))
        self.parts, self.n = [], 0
        keys = sorted(pieces)
        sizes = [sum(len(x[0]) for x in pieces[k]) for k in keys]
        data = [b"".join(b"".join(x.tobytes() for x in column) for column in zip(*pieces[k], strict=True)) for k in keys]
        yield pa.record_batch({"share": (np.array(keys) + self.offset).astype(np.int32), "n": np.array(sizes, np.int32), "data": pa.array(data, pa.binary())})


def unpacked(group: pa.Table, layout: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns of all blobs of a share."""
    parts: dict[str, list] = {c: [] for c in [*layout, "sig"]}
    for n, blob in zip(group["n"].to_pylist(), group["data"].combine_chunks(), strict=True):
        at, buffer = 0, blob.as_buffer()
        for c, t in layout.items():
            parts[c].append(np.frombuffer(buffer, t, n, at))
            at += n * np.dtype(t).itemsize
        parts["sig"].append(np.frombuffer(buffer, U64, (len(buffer) - at) // 8, at))
    return {c: np.concatenate(x) for c, x in parts.items()}


def _line_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word its line's index and hash; for every line with words its row and its number in the text."""
    w = words(buf, off)
    newlines = np.concatenate([[0], np.cumsum(buf == 10)])
    g = newlines[w.start]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (w.row[1:] != w.row[:-1])
    row = w.row[new]
    return np.cumsum(new) - 1, w.hash, row, (g[new] - newlines[off[row]]).astype(np.int32)


def _set_hash(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mix(token + U64(0x9E3779B97F4A7C15)), at) if len(at) else np.zeros(0, U64)


def _sorted_sets(line: np.ndarray, h: np.ndarray, rank: np.ndarray, least: int):
    """(lines, sizes, starts, ranks, tokens): distinct 32-bit tokens of each line of enough tokens, rarest first."""
    key = (line.astype(U64) << U64(48)) | (rank.astype(U64) << U64(32)) | (h >> U64(32))
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    own = (key >> U64(48)).astype(np.int64)
    size = np.bincount(own, minlength=int(line.max()) + 1 if len(line) else 0)
    kept = size[own] >= least
    key, own = key[kept], own[kept]
    lines = np.flatnonzero(size >= least)
    size = size[lines]
    return lines, size, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else np.zeros(0, np.int64), (key >> U64(32)) & U64(0xFFFF), key & U64(0xFFFFFFFF)


def _lines(batches: Iterator[pa.RecordBatch], least: int, rank: np.ndarray | None = None) -> Iterator[tuple]:
    """(sizes, starts, ranks, tokens, set hashes, rows' dk, rows' ord, line numbers) of some lines at a time.

    Words are found in slices that stay in a core's cache; lines of some slices are put together for the rest of the work.
    """
    held: list[tuple] = []
    n = 0

    def sets() -> Iterator[tuple]:
        line, h, dk, doc, number = (np.concatenate(c) for c in zip(*held, strict=True))
        for a in range(0, len(dk), _LINES):
            s, e = np.searchsorted(line, [a, a + _LINES])
            order = rank[(h[s:e] >> U64(32)).astype(np.int64) & ((1 << BITS) - 1)] if rank is not None else np.zeros(e - s, np.int64)
            lines, size, at, place, token = _sorted_sets(line[s:e] - a, h[s:e], order, least)
            if len(lines):
                x = a + lines
                yield size, at, place, token, _set_hash(token, at), dk[x], doc[x], number[x]

    for batch in batches:
        text = batch.column("text")
        keys = [batch.column(c).to_numpy() if c in batch.schema.names else np.zeros(batch.num_rows, np.int64) for c in ("dk", "ord")]
        for i, j in slices(text, SLICE):
            buf, off = utf8(text[i:j], lower=True)
            line, h, row, number = _line_tokens(buf, off)
            if len(row):
                held.append((line + n, h, keys[0][i + row], keys[1][i + row], number.astype(np.int64)))
                n += len(row)
            if sum(len(x[1]) for x in held) >= WORDS or len(held) >= GATHERED:
                yield from sets()
                held, n = [], 0
    if held:
        yield from sets()


class Seen:
    """A task's memory of token sets: of each slot's last set the earliest place."""

    def __init__(self) -> None:
        self.sets, self.places = np.zeros(_SLOTS, U64), np.zeros((3, _SLOTS), np.int64)
        self.used = np.zeros(_SLOTS, bool)

    def split(self, sets: np.ndarray, doc: np.ndarray, num: np.ndarray, dk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are to be sent, and which are certain copies: a line of the same set is known at an earlier place."""
        fresh, copy = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
        order = np.lexsort((dk, num, doc, sets))
        new = np.append(True, sets[order][1:] != sets[order][:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        copy[order] = (doc[order] != doc[first]) | (num[order] != num[first]) | (dk[order] != dk[first])
        x = order[new]
        slot = (sets[x] & U64(_SLOTS - 1)).astype(np.int64)
        a, b, c = self.places[:, slot]
        known = self.used[slot] & (self.sets[slot] == sets[x])
        sooner = (doc[x] < a) | ((doc[x] == a) & ((num[x] < b) | ((num[x] == b) & (dk[x] < c))))
        same = (doc[x] == a) & (num[x] == b) & (dk[x] == c)
        copy[x[known & ~sooner & ~same]] = True
        x, slot = x[~known | sooner], slot[~known | sooner]
        fresh[x] = True
        self.used[slot], self.sets[slot] = True, sets[x]
        self.places[:, slot] = doc[x], num[x], dk[x]
        return fresh, copy


def prefix_keys(size: np.ndarray, at: np.ndarray, rank: np.ndarray, token: np.ndarray, lines: np.ndarray, threshold: float, hot: int) -> tuple[np.ndarray, ...]:
    """(line, position of its rarest token, key, whether refined) of the keys of the chosen lines, by line."""
    owner = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(token)) - at[owner]
    length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    # A set so small that one token more or less falls below the threshold has no like but its copies, which its place finds.
    alone = ~(size >= threshold * (size + 1) - 1e-9)
    small = np.ceil(threshold / max(1 - threshold, 1e-9) - 1e-9)
    deepest = int(np.clip(np.ceil(threshold * small - 1e-9), 1, 3))  # tokens that every pair of different sets shares
    sent = (pos < length[owner]) & (rank > 0) & (lines & ~alone)[owner]
    step = np.log2(hot) * STEPS
    depth = np.minimum(1 + (rank >= step) + (rank >= 2 * step), deepest)
    x = np.flatnonzero(sent & (depth == 1))
    found = [(owner[x], pos[x], token[x], np.zeros(len(x), bool))]
    x = np.flatnonzero(sent & (depth > 1))
    if len(x):
        last = lambda t: np.minimum(length + t - 1, size) + at  # noqa: E731  ends of the prefix t - 1 longer
        end = last(2)[owner[x]]
        y, x = pair_blocks(x + 1, end), np.repeat(x, end - x - 1)
        two = depth[x] == 2
        found.append((owner[x[two]], pos[x[two]], mix((token[x[two]] << U64(32)) | token[y[two]]), np.ones(int(two.sum()), bool)))
        x, y = x[~two], y[~two]
        end = last(3)[owner[x]]
        z, x, y = pair_blocks(y + 1, end), np.repeat(x, end - y - 1), np.repeat(y, end - y - 1)
        found.append((owner[x], pos[x], mix(mix((token[x] << U64(32)) | token[y]) + token[z]), np.ones(len(x), bool)))
    o, p, k, refined = (np.concatenate(c) for c in zip(*found, strict=True))
    # The lowest bit of a key says whether it is refined.
    k = (k << U64(1)) | refined.astype(U64)
    if len(found) > 1:
        order = np.argsort(o, kind="stable")
        o, p, k = o[order], p[order], k[order]
    return o, p, k


def _prefixes(batches: Iterator[pa.RecordBatch], rank: np.ndarray, threshold: float, least: int, shares: tuple[int, int], hot: int) -> Iterator[pa.RecordBatch]:
    """Blobs of prefix rows, of first places and of certain copies."""
    a, b = shares
    light, firsts, copies = Blobs(_LIGHT, 0), Blobs(_PLACES, a), Blobs(_COPIES, a + b)
    seen = Seen()
    for size, at, order, token, sets, dk, doc, num in _lines(batches, least, rank):
        fresh, copy = seen.split(sets, doc, num, dk)
        if copy.any():
            yield from copies.add((dk[copy].view(U64) % U64(b)).astype(np.int64), ord=doc[copy], dk=dk[copy], line=num[copy])
        if not fresh.any():
            continue
        yield from firsts.add((sets[fresh] % U64(b)).astype(np.int64), set=sets[fresh], ord=doc[fresh], dk=dk[fresh], line=num[fresh])
        o, p, k = prefix_keys(size, at, order, token, fresh, threshold, hot)
        if not len(o):
            continue
        used = np.unique(o)
        sig, begin = signatures(token[pair_blocks(at[used], at[used] + size[used])], None, size[used])
        w = np.searchsorted(used, o)
        width = (begin[1:] - begin[:-1])[w]
        yield from light.add(
            (mix(k) % U64(a)).astype(np.int64), sig[pair_blocks(begin[w], begin[w] + width)], np.concatenate([[0], np.cumsum(width)]),
            key=k, set=sets[o], ord=doc[o], line=num[o], n=np.minimum(size[o], CLIP), pos=np.minimum(p, CLIP),
        )
    for blobs in (light, firsts, copies):
        yield from blobs.flush()


class Lists:
    """Rows with a list of tokens each, given out in batches of some size."""

    def __init__(self, tokens: int = 500_000):
        self.most, self.parts, self.n = tokens, [], 0

    def add(self, size: np.ndarray, tokens: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((size, tokens, columns))
        self.n += len(tokens)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            size, tokens = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            columns = {c: np.concatenate([p[2][c] for p in self.parts]) for c in self.parts[0][2]}
            starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.record_batch(columns | {"tokens": pa.ListArray.from_arrays(starts, pa.array(tokens.astype(np.uint32).view(np.int32)))})
        self.parts, self.n = [], 0


def _open_rows(batches: Iterator[pa.RecordBatch], rank: np.ndarray, threshold: float, least: int, hot: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, set, ord, line, tokens) of all lines under the wanted keys."""
    seen, out = Seen(), Lists()
    for size, at, order, token, sets, dk, doc, num in _lines(batches, least, rank):
        fresh, _ = seen.split(sets, doc, num, dk)
        o, _, k = prefix_keys(size, at, order, token, fresh, threshold, hot)
        asked = maybe(wanted, k)
        o, k = o[asked], k[asked]
        if len(o):
            x = pair_blocks(at[o], at[o] + size[o])
            yield from out.add(size[o], token[x], key=k.view(np.int64), set=sets[o].view(np.int64), ord=doc[o], line=num[o].astype(np.int32))
    yield from out.flush()


def _met(batches: Iterator[pa.RecordBatch], threshold: float, shares: tuple[int, int], tiers: tuple = SENT, crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """kind 0: a candidate (early) of set a, in b, with their key in dk; without b, none stands out in a crowd. kind 1: the
    first place of set a, its document's order in b. kind 2: a place of a copy."""
    for group in sorted_groups(batches, ["share"]):
        share = group["share"][0].as_py()
        if share < shares[0]:
            late, early, more, key, alone = _candidates(unpacked(group, _LIGHT), threshold, tiers, crowd)
            yield _row(0, len(late), a=late.view(np.int64), b=pa.array(early.view(np.int64), mask=alone), more=more, dk=key.view(np.int64))
        elif share < sum(shares):
            x = unpacked(group, _PLACES)
            order = np.lexsort((x["dk"], x["line"], x["ord"], x["set"]))
            sets, doc, dk, line = (x[c][order] for c in ("set", "ord", "dk", "line"))
            new = np.append(True, sets[1:] != sets[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = np.flatnonzero((doc != doc[first]) | (dk != dk[first]) | (line != line[first]))
            yield _row(1, int(new.sum()), a=sets[new].view(np.int64), b=doc[new], dk=dk[new], line=line[new])
            yield _row(2, len(copy), b=doc[copy], dk=dk[copy], line=line[copy])
        else:
            x = unpacked(group, _COPIES)
            yield _row(2, len(x["dk"]), b=x["ord"], dk=x["dk"], line=x["line"])


def _row(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    types = {"a": pa.int64(), "b": pa.int64(), "dk": pa.int64(), "line": pa.int32(), "more": pa.bool_()}
    return pa.record_batch({"kind": np.full(n, kind, np.int32)} | {c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()})


def _earliest(x: dict) -> dict:
    """Of the rows of one set under one key, sent by several tasks, only the earliest."""
    h = mix(x["key"] + x["set"] * U64(0x9E3779B97F4A7C15))
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return x
    at = np.searchsorted(twice, h)
    again = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == h)
    key, sets, doc, line = (x[c][again] for c in ("key", "set", "ord", "line"))
    order = np.lexsort((line, doc, sets, key))
    key, sets = key[order], sets[order]
    later = np.append(False, (key[1:] == key[:-1]) & (sets[1:] == sets[:-1]))
    kept = np.ones(len(h), bool)
    kept[again[order[later]]] = False
    begin = np.concatenate([[0], np.cumsum(sig_words(x["n"]))])
    sig = x["sig"][pair_blocks(begin[:-1][kept], begin[1:][kept])]
    return {c: v[kept] for c, v in x.items() if c != "sig"} | {"sig": sig}


def _candidates(x: dict, threshold: float, tiers: tuple = SENT, crowd: int = CROWD) -> tuple[np.ndarray, ...]:
    """For each line with earlier candidates under one key: as many of the likest as SENT says, whether there are more, the
    key, and whether it has none but stands in a crowd, where it wasn't compared with all."""
    slack = (1 - threshold) / (1 + threshold)
    x = _earliest(x)
    order = np.lexsort((x["n"], x["key"]))
    key, sets, doc, line = (x[c][order] for c in ("key", "set", "ord", "line"))
    begin = np.concatenate([[0], np.cumsum(sig_words(x["n"]))])
    sig = x["sig"][pair_blocks(begin[:-1][order], begin[1:][order])]
    n, pos = (x[c][order].astype(np.int64) for c in ("n", "pos"))
    begin = np.concatenate([[0], np.cumsum(sig_words(n))])
    first = np.append(True, key[1:] != key[:-1])
    bucket = np.cumsum(first) - 1
    scaled = bucket * (1 << 21) + n
    end = np.searchsorted(scaled, bucket * (1 << 21) + np.floor(n / threshold + 1e-9).astype(np.int64), "right")
    i0 = np.arange(len(key))
    members = np.bincount(bucket, minlength=1) if len(key) else np.zeros(0, np.int64)
    crowded = (members > crowd)[bucket] & (key & U64(1) == 1)
    end = np.where(crowded, i0 + 1, end)
    total = np.concatenate([[0], np.cumsum(end - i0 - 1)])
    # Most pairs differ too much in the first word of their signatures already.
    most = np.where(n == CLIP, np.inf, n * slack + 1e-6)
    wide = (begin[1:] - begin[:-1]).astype(np.uint8)
    lead = sig[begin[:-1]] if len(n) else sig
    folded = lead | sig[begin[:-1] + wide // 2] if len(n) else sig
    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a = 0
        while a < len(key):
            b = max(a + 1, int(np.searchsorted(total, total[a] + 700_000, "right")) - 1)
            yield np.repeat(i0[a:b], (end - i0 - 1)[a:b]), pair_blocks(i0[a:b] + 1, end[a:b])
            a = b
        for c in np.unique(bucket[crowded]).tolist():
            rows = np.flatnonzero(bucket == c)
            pivots = rows[np.lexsort((sets[rows], line[rows], doc[rows]))[:PIVOTS]]
            for p in range(0, len(rows), 700_000 // PIVOTS):
                i, j = (z.ravel() for z in np.meshgrid(pivots, rows[p : p + 700_000 // PIVOTS], indexing="ij"))
                # Each pair once, the smaller set first, if their sizes allow it.
                twice = np.isin(j, pivots) & (j <= i)
                i, j = np.minimum(i, j)[~twice], np.maximum(i, j)[~twice]
                near = (i != j) & (n[j] <= np.floor(n[i] / threshold + 1e-9))
                yield i[near], j[near]

    late, early, far = [], [], []
    for i, j in pairs():
        bound = most[i] + most[j]
        word = np.where(wide[i] == wide[j], lead[j], folded[j])
        ok = np.bitwise_count(lead[i] ^ word) <= bound
        i, j, bound = i[ok], j[ok], bound[ok]
        differ = apart(sig, begin, i, j, bound)
        ok = differ <= bound
        i, j, differ = i[ok], j[ok], differ[ok]
        needed = np.ceil((n[i] + n[j]) * threshold / (1 + threshold) - 1e-9)
        ok = (sets[i] != sets[j]) & ((1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= needed) | (n[j] == CLIP) | (pos[i] == CLIP) | (pos[j] == CLIP))
        i, j, differ = i[ok], j[ok], differ[ok]
        before = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & ((line[i] < line[j]) | ((line[i] == line[j]) & (sets[i].view(np.int64) < sets[j].view(np.int64)))))
        x, y = np.where(before, j, i), np.where(before, i, j)
        far_off = np.where((n[x] < TELLING[0]) | (n[x] > TELLING[1]), 1.0, 0.0) + differ / ((n[x] + n[y]) * slack)
        kept, _ = _likest(x, y, far_off, sets, 1, tiers)
        late.append(x[kept])
        early.append(y[kept])
        far.append(far_off[kept])
    late, early, far = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (late, early, far))
    kept, more = _likest(late, early, far, sets, 0, tiers)
    late, early = late[kept], early[kept]
    left = crowded.copy()
    left[late] = False
    left = np.flatnonzero(left)
    late, early, more = np.concatenate([late, left]), np.concatenate([early, left]), np.concatenate([more, np.ones(len(left), bool)])
    alone = np.append(np.zeros(len(late) - len(left), bool), np.ones(len(left), bool))
    return sets[late], sets[early], more | crowded[late], key[late], alone


def _likest(late: np.ndarray, early: np.ndarray, far: np.ndarray, sets: np.ndarray, extra: int, tiers: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the likest of each late line, as many as SENT says and ``extra``; whether the line has more."""
    if not len(late):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((sets[early], far, late))
    ordered = late[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.diff(np.append(at, len(order)))
    most = np.select([far[order[at]] <= share for share, _ in tiers], [count for _, count in tiers]) + extra
    place = np.arange(len(order)) - np.repeat(at, size)
    kept = place < np.repeat(most, size)
    return order[kept], np.repeat(size > most, size)[kept]


def _token_sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    sent, out = np.zeros(_SLOTS, U64), Lists()
    for size, at, _, token, sets, *_ in _lines(batches, least):
        slot = (sets & U64(_SLOTS - 1)).astype(np.int64)
        kept = maybe(wanted, sets) & (sent[slot] != sets)
        sent[slot[kept]] = sets[kept]
        if kept.any():
            yield from out.add(size[kept], token[pair_blocks(at[kept], at[kept] + size[kept])], set=sets[kept].view(np.int64))
    yield from out.flush()


def _alike(x: str, y: str, threshold: float):
    common = F.size(F.array_intersect(x, y))
    return common >= threshold * (F.size(x) + F.size(y) - common) - 1e-9


def _settled(docs: DataFrame, rest: DataFrame, found: DataFrame, rank, threshold: float, least: int, hot: int, side: int) -> DataFrame:
    """Of the sets in rest, those that any earlier set is similar to: all lines under their keys are compared in full.

    A key's lines, and those in question, are dealt into chunks of about ``side`` lines; each pair of chunks is a unit.
    """
    asked = stage(found.where("kind = 0 and more").join(rest, "a").select(F.col("a").alias("set"), F.col("dk").alias("key")).distinct(), "dedup-asked")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select("key").distinct(), "key"))
    rows = docs.mapInArrow(lambda b: _open_rows(b, rank.value, threshold, least, hot, wanted.value), "key long, set long, ord long, line int, tokens array<int>")
    rows = stage(rows.groupBy("key", "set").agg(F.min(F.struct("ord", "line")).alias("at"), F.any_value("tokens").alias("x")), "dedup-open")
    late = rows.join(asked, ["key", "set"])
    chunks = lambda n: F.ceil(F.col(n) / side).cast("int")
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).join(asked.groupBy("key").agg(F.count("*").alias("l")), "key").select("key", chunks("m").alias("m"), chunks("l").alias("l"))
    own = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    early = rows.join(sizes, "key").select("key", "set", "at", "x", own("m").alias("i"), each("l").alias("j"))
    late = late.join(sizes, "key").select("key", F.col("set").alias("a"), F.col("at").alias("late"), F.col("x").alias("y"), own("l").alias("j"), each("m").alias("i"))
    met = early.join(late, ["key", "i", "j"]).where("struct(at.ord, at.line, set) < struct(late.ord, late.line, a)")
    near = met.where((F.size("x") >= threshold * F.size("y")) & (F.size("y") >= threshold * F.size("x")))
    similar = stage(near.where(_alike("x", "y", threshold)).select("a").distinct(), "dedup-settled")
    discard(asked, rows)
    return similar


def removed_lines(
    docs: DataFrame, threshold: float = 0.8, least: int = 5, hot: int = HOT, tiers: tuple = SENT, crowd: int = CROWD, side: int = 2_000
) -> DataFrame:
    """(dk, ord, lines), staged: for each document with removed lines, their numbers from 0. docs: dk, ord and text."""
    spark = docs.sparkSession
    total = word_counts(docs.select("text"))
    size = total.sum() * (1 - threshold) * 48
    shares = 8 * max(1, int(np.ceil(size / np.clip(size / 2_000, *SHARE_BYTES) / 8)))
    shares = (shares, shares // 8)
    rank = spark.sparkContext.broadcast(ranks(total))
    sent = docs.mapInArrow(lambda b: _prefixes(b, rank.value, threshold, least, shares, hot), "share int, n int, data binary")
    found = stage(
        sent.repartitionById(shares[0] + 2 * shares[1], "share")
        .mapInArrow(lambda b: _met(b, threshold, shares, tiers, crowd), "kind int, a long, b long, dk long, line int, more boolean"),
        "dedup-found",
    )
    del sent
    release(spark)
    candidates = found.where("kind = 0")
    pairs = candidates.where("b is not null").groupBy("a", "b").agg(F.max("more").alias("more"))
    wanted = spark.sparkContext.broadcast(bitmap(candidates.where("b is not null").select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k"))
    sets = docs.select("text").mapInArrow(lambda b: _token_sets(b, wanted.value, least), "set long, tokens array<int>")
    sets = stage(sets.groupBy("set").agg(F.any_value("tokens").alias("tokens")), "dedup-sets")
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
    verified = both.select("a", "more", _alike("x", "y", threshold).alias("ok"))
    crowds = candidates.where("b is null").select("a", "more", F.lit(False).alias("ok"))
    checked = stage(verified.union(crowds).groupBy("a").agg(F.max("ok").alias("ok"), F.max("more").alias("more")), "dedup-checked")
    discard(sets)
    similar = checked.where("ok").select("a")
    rest = checked.where("not ok and more").select("a")
    if not rest.isEmpty():
        similar = similar.union(_settled(docs, rest, found, rank, threshold, least, hot, side))
    removed = found.where("kind = 2").select("dk", F.col("b").alias("ord"), "line")
    firsts = found.where("kind = 1").select("a", "dk", F.col("b").alias("ord"), "line")
    gone = removed.union(firsts.join(similar, "a").select("dk", "ord", "line"))
    gone = stage(gone.groupBy("dk", "ord").agg(F.collect_set("line").alias("lines")), "dedup-removed")
    discard(found, checked, similar)
    del pairs, both, verified, candidates, removed, firsts
    release(spark)
    return gone


def line_dedup(docs: DataFrame, threshold: float = 0.8, least: int = 5, **work) -> DataFrame:
    """docs with later similar lines cut from text, and _n_lines and _n_removed; all other columns pass through.

    ``hot``, ``tiers``, ``crowd`` and ``side`` only change how the work is done, never the result.
    """
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    order = F.coalesce(key, F.lit(2**63 - 1))
    dk = F.xxhash64(text, F.coalesce(key, F.lit(-1)), key.isNull())
    own = docs.select(dk.alias("dk"), order.alias("ord"), text.alias("text"))
    gone = removed_lines(own, threshold, least, **work).withColumnsRenamed({"dk": "_dk", "ord": "_ord", "lines": "_gone"})
    parts = F.split(text, "\n", -1)
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    # The removed lines grow with the documents, so they are never broadcast: the plan is the same at every size.
    joined = docs.withColumns({"_key": dk, "_at": order}).join(gone.hint("merge"), (F.col("_key") == F.col("_dk")) & (F.col("_at") == F.col("_ord")), "left")
    lines = F.when(text.isNull() | (text == ""), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return (
        joined.withColumn("_n_lines", lines.cast("long")).withColumn("_n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).drop("_key", "_at", "_dk", "_ord", "_gone")
    )


def lines_removed(docs: DataFrame, **settings) -> DataFrame:
    """docs with the columns it has: later similar lines are cut, and documents of which nothing is left are gone."""
    cut = line_dedup(docs, **settings)
    return cut.where("_n_removed = 0 or trim(both ' \\n\\t\\r' from text) <> ''").select(*docs.columns)
