"""Main text of web pages: structure, and the runs that a host repeats across its pages.

A page's html is cut into blocks of text (block-level tags and line breaks part them; character references are decoded,
white space becomes one space). Blocks inside scripts, styles, navigation, headers and footers of the page, sidebars,
forms, or elements whose class, id or role names an advert, notice, menu or comment are never main text. If the page marks its
article (``article``, else ``main`` or role main), the blocks inside it are candidates for the text, in page order.

Host suffix array. The token streams of a host's pages are put end to end, and their suffixes are brought into the order of their
tokens by a distributed sort. Neighbours in it have their longest common prefix; suffixes that agree on more than their neighbours do form an
interval, which is a repeated substring with its exact length, and its pages are counted there (``suffix_order``). Three things keep it
in bounds without changing what it finds. Suffixes are first counted by their first ``run`` tokens, a bucket of the order, and
only buckets with enough pages are sorted, as a repeat of that length can't begin in another. Suffixes are ordered by ``REST`` tokens
beyond these: of a longer repeat every suffix is in the order too, so they cover all of it. A page counts once in each interval, by the common
prefix with its own last suffix, so counts are sums, which meet over the borders of partitions: no host and no bucket is held in
one task. A token is covered if the repeat at a suffix before it reaches it; unique runs stay in order. Every page is read this way:

- Pages that mark no article: every suffix. A repeat of ``run`` tokens or more is boilerplate if at least ``OPEN_PAGES`` pages and half
  of the host's pages hold it; the tokens it covers are removed. Pages whose texts agree in three least
  hashes of their windows are copies and count once, so an article under several addresses stays on each, and so do
  quotations. A page that would lose all it has stays whole. Before that, three or more blocks in a row that are mostly links
  go: a menu without a name.
- Pages that mark one: the suffixes of the first two and last two blocks of the article, where mastheads and calls to subscribe
  stand, and of what stands outside it. They are a sparse suffix array: of every ``WINNOW`` neighbours the one whose first
  ``EDGE_RUN`` tokens have the least hash, which keeps
  one of each repeated run of ``EDGE_RUN + WINNOW - 1`` tokens; a shorter block is a suffix of its own. A repeat is
  boilerplate if at least ``EDGE_PAGES`` pages and a fifth of the host's pages hold it at such a place, or outside the
  article, while their articles differ and no other host's pages hold its first tokens; a block that such repeats cover by half or more is
  removed. Pages whose articles have the same least hash of all windows count once, and repeats whose pages are mostly
  such copies count for nothing, so copied, quoted and near-copied articles and sentences in general use stay whole.

Contract. Null html counts as empty and gives an empty text. Html is read whole and never fails: unclosed tags close at
the end of the page, an unclosed comment, script or style runs to the end. Rows that repeat a page_id are pages of their own
only if their html or url differs; repeated rows get equal texts and don't make each other's text a repeat. A null url or
host groups with no other page; a host in brackets is read to the closing one. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bitmap, maybe
from tessera.llm.text import U64, mix
from tessera.plans.staging import stage

RUN = 6
#: Tokens beyond a suffix's first ones by which it is ordered; no fewer than WINNOW, so that sampled suffixes leave no gap in a repeat.
REST = 6
#: Differing pages, and their share of the host's, that make a run boilerplate on pages that mark no article.
OPEN_PAGES, OPEN_SHARE = 3, 0.5
#: Blocks in a row, and the share of their characters within links, that make a menu.
LINKS, LINKED = 3, 0.8
#: How staged texts and suffixes are written.
ZSTD = {"compression": "zstd"}
#: Places that a host's pages are dealt over where they meet its runs.
SALTS = 16
#: Blocks at each edge of an article, tokens of their windows, and neighbours of which one window is kept.
EDGE, EDGE_RUN, WINNOW = 2, 6, 6
#: Pages, and their share of the host's, that make a run boilerplate; the share of them whose articles must differ.
EDGE_PAGES, EDGE_SHARE, EDGE_DIFFER = 5, 0.2, 0.5

# HTML element names by their part in a page.
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg canvas iframe object textarea title xmp noembed noframes video audio select".split())
APART = set("nav aside footer form button dialog menu head search".split())
#: Words of class, id and role values that mark what is no main text.
MARKS = set(
    "ad ads adv advert advertisement advertising adbox adslot adsense banner banners sponsor sponsored promo promotion promos nav navbar navigation menu menus "
    "sidebar sidebars side aside footer header masthead breadcrumb breadcrumbs comment comments disqus reply replies respond cookie cookies consent gdpr notice "
    "notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets pagination pager toolbar skip search complementary contentinfo navigation".split()
)
#: Words that may stand beside those in a class of an article's element: "related-posts" is apart, "related-work" isn't.
COMPANIONS = set("area bar block box button buttons container content form inner item items label link links list panel posts reader section slot stories text title unit user wrap wrapper".split())
#: First words of class names that tell of a page's state and name no part of it: "has-sidebar".
STATES = set("has have with without no not is show hide js".split())
#: Elements of an article whose id is an anchor and names no part of the page.
ANCHORS = set("a article blockquote dd dt figure h1 h2 h3 h4 h5 h6 li main p section table".split())
IMPLIED_END = {
    "p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"


def _marked(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether class, id or role names something apart from the main text (an article's own header is not), whether the
    element is hidden, and whether its role is main."""
    if not attributes.strip():
        return False, False, False
    apart = main = hidden = False
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        value, kind = a or b or c, kind.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value.strip().lower() == "true") or (kind == "style" and UNSEEN.search(value)):
            hidden = True
        if kind not in ("class", "id", "role"):
            continue
        if kind == "role" and value.strip().lower() == "main":
            main = True
        if kind == "id" and in_article and name in ANCHORS:
            continue
        for one in value.split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()) if len(w) > 1]
            if not words or words[0] in STATES:
                continue
            if in_article:  # a single word within a name says little there: all of them must fit
                apart |= words[0] != "section" and set(words) <= MARKS - {"header", "side"} | COMPANIONS and not (MARKS - {"header", "side"}).isdisjoint(words)
            else:
                apart |= not MARKS.isdisjoint(words)
    return apart, hidden, main


#: How a block stands apart from the main text: by a class of an element around its article, or in any other way.
SOFT, HARD = 1, 2
#: End tags of other elements don't close these.
WALLS = ("article", "main", "body", "html")


class Open:
    """The open elements: (name, apart, level). Names are counted between walls, so that a stray end tag costs nothing."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.frames: list[Counter[str]] = [Counter()]
        self.walls: Counter[str] = Counter()

    def push(self, name: str, apart: int, level: int) -> None:
        self.stack.append((name, apart, level))
        if name in WALLS:
            self.walls[name] += 1
            self.frames.append(Counter())
        else:
            self.frames[-1][name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if name in WALLS:
            self.walls[name] -= 1
            self.frames.pop()
        else:
            self.frames[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        if (self.walls if name in WALLS else self.frames[-1])[name]:
            while self.pop() != name:
                pass

    def state(self) -> tuple[int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0)


def blocks(page: str | None) -> list[tuple[str, int, int, bool]]:
    """(text, level, apart, linked) of every block that isn't empty. level: 2 in an article, 1 in a main element, else 0; apart: 0 if not; linked: mostly links."""
    out: list[tuple[str, int, int, bool]] = []
    opened = Open()
    text: list[str] = []
    apart, level, linked = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            if whole := " ".join("".join(text).split()):
                out.append((whole, level, apart, linked >= LINKED * len(whole)))
            text.clear()
            linked = 0

    source, at = page or "", 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            if source[m.start()] != "<" or m.end() == m.start() + 1:
                text.append(entities.unescape(m.group()))
                if opened.frames[-1]["a"]:
                    linked += len(" ".join(text[-1].split()))
            elif m.group().startswith("<![CDATA["):
                text.append(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK or name in RAW:
                close()
            opened.close(name)
            apart, level = opened.state()
            continue
        if name in RAW:
            if name in ("title", "textarea", "select", "iframe", "video", "audio", "object"):
                close()
            if not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in BLOCK:
            close()
            while opened.stack and name in IMPLIED_END.get(opened.stack[-1][0], ()):
                opened.pop()
            apart, level = opened.state()
        if name in VOID:
            continue
        named, hidden, main = _marked(name, m.group(3), level == 2) if name not in ("html", "body") else (False, False, False)
        inside = 2 if name == "article" else 1 if name == "main" or main else 0
        own = SOFT if named else 0
        if name in APART or hidden or (name == "header" and level < 2) or (named and (level or inside)):
            own = HARD
        opened.push(name, max(apart, own), max(level, inside))
        apart, level = opened.state()
    close()
    return out


def unlinked(found: list[tuple[str, bool]]) -> list[str]:
    """The blocks without runs of LINKS or more that are mostly links."""
    out: list[str] = []
    for linked, run in groupby(found, key=lambda x: x[1]):
        own = [t for t, _ in run]
        if not linked or len(own) < LINKS:
            out += own
    return out


def chosen(found: list[tuple[str, int, int, bool]]) -> tuple[list[str], bool]:
    """The blocks that may be main text, and whether the page marks them itself.

    An article that only a class of an element around it sets apart counts if no other is marked and it is longer than the rest.
    """
    for level in (2, 1):
        inside = [t for t, at, apart, _ in found if at >= level and not apart]
        if inside:
            return inside, True
    rest = unlinked([(t, linked) for t, _, apart, linked in found if not apart])
    wrapped = [t for t, at, apart, _ in found if at and apart == SOFT]
    if sum(map(len, wrapped)) > sum(map(len, rest)):
        return wrapped, True
    return rest, False


def edges(kept: list[str]) -> tuple[list[str], list[str]]:
    """The first and the last blocks of an article that keeps at least one block between them."""
    n = min(EDGE, max(0, (len(kept) - 1) // 2))
    return kept[:n], kept[len(kept) - n :]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            text, open_, other, head, tail, sketch = [], [], [], [], [], np.zeros(part.num_rows, np.int32)
            for r, page in enumerate(part.column("html").to_pylist()):
                found = blocks(page)
                kept, marked = chosen(found)
                text.append(" ".join(kept))
                open_.append(not marked and bool(kept))
                other.append("" if not marked and kept else " ".join(t for t, level, apart, _ in found if apart or not level))
                first, last = edges(kept) if marked else ([], [])
                head.append(list(map(len, first)))
                tail.append(list(map(len, last)))
                if kept:
                    w = windows(text[-1], EDGE_RUN)
                    w = w if len(w) else windows(text[-1], 1)
                    least = int(w.min()) if marked else sum(int(mix(w + U64(k)).min()) * (2 * k + 1) for k in range(3))
                    sketch[r] = np.int32((least & 0xFFFFFFFF) - (1 << 31))
            yield pa.record_batch(
                {c: part.column(c) for c in ("page_id", "url", "host")}
                | {"text": pa.array(text, pa.string()), "open": open_, "other": pa.array(other, pa.string()), "head": pa.array(head, pa.list_(pa.int32())), "tail": pa.array(tail, pa.list_(pa.int32())), "sketch": sketch}
            )


def windows(text: str, run: int) -> np.ndarray:
    """Hashes of the runs of ``run`` tokens that start at each token."""
    return _runs(token_hashes(text), run)


def token_hashes(text: str) -> np.ndarray:
    return np.array([hash_token(t) for t in text.split(" ")], U64) if text else np.zeros(0, U64)


def _runs(h: np.ndarray, run: int) -> np.ndarray:
    n = len(h) - run + 1
    if n < 1:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(run):
        out = out * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


def hash_token(t: str) -> int:
    """The same in every process."""
    raw = t.encode()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _rest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The REST tokens from each place on, 4 bytes each that compare as bytes; zeros follow the last token."""
    codes = np.concatenate([np.maximum(h >> U64(32), U64(1)), np.zeros(REST, U64)]).astype(">u4")
    return codes[np.minimum(at.astype(np.int64), len(h))[:, None] + np.arange(REST)]


def _binary(rest: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    ends = np.arange(len(rest) + 1, dtype=np.int32) * (4 * REST)
    return pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(ends), pa.py_buffer(rest.astype(">u4").tobytes())])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hk, key, prefix, pages, n) of the intervals of suffixes that come in order, by the common prefixes of neighbours.

    An interval is told at its full depth and, whole buckets, at depth 0; one at an end of the batch, which may hold it in part, at every depth, so
    that parts add up by their prefix.
    """
    for b in batches:
        if not b.num_rows:
            continue
        hk, key, own, pages, n = (b.column(c).to_numpy() for c in ("hk", "key", "own", "pages", "n"))
        raw = b.column("rest").to_pylist()
        rest = np.frombuffer(b"".join(raw), ">u4").reshape(-1, REST)
        common = np.full(len(raw), -1)
        alike = (hk[1:] == hk[:-1]) & (key[1:] == key[:-1])
        common[1:][alike] = np.cumprod(rest[1:][alike] == rest[:-1][alike], 1).sum(1)
        found, deeper = [], np.zeros((0, 2), np.int64)
        for depth in range(REST, -1, -1):
            first = np.flatnonzero(common < depth)
            span = np.column_stack([first, np.append(first[1:], len(raw))])
            held, total = np.add.reduceat(np.where(own < depth, pages, 0), first), np.add.reduceat(n, first)
            ends = (span[:, 0] == 0) | (span[:, 1] == len(raw))
            told = np.isin(span @ [len(raw) + 1, 1], deeper @ [len(raw) + 1, 1])
            for i in np.flatnonzero(ends | ((held > 1) & (~told if depth else True))).tolist():
                found.append((first[i], raw[first[i]][: 4 * depth], held[i], total[i]))
            deeper = span
        at = np.array([x[0] for x in found])
        yield pa.record_batch(
            {"hk": hk[at], "key": key[at], "prefix": pa.array([x[1] for x in found], pa.binary()), "pages": np.array([x[2] for x in found], np.int64), "n": np.array([x[3] for x in found], np.int64)}
        )


def suffix_order(suffixes: DataFrame, least: DataFrame, differ: float = 0) -> DataFrame:
    """(hk, key, prefix) of the repeats that at least ``least`` of a host's pages hold: the host suffix array, read by intervals.

    suffixes: (hk, key, rest, sketch) with the hash of a suffix's first tokens and the tokens after them, rows of one sketch counting
    as one page; least: (hk, least). A repeat is its key and the first tokens of rest. Those beyond a key are told only if their
    pages are ``differ`` of the suffixes that begin so.
    """
    same = sum((F.substring("rest", 1, 4 * k) == F.substring("before", 1, 4 * k)).cast("int") for k in range(1, REST + 1))
    rows = suffixes.groupBy("hk", "key", "sketch", "rest").agg(F.count("*").alias("n"))
    rows = rows.withColumn("before", F.lag("rest").over(Window.partitionBy("hk", "key", "sketch").orderBy("rest")))
    rows = rows.groupBy("hk", "key", "rest", F.coalesce(same, F.lit(-1)).alias("own")).agg(F.count("*").alias("pages"), F.sum("n").alias("n"))
    order = rows.repartitionByRange("hk", "key", "rest").sortWithinPartitions("hk", "key", "rest")
    found = order.mapInArrow(_intervals, "hk long, key long, prefix binary, pages long, n long").groupBy("hk", "key", "prefix").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
    return found.join(least, "hk").where((F.col("pages") >= F.col("least")) & ((F.length("prefix") == 0) | (F.col("pages") >= differ * F.col("n")))).select("hk", "key", "prefix")


def _reach(key: int, rest: bytes, known: dict[int, list[bytes]]) -> int:
    """Tokens beyond the first ones that the longest repeat at a suffix holds."""
    return max((len(p) // 4 for p in known[key] if rest.startswith(p)), default=0)


def _known(repeated: list[dict]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for x in repeated:
        out.setdefault(x["key"] & 0xFFFFFFFFFFFFFFFF, []).append(x["prefix"])
    return out


def _suffixes(batches: Iterator[pa.RecordBatch], run: int, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(hk, key, sketch) for the buckets that a stream's suffixes begin in; with wanted also rest, a row for each suffix under the wanted keys."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            keys, rests, size = [], [], []
            for text in part.column("stream").to_pylist():
                h = token_hashes(text)
                w = _runs(h, run)
                if wanted is None:
                    w = np.unique(w)
                else:
                    at = np.flatnonzero(maybe(wanted, w))
                    w = w[at]
                    rests.append(_rest(h, at + run))
                keys.append(w)
                size.append(len(w))
            at = pa.array(np.repeat(np.arange(part.num_rows), size))
            out = {"hk": part.column("hk").take(at), "key": np.concatenate(keys).view(np.int64), "sketch": part.column("sketch").take(at)}
            yield pa.record_batch(out if wanted is None else out | {"rest": _binary(np.concatenate(rests))})


def _uncovered(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, repeated in zip(b.column("text").to_pylist(), b.column("repeated").to_pylist(), strict=True):
            h = token_hashes(text)
            w = _runs(h, run)
            if repeated and len(w):
                tokens, known = text.split(" "), _known(repeated)
                starts = np.flatnonzero(np.isin(w, np.array(list(known), U64)))
                rest = _rest(h, starts + run)
                covered = np.zeros(len(tokens) + 1, np.int64)
                for start, key, r in zip(starts.tolist(), w[starts].tolist(), rest, strict=True):
                    covered[start] += 1
                    covered[min(start + run + _reach(key, r.tobytes(), known), len(tokens))] -= 1
                kept = np.cumsum(covered[:-1]) == 0
                if kept.any():
                    text = " ".join(t for t, k in zip(tokens, kept, strict=True) if k)
            out.append(text)
        yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(out, pa.string())})


def edge_suffixes(block: str) -> tuple[np.ndarray, np.ndarray]:
    """The sampled suffixes of a block's tokens: (start, end of the first tokens, their hash) rows, and the tokens after them."""
    h = token_hashes(block)
    w = _runs(h, EDGE_RUN)
    if len(w) < WINNOW:
        rows = np.array([(0, len(h), _runs(h, len(h))[0])], U64)
    else:
        least = np.lib.stride_tricks.sliding_window_view(w, WINNOW)
        at = np.unique(least.argmin(1) + np.arange(len(least)))
        rows = np.stack([at.astype(U64), (at + EDGE_RUN).astype(U64), w[at]], 1)
    return rows, _rest(h, rows[:, 1])


def _places(head: list[str], tail: list[str], other: str | None) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(side, block, suffixes with keys, their rests) for the blocks of both edges; what stands outside the article, last of a side, counts on both."""
    out = []
    beside = edge_suffixes(other) if other else None
    for side, texts in enumerate((head, tail)):
        for block, (w, rest) in [*((t, edge_suffixes(t)) for t in texts), *([(other, beside)] if beside else [])]:
            out.append((side, block, np.column_stack([w[:, :2], mix(w[:, 2] + U64(side + 1))]), rest))
    return out


def _cut_edges(text: str, head: list[int], tail: list[int]) -> tuple[list[str], str, list[str]]:
    """An article's first blocks, the text between, and its last blocks."""
    first, last, a, b = [], [], 0, len(text)
    for n in head:
        first.append(text[a : a + n])
        a += n + 1
    for n in reversed(tail):
        last.insert(0, text[b - n : b])
        b -= n + 1
    return first, text[a:b], last


def _edge_rows(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(hk, key, sketch) for the buckets that the suffixes of a page's edges begin in; with wanted also rest, page and whether the suffix is in
    the article, a row for each suffix under the wanted keys."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("text", "head", "tail", "other")]
        keys, rests, edge, size = [], [], [], []
        for text, head, tail, other in zip(*cols, strict=True):
            first, _, last = _cut_edges(text, head, tail)
            found = _places(first, last, other)
            k = np.concatenate([x[2][:, 2] for x in found]) if found else np.zeros(0, U64)
            if wanted is None:
                k = np.unique(k)
            elif found:
                at = np.flatnonzero(maybe(wanted, k))
                rest = np.concatenate([x[3] for x in found])[at]
                # Of equal suffixes of a page one is kept, one of the article's if there is any.
                inside = np.repeat([x[1] is not other for x in found], [len(x[2]) for x in found])[at]
                front = np.argsort(~inside, kind="stable")
                _, once = np.unique(np.column_stack([k[at][front], rest[front].astype(U64)]), axis=0, return_index=True)
                at, rest, inside = at[front][once], rest[front][once], inside[front][once]
                k = k[at]
                rests.append(rest)
                edge.append(inside)
            keys.append(k)
            size.append(len(k))
        at = pa.array(np.repeat(np.arange(b.num_rows), size))
        out = {"hk": b.column("hk").take(at), "key": (np.concatenate(keys) if keys else np.zeros(0, U64)).view(np.int64), "sketch": b.column("sketch").take(at)}
        if wanted is not None:
            rest = np.concatenate(rests) if rests else np.zeros((0, REST), ">u4")
            out |= {"rest": _binary(rest), "page": b.column("page").take(at), "edge": np.concatenate(edge) if edge else np.zeros(0, bool)}
        yield pa.record_batch(out)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, head, tail, repeated in zip(*(b.column(c).to_pylist() for c in ("text", "head", "tail", "repeated")), strict=True):
            if repeated:
                first, middle, last = _cut_edges(text, head, tail)
                known = _known(repeated)
                kept: list[list[str]] = [[], []]
                for side, block, rows, rest in _places(first, last, None):
                    n = block.count(" ") + 1
                    covered = np.zeros(n + 1, np.int64)
                    for (start, end, key), r in zip(rows.tolist(), rest, strict=True):
                        if key in known:
                            covered[start] += 1
                            covered[min(end + _reach(key, r.tobytes(), known), n)] -= 1
                    if 2 * (np.cumsum(covered[:-1]) > 0).sum() < n:
                        kept[side].append(block)
                text = " ".join([*kept[0], *([middle] if middle else []), *kept[1]])
            out.append(text)
        yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(out, pa.string())})


def _without_edges(marked: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages that mark their article, less the blocks at its edges that the host repeats."""
    rows = marked.where("host <> ''").select("hk", "text", "head", "tail", "other", "sketch", "page")
    schema = "hk long, key long, sketch int"
    seen = rows.mapInArrow(_edge_rows, schema).groupBy("key", "hk", "sketch").agg(F.count("*").alias("n"))
    often = seen.groupBy("key").agg(F.min("hk").alias("hk"), F.max("hk").alias("last"), F.count("*").alias("pages"), F.sum("n").alias("n"))
    often = often.where((F.col("hk") == F.col("last")) & (F.col("pages") >= EDGE_PAGES) & (F.col("pages") >= EDGE_DIFFER * F.col("n")))
    sizes = rows.select("hk", "sketch").distinct().groupBy("hk").agg((F.count("*") * EDGE_SHARE).alias("least"))
    often = stage(often.select("key", "hk", "pages").join(sizes, "hk").where("pages >= least").select("key", "hk", F.greatest("least", F.lit(EDGE_PAGES)).alias("least")), "html-often")
    if often.isEmpty():
        return marked.select("page_id", "url", "text")
    wanted = marked.sparkSession.sparkContext.broadcast(bitmap(often, "key"))
    suffixes = rows.mapInArrow(lambda b: _edge_rows(b, wanted.value), schema + ", rest binary, page long, edge boolean")
    suffixes = stage(suffixes.join(often.select("key", "hk"), ["key", "hk"], "left_semi"), "html-suffixes", ZSTD)
    repeats = stage(suffix_order(suffixes, often.select("hk", "least").distinct(), EDGE_DIFFER), "html-repeats")
    own = suffixes.where("edge").select("hk", "key", "rest", "page").distinct().join(repeats, ["hk", "key"]).where("startswith(rest, prefix)")
    hit = own.groupBy("page").agg(F.collect_set(F.struct("key", "prefix")).alias("repeated"))
    cut = marked.join(stage(hit, "html-hit"), "page", "left").select("page_id", "url", "text", "head", "tail", "repeated")
    return cut.mapInArrow(_trimmed, "page_id long, url string, text string")


def html_extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, host string, text string, open boolean, other string, head array<int>, tail array<int>, sketch int"
    found = stage(own.mapInArrow(_extracted, schema), "html-blocks", ZSTD).withColumns({"page": F.xxhash64("page_id", "url", "text"), "hk": F.xxhash64("host")})
    done = _without_edges(found.where("not open"))
    done = done.unionByName(found.where("open and host = ''").select("page_id", "url", "text"))
    rest = found.where("open and host <> ''")
    if not rest.isEmpty():
        own = found.where("host <> ''").join(rest.select("hk").distinct(), "hk", "left_semi")
        streams = own.select("hk", "sketch", F.concat_ws(" ", F.when(F.col("open"), F.col("text")), F.when(F.col("other") != "", F.col("other"))).alias("stream"))
        schema = "hk long, key long, sketch int"
        held = streams.mapInArrow(lambda b: _suffixes(b, run), schema).distinct().groupBy("hk", "key").agg(F.count("*").alias("pages"))
        sizes = own.select("hk", "sketch").distinct().groupBy("hk").agg(F.greatest(F.lit(OPEN_PAGES), F.count("*") * OPEN_SHARE).alias("least"))
        buckets = stage(held.join(sizes, "hk").where("pages >= least").select("hk", "key", "least"), "html-buckets")
        wanted = pages.sparkSession.sparkContext.broadcast(bitmap(buckets, "key"))
        suffixes = streams.mapInArrow(lambda b: _suffixes(b, run, wanted.value), schema + ", rest binary").join(buckets.select("hk", "key"), ["hk", "key"], "left_semi")
        # A run that half of the pages hold is one of at most twice as many as a page has on average, so a host's fit a row.
        repeated = suffix_order(suffixes, buckets.select("hk", "least").distinct()).groupBy("hk").agg(F.collect_list(F.struct("key", "prefix")).alias("repeated"))
        salted = stage(repeated, "html-repeats").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = rest.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["hk", "salt"], "left").select("page_id", "url", "text", "repeated")
        done = done.unionByName(cut.mapInArrow(lambda b: _uncovered(b, run), "page_id long, url string, text string"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
