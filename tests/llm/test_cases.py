"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_extract, line_dedup, mixing, ngram_join, pieces, quality, simhash, toxicity, url_filter
from tessera.llm.shared import components
from tessera.llm.text import brute_words, shingle_sets, utf8, words

CLASH = "k long, n int, bands string, bucket string, dk string, ord string, line string, key string, share string, host string, label string, held_out string, score string, _id string, kind string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


def messy(spark, extra=()):
    base = sentence(1, 60)
    texts = [
        (1, base), (2, base), (3, base + " more words"), (4, None), (None, "null id " + sentence(2, 30)), (5, ""), (6, "   \n\n"), (7, "!!! ???"), (8, "two words"),
        (9, "Two, WORDS!"), (10, "\n".join([sentence(3, 12), sentence(4, 12), sentence(3, 12)])), (11, sentence(5, 20_000)), (10, "another text of the same id " + sentence(6, 40)),
        (12, base), (12, base), (13, "été ▁ naïve 日本語 🎉 \t tab"), (None, None), *extra,
    ]
    rows = [(i, t, "en", "src0", len(t or ""), 1, 2, *["x"] * 13) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return messy(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 14)] + [(None, 1, 1), (3, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(text: str | None, k: int = 5) -> set:
    w = brute_words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_words_agree_with_strings():
    texts = ["Hello wörld, foo_bar", None, "", "a  b\tc", "…é--x", "ÀÉ A1 _", "x" * 5000]
    buf, off = utf8(pa.array(texts), lower=True)
    w = words(buf, off)
    for i, t in enumerate(texts):
        assert [bytes(buf[a:b]).decode() for a, b, r in zip(w.start, w.end, w.row) if r == i] == brute_words(t)
    assert [len(s) for s in shingle_sets(pa.array(texts), 5)] == [len(shingles(t)) for t in texts]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "t").collect()}
    assert got == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100}


def test_ngram_join_against_brute_force(spark):
    r = random.Random(4)
    made = []
    for group in range(6):
        words_ = sentence(100 + group, 80).split()
        for copy in range(25):
            x = list(words_)
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = f"new{r.randrange(50)}"
            made.append((1000 + group * 50 + copy, " ".join(x)))
    df = messy(spark, made)
    rows = [(x.doc_id, x.text) for x in df.collect()]
    sets = [shingles(t) for _, t in rows]
    want = []
    for i, (d, _) in enumerate(rows):
        if not sets[i]:
            want.append((d, d, 0, 0))
            continue
        same = [e for (e, _), s in zip(rows, sets, strict=True) if s == sets[i] and e is not None]
        links = sum(jaccard(sets[i], s) >= 0.8 for j, s in enumerate(sets) if j != i)
        want.append((d, min(same, default=d), len(sets[i]), links))
    for block in (1024, 8):
        got = [(x.doc_id, x.class_id, x.n_grams, x.n_links) for x in ngram_join.ngram_jaccard_join(df, block=block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = [x.doc_id for x in ngram_join.near_duplicates_removed(df).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 12 not in kept and {4, 5, 6, 7, 11} <= set(kept)
    assert sum(1 for x in kept if x in (8, 9)) == 1


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands(0.8, 0.999)
    assert b * r <= 64 and 1 - (1 - 0.8**r) ** b >= 0.999


def brute_lines(rows, threshold=0.8, least=5):
    lines = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            lines.append((math.inf if d is None else d, i, t or "", frozenset(brute_words(line)), d))
    big = [x for x in lines if len(x[3]) >= least]
    first = {}
    for x in sorted(big, key=lambda x: x[:2]):
        first.setdefault(x[3], x[:3])
    gone = set()
    order = sorted(first, key=lambda s: first[s][:2])
    for i, s in enumerate(order):
        hit = any(jaccard(s, e) >= threshold for e in order[:i])
        gone |= {x[:3] for x in big if x[3] == s and (hit or x[:2] != first[s][:2])}
    return {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if (math.inf if d is None else d, i, t) not in gone) for d, t in rows if t}


def test_line_dedup_against_brute_force(spark):
    r = random.Random(9)
    pool = [sentence(500 + i, r.randrange(5, 40)).split() for i in range(30)]
    made = []
    for d in range(60):
        out = []
        for _ in range(r.randrange(1, 6)):
            x = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                x[r.randrange(len(x))] = f"z{r.randrange(3000)}"
            out.append(" ".join(x))
        made.append((2000 + d, "\n".join(out)))
    df = messy(spark, made).where("doc_id <> 10 or doc_id is null")
    rows = [(x.doc_id, x.text) for x in df.collect()]
    want = brute_lines(rows)
    for work in ({}, {"hot": 2}, {"tiers": ((math.inf, 1),)}, {"hot": 2, "crowd": 3, "side": 2, "tiers": ((math.inf, 1),)}):
        for x in line_dedup.line_dedup(df.withColumn("old", F.col("text")), **work).collect():
            assert x.text == (want[(x.doc_id, x.old)] if x.old else x.old)
    left = line_dedup.lines_removed(df)
    assert left.columns == df.columns and 2 not in [x.doc_id for x in left.collect()]


def test_candidates_keep_all_similar_lines():
    """The filters of candidates lose no pair, for every size of set and signature."""
    r = np.random.default_rng(3)
    for n in (5, 31, 64, 65, 130, 300):
        a = np.unique(r.integers(0, 2**32, n).astype(np.uint64))
        for cut in range(0, n // 5):
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 2**32, cut // 2).astype(np.uint64)]))
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            size = np.array([len(small), len(large)])
            sig, begin = line_dedup.signatures(np.concatenate([small, large]), np.array([0, len(small)]), size)
            assert line_dedup.apart(sig, begin, np.array([0]), np.array([1]))[0] <= len(set(a.tolist()) ^ set(b.tolist()))


def test_fingerprints_against_brute_force(spark, docs):
    got = simhash.document_fingerprints(docs, radius=40).collect()
    rows = sorted(((x.doc_id, x.text or "") for x in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in got), key=repr) == sorted(want, key=repr)
    bits = [int(x.fingerprint, 16) for x in got]
    for x, b in zip(got, bits, strict=True):
        assert x.n_near == sum((b ^ c).bit_count() <= 40 for c in bits) - 1
        assert 0 <= x.near_next <= 1 and x.near_edited == 1 - (b ^ int(x.edited_fingerprint, 16)).bit_count() / simhash.WORDS
    same = {x.fingerprint for x in got if x.doc_id in (1, 2, 12)}
    assert len(same) == 1


def test_pieces_are_lossless_and_reproducible(spark, docs):
    a = pieces.encode_documents(docs)
    assert all(x.lossless for x in a.collect())
    key = lambda x: repr((x.doc_id, x.n_chars, x.pieces))
    assert sorted(map(key, a.collect())) == sorted(map(key, pieces.encode_documents(docs.repartition(7)).collect()))
    back = sorted((repr((x.doc_id, x.text)) for x in pieces.decode_documents(a).collect()))
    assert back == sorted(repr((x.doc_id, x.text or "")) for x in docs.collect())
    said = "the history of information retrieval and understanding " * 5
    drawn = pieces.encode_documents(spark.createDataFrame([(1, said), (2, said), (2, said), (None, said)], "doc_id long, text string")).collect()
    assert len({tuple(x.pieces) for x in drawn}) == 3  # one draw for each key


def test_segmentations_are_drawn_with_their_probability():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    weight = {v.bytes_of[i]: w for i, w in zip(v.ids, v.weight, strict=True)}

    def all_of(s: str):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if (p := s[:k].encode()) in weight:
                for rest, w in all_of(s[k:]):
                    yield (p, *rest), w + weight[p]

    chance = dict(all_of("there"))
    total = sum(map(math.exp, chance.values()))
    n = 20_000
    ids, at = pieces.encode(["there"] * n, np.arange(n).astype(np.uint64), v, 5)
    seen = {}
    for a, b in zip(at[:-1], at[1:], strict=True):
        s = tuple(v.bytes_of[i] for i in ids[a:b])
        seen[s] = seen.get(s, 0) + 1
    assert max(abs(seen.get(s, 0) / n - math.exp(w) / total) for s, w in chance.items()) < 0.015
    long = "there" * 40
    ids, at = pieces.encode([long], np.zeros(1, np.uint64), v, 5)
    assert pieces.decode(ids.tolist(), v) == long


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_classifiers_on_odd_rows(spark, docs, empty, labels, op):
    got = op(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.held_out is not None for x in got)
    assert len({x.score for x in got if x.doc_id in (1, 2, 12)}) == 1
    assert op(empty, labels).count() == 0
    none = labels.where("false")
    assert len({round(x.score, 9) for x in op(docs, none).collect()}) == 1


def test_classifiers_learn(spark):
    r = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        t = sentence(3000 + i, r.randrange(20, 120)).split()
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            t[r.randrange(len(t))] = r.choice(["grumble", "snarl"])
        rows.append((i, " ".join(w + "###" if bad else w for w in t)))
        marks.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for op, column in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        out = op(docs, labels).join(labels, "doc_id").where("held_out").collect()
        assert sum(x.predicted == x[column] for x in out) >= 0.97 * len(out)


def test_factorisation_machine_identity():
    r = np.random.default_rng(0)
    x, v = r.normal(size=12), r.normal(size=(12, 4))
    slow = sum(v[i] @ v[j] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(slow, 0.5 * (((x @ v) ** 2) - (x**2) @ (v**2)).sum())


def test_mixing_reaches_targets(spark, docs, empty):
    r = random.Random(2)
    tongues = {"a": [f"aa{i}" for i in range(300)], "b": [f"bb{i}" for i in range(300)], "c": [f"cc{i}" for i in range(300)]}
    rows = []
    for i in range(900):
        d = r.choices("abc", [6, 3, 1])[0]
        rows.append((i, " ".join(r.choice(tongues[d]) for _ in range(r.randrange(1, 60))), d))
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = mixing.mixing_rates(frame.drop("domain"), frame.where("doc_id % 3 = 0").select("doc_id", "domain"), {"a": 0.2, "b": 0.3, "c": 0.5}).collect()
    p, rate, n = np.array([x._posteriors for x in got]), np.array([x._rate for x in got]), np.array([x._tokens for x in got])
    assert got[0]._domains == ["a", "b", "c"] and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose((rate * n) @ p / n.sum(), [0.2, 0.3, 0.5], atol=1e-5)
    domains = docs.select("doc_id", F.col("lang").alias("domain"))
    assert mixing.mixing_rates(docs, domains, {"en": 1.0}).count() == docs.count()
    assert mixing.mixed(docs, domains, {"en": 1.0}).columns == docs.columns
    assert mixing.mixed(empty, domains.where("false"), {"en": 1.0}).count() == 0
    assert {x._rate for x in mixing.mixing_rates(docs, domains.where("false"), {"en": 1.0}).collect()} == {1.0}


def test_rates_match_brute_force_projected_gradient(spark):
    """Preconditioned steps end where plain projected gradient on the same posteriors ends: at the targets."""
    r = np.random.default_rng(5)
    p = r.dirichlet([0.3, 0.3, 0.3], 200)
    n = r.integers(1, 50, 200)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_tokens long, _posteriors array<double>")
    _, targets, totals = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.7, "b": 0.2, "c": 0.1})
    a = n[:, None] * p
    rate, step = np.ones(200), 1 / np.linalg.eigvalsh(a.T @ (a / n[:, None])).max()
    for _ in range(20_000):
        rate = np.maximum(0, rate - step * p @ (rate @ a - targets))
    assert np.allclose(rate @ a, targets, rtol=1e-4) and np.allclose(totals, targets, rtol=1e-4)


def test_url_filter_cases(spark):
    entries = spark.createDataFrame(
        [("domain", "bad.com", "add", "2024-01-10"), ("domain", "bad.com", "remove", "2024-02-01"), ("domain", "bad.com", "add", "2024-01-20"), ("prefix", "ok.com/x", "add", "2024-01-01"),
         ("domain", "tie.com", "add", "2024-01-01"), ("domain", "tie.com", "remove", "2024-01-01"), ("domain", "[2001:db8::1]", "add", "2024-01-01"), ("domain", None, "add", "2024-01-01"), ("prefix", "sub.bad.com/a/b", "add", "2024-01-01")],
        "kind string, pattern string, action string, at string",
    )
    captures = spark.createDataFrame(
        [(1, "http://BAD.com./p", "2024-01-09"), (2, "http://bad.com/p", "2024-01-10"), (3, "https://u:p@sub.bad.com:80/a/b/c?q#f", "2024-01-31"), (4, "http://bad.com", "2024-02-01"),
         (5, "http://notbad.com/", "2024-01-15"), (6, "http://ok.com/x/y", "2024-05-01"), (7, "http://ok.com/xy", "2024-05-01"), (8, "http://tie.com", "2024-05-01"), (9, None, "2024-05-01"),
         (10, "nonsense", "2024-05-01"), (11, "http://[2001:db8::1]/x", "2024-05-01"), (12, "http://[2001:db8::2]:8080/x", "2024-05-01"), (None, "http://bad.com/p", None), (2, "http://bad.com/p", "2024-01-10")],
        "page_id long, url string, fetched string",
    ).withColumn("key", F.lit("x")).withColumn("salt", F.lit("y"))
    got = sorted(((x.page_id, x.blocked, x.rule) for x in url_filter.url_filter(captures, entries).collect()), key=repr)
    want = [(1, False, None), (2, True, "bad.com"), (2, True, "bad.com"), (3, True, "sub.bad.com/a/b"), (4, False, None), (5, False, None), (6, True, "ok.com/x"), (7, False, None), (8, False, None), (9, False, None), (10, False, None), (11, True, "[2001:db8::1]"), (12, False, None), (None, False, None)]
    assert got == sorted(want, key=repr)
    assert url_filter.url_filter(captures.where("false"), entries).count() == 0
    assert not url_filter.url_filter(captures, entries.where("false")).where("blocked").count()


def test_html_cases(spark):
    shared = "Sign up today for our weekly letter and never miss a story again"
    pages = [
        (1, "http://a.com/1", "<html><body><nav>Menu</nav><article><h1>T &amp; t</h1><p>One  <b>tw</b>o<br>three</article><footer>f</footer>"),
        (2, "http://b.com/1", f"<body><p>First story text here.</p><p>{shared}</p>"), (3, "http://b.com/2", f"<body><p>Second story is other.</p><p>{shared}</p>"),
        (4, "http://c.com/1", f"<body><p>{shared}</p>"), (5, None, None), (6, "http://d.com", ""), (7, "http://d.com", "plain <text"), (8, "x", "<script>var a='<p>no</p>';</script><!-- <p>no</p> -->yes<style>b{"),
        (9, "http://b.com/1", "<main><p>Main</p><aside>side</aside><div class='reader-comments'><p>bad</p></div></main>"), (2, "http://b.com/1", f"<body><p>First story text here.</p><p>{shared}</p>"),
        (11, "http://b.com/3", f"<body><p>A third one differs too.</p><p>{shared}</p>"), (12, "http://f.com/a", f"<p>{shared}</p>"), (13, "http://f.com/a?utm=1", f"<p>{shared}</p>"),
        (14, "http://f.com/q", f"<p>Another page that quotes: {shared[:40]} as they say here.</p>"), (15, "http://[2001:db8::1]/x", f"<p>One text.</p><p>{shared}</p>"),
        (16, "http://[2001:db8::2]/x", f"<p>Two texts.</p><p>{shared}</p>"), (17, "http://[2001:db8::3]:80/x", f"<p>Three texts.</p><p>{shared}</p>"),
        (10, "http://e.com", "<p>" * 3000 + "deep" + "<article><div class=ad>x</div>in</article>"),
    ]
    df = spark.createDataFrame([(*p, "h", "t") for p in pages], "page_id long, url string, html string, host string, text string")
    got = [(x.page_id, x.text) for x in html_extract.html_extract(df).collect()]
    want = [(1, "T & t One two three"), (2, "First story text here."), (2, "First story text here."), (3, "Second story is other."), (11, "A third one differs too."), (12, shared), (13, shared), (14, f"Another page that quotes: {shared[:40].strip()} as they say here."),
        (15, f"One text. {shared}"), (16, f"Two texts. {shared}"), (17, f"Three texts. {shared}"), (4, shared), (5, ""), (6, ""), (7, "plain"), (8, "yes"), (9, "Main"), (10, "in")]
    assert sorted(got) == sorted(want)
    assert all(x.n_chars == len(x.text) for x in html_extract.html_extract(df).collect())
    assert html_extract.html_extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="has-sidebar"><article><p>keep</p></article></div>', "keep"), ('<main class="content with-sidebar"><p>keep</p></main>', "keep"),
        ('<article class="post has-comments"><p>keep</p></article>', "keep"), ("<article><p title=Don't>lost text</p><p>kept 'x' y</p></article>", "lost text kept 'x' y"),
        ('<article><p title="a hidden gem">kept</p><p data-x="display:none">too</p></article>', "kept too"), ('<article><div style="overflow: hidden !important">kept</div></article>', "kept"),
        ('<article>a <math><mi>x</mi></math> b<p hidden>no</p><p style="color:red; display : none">no</p><p aria-hidden=true>no</p></article>', "a x b"),
        ('<article><div class="social-history"><p>one</p></div><div class="related-work">two</div><div class="section-search">three</div></article>', "one two three"),
        ('<article><p>t</p><div class="related-posts">no</div><div class="socialShare">no</div><div class="ad-slot">no</div><div class="comment-list">no</div></article>', "t"),
        ('<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><h1><a href=4>Title</a></h1><p>Text with <a>a link</a> in it.</p>', "Text with a link in it."),
        ('<p><a>One</a></p><p><a>Two</a></p><p>text</p>', "One Two text"),
        ('<article><section id="social"><p>keep</p></section></article>', "keep"), ("<![CDATA[abcdef", "abcdef"), ("<![CDATA[ab]]>c", "abc"), ('<a href="x>y">in</a> <b a=\'>\'>t</b>', "in t"),
        ('<div class="sidebar-left layout"><article><p>keep</p></article></div>', "keep"), ("<nav><article>x</article></nav><p>y</p>", "y"),
        ('<article><p>a</p></article><div id=comments><article class=comment><p>bad</p></article></div>', "a"),
        ('<main><p>Main</p><div class="reader-comments"><article><p>bad</p></article></div></main>', "Main"),
        ('<p>body</p><p>more of it</p><div class="related"><article>teaser</article></div>', "body more of it"), ('<article><div class="ad">x</div><aside>y</aside>t</article>', "t"),
    ],
)
def test_html_parser(page, want):
    assert " ".join(html_extract.chosen(html_extract.blocks(page))[0]) == want


def test_html_parser_is_linear():
    import time

    for page in ("<i>" * 150_000 + "</b>" * 150_000, "<i><article>" + "<b>" * 100_000 + "</i>" * 100_000, "<p " + 'a="b" ' * 150_000, "<p x='" + "= " * 300_000):
        began = time.process_time()
        html_extract.blocks(page)
        assert time.process_time() - began < 5


def test_boilerplate_inside_marked_articles(spark):
    """A call at the end of a host's articles goes; quotes, near copies, copies and what few pages share stay."""
    call = "Like this story? Subscribe to our weekly letter and never miss another one of them again."
    quote = "The committee has found no evidence that any of the named parties acted against the rules in force."
    intro = "From our own correspondents in the capital"

    def page(host, n, *paragraphs):
        return n, f"http://{host}/{n}", "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>x</footer>"

    own = lambda n: [sentence(7000 + 10 * n + i, 30) for i in range(4)]
    pages, want = [], {}
    for n in range(20):
        body = own(n)
        kept = [*body[:2], quote, *body[2:]] if n % 2 else body  # a quote in the middle of ten articles
        pages.append(page("a.com", n, intro, *kept, call) if n < 12 else page("a.com", n, *kept))
        want[n] = " ".join(kept)
    base = own(50)
    for n in range(100, 140):  # near copies of one article fill a host
        changed = [*base[:1], base[1] + f" z{n}", *base[2:]]
        pages.append(page("b.com", n, *changed))
        want[n] = " ".join(changed)
    for n in range(200, 230):  # copies
        pages.append(page("c.com", n, *own(60)))
        want[n] = " ".join(own(60))
    for n in range(300, 303):  # too few pages
        pages.append(page("d.com", n, *own(n), call[::-1]))
        want[n] = " ".join([*own(n), call[::-1]])
    for n in range(500, 530):  # a sentence in general use opens articles of two hosts
        pages.append(page(f"{'ef'[n % 2]}.com", n, quote, *own(n)))
        want[n] = " ".join([quote, *own(n)])
    pages.append((400, None, "<article><p>one</p><p>two</p><p>three</p></article>"))
    want[400] = "one two three"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    assert {x.page_id: x.text for x in html_extract.html_extract(df).collect()} == want


def test_repeats_of_a_host_against_brute_force(spark):
    """Tokens covered by windows that half of a host's differing pages hold go; copies count once; no page loses all."""
    r = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    streams = []
    for p in range(12):
        t = [f"p{p}x{i}" for i in range(30)]
        a = r.randrange(12)
        t[10:10] = common[a : a + r.randrange(8, 26)]
        streams.append(t)
    streams += [streams[0], streams[0], streams[1], common[10:20]]
    df = spark.createDataFrame([(i, f"http://h.com/{i}", "<p>" + " ".join(t) + "</p>") for i, t in enumerate(streams)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.html_extract(df).collect()}
    n = html_extract.RUN
    runs = lambda t: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    different = {tuple(t) for t in streams}
    often = {w for t in different for w in runs(t) if sum(w in runs(list(o)) for o in different) >= max(html_extract.OPEN_PAGES, html_extract.OPEN_SHARE * len(different))}
    assert often
    for i, t in enumerate(streams):
        gone = {k for a in range(len(t) - n + 1) if tuple(t[a : a + n]) in often for k in range(a, a + n)}
        kept = [x for k, x in enumerate(t) if k not in gone]
        assert got[i] == " ".join(kept or t)


def brute_neighbours(rows, k=10, every=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in sorted(ok, key=lambda x: (x[0], x[1].tolist())):
        if q % every == 0 and q not in [x[0] for x in out]:
            d = {}
            for i, w in ok:
                if i != q:
                    d[i] = min(d.get(i, math.inf), math.sqrt(((v - w) ** 2).sum()))
            out += [(q, r + 1, i) for r, (x, i) in enumerate(sorted((x, i) for i, x in d.items())[:k])]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, x[7].tolist()) for i in range(40)] + [(5100, x[7].tolist())]
    odd = [(6000, None), (6100, [0.0] * 16), (6200, [float("nan")] * 16), (6300, [None, *[1.0] * 15]), (None, x[1].tolist()), (6400, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("list", F.lit(2)).repartition(4)
    got = [(a.query_id, a.rank, a.vec_id) for a in ann.nearest_neighbours(df).collect()]
    want = brute_neighbours(rows)
    pairs = lambda rows: {(q, i) for q, _, i in rows}
    assert len(got) == len(want) and len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    assert {g for g in got if g[0] == 5100} == {w for w in want if w[0] == 5100}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 1.0]), (100, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted((a.query_id, a.rank, a.vec_id) for a in ann.nearest_neighbours(few).collect()) == brute_neighbours([(0, [1, 2]), (1, [1, 3]), (2, [1, 1]), (100, [5, 5])])
    assert ann.nearest_neighbours(df.where("false")).count() == 0


def test_empty_tables(spark, empty):
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert simhash.document_fingerprints(empty).count() == 0
    assert pieces.encode_documents(empty).count() == 0
    only = empty.unionByName(spark.createDataFrame([(None, None, None, None, None, None, None, *[None] * 13)], SCHEMA))
    assert [tuple(x) for x in ngram_join.ngram_jaccard_join(only).collect()] == [(None, None, None, 0, 0)]
    assert line_dedup.line_dedup(only).count() == 1 and simhash.document_fingerprints(only).count() == 1


def test_near_duplicates_are_decided_by_row(spark):
    a, b = sentence(900, 60), sentence(901, 60)
    docs = [
        (None, a), (None, a + " tail"), (None, "clean and unique " + sentence(902, 40)),  # a group of null ids; an unlinked row
        (50, b), (51, b + " tail"), (51, "unlinked under a repeated id " + sentence(903, 40)),  # (b)
        (60, sentence(904, 60)), (60, sentence(904, 60)), (60, "unlinked under the id that stays " + sentence(905, 40)),  # (c)
        (70, sentence(906, 60)), (None, sentence(906, 60) + " tail"), (71, None), (71, None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = [(x.doc_id, x.text) for x in ngram_join.near_duplicates_removed(df).collect()]
    want = [docs[i] for i in (2, 3, 5, 6, 8, 9, 11, 12)]
    assert sum(x in left for x in docs[:2]) == 1
    assert sorted((x for x in left if x not in docs[:2]), key=repr) == sorted(want, key=repr)


def test_vectors_of_one_id_leave_room_for_others(spark):
    made = [(0, [1.0, 0.0])] + [(1, [1.0 + i / 1000, 0.0]) for i in range(1, 200)] + [(i, [2.0 + i, 0.0]) for i in range(2, 30)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    got = [(a.query_id, a.rank, a.vec_id) for a in ann.nearest_neighbours(df).collect()]
    assert sorted(got) == [(0, i, i) for i in range(1, 11)]


def test_short_lines_are_compared(spark):
    import corpus_pipeline

    four = "alpha beta gamma delta"
    df = spark.createDataFrame([(1, f"{four}\nRead more\n}}", 0), (2, f"read  MORE!\nonly here\n{four} epsilon\n}}", 0), (3, "more\nread on", 0), (4, "More", 0)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.cut_lines(spark, df, "").collect()}
    assert got == {1: f"{four}\nRead more\n}}", 2: "only here\n}", 3: "more\nread on"}
