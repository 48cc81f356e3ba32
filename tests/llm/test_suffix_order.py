"""The suffix order of a host's pages against every prefix of every suffix, and blocks whose repeats are longer than a window."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import html_extract


@pytest.mark.parametrize("batch", [3, 2_000])
def test_repeats_have_the_length_that_enough_pages_hold(spark, batch):
    """Common prefixes of neighbours, within batches and over their borders, count a page once however often it holds a repeat."""
    r = random.Random(5)
    run, rest = html_extract.RUN, html_extract.REST
    pages = []
    for p in range(60):
        t = [r.choice("ab") for _ in range(r.randrange(25))]
        t[r.randrange(len(t) + 1) : 0] = "one two three four five six seven eight nine ten eleven twelve thirteen".split()[: r.randrange(5, 14)] * r.randrange(3)
        pages.append((p % 3, r.randrange(12), " ".join(t)))
    pages += [(0, 1, ""), (0, 2, "short"), pages[0], pages[0]]
    holders = defaultdict(set)
    for hk, sketch, text in pages:
        t = text.split()
        for i in range(len(t)):
            for n in range(run, run + rest + 1):
                if i + n <= len(t):
                    holders[hk, tuple(t[i : i + n])].add(sketch)
    least = {0: 3, 1: 5, 2: 4}
    streams = spark.createDataFrame(pages, "hk long, sketch int, stream string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        every = np.full(1 << 14, -1)
        suffixes = streams.mapInArrow(lambda b: html_extract._suffixes(b, run, every), "hk long, key long, sketch int, rest binary")
        found = html_extract.suffix_order(suffixes, spark.createDataFrame(list(least.items()), "hk long, least int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found))
    known = {hk: html_extract._known([x.asDict() for x in found if x.hk == hk]) for hk in least}
    longer = 0
    for hk, sketch, text in pages:
        t = text.split()
        h = html_extract.token_hashes(text)
        for i, key in enumerate(html_extract.windows(text, run).tolist()):
            want = max((n for n in range(run, run + rest + 1) if i + n <= len(t) and len(holders[hk, tuple(t[i : i + n])]) >= least[hk]), default=0)
            tail = html_extract._rest(h, np.array([i + run]))[0].tobytes()
            got = min(run + html_extract._reach(key, tail, known[hk]), len(t) - i) if key in known[hk] else 0
            assert got == want, (text, i)
            longer += want > run
    assert longer > 50


def test_a_block_goes_by_all_that_its_repeats_cover(spark):
    """14 of a block's 26 tokens recur on the host's pages: more than half, though the windows sampled from them cover fewer."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    call = "subscribe here find miss to you today here find to another and find one".split()
    pages, want = [], {}
    for n in range(10):
        body = [" ".join(words(30)) for _ in range(5)]
        last = " ".join([*call, *words(12)])
        pages.append((n, f"http://a.com/{n}", "<article>" + "".join(f"<p>{p}</p>" for p in [*body, last]) + "</article>"))
        want[n] = " ".join(body)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    assert {x.page_id: x.text for x in html_extract.html_extract(df).collect()} == want


def test_equal_suffixes_of_a_page_are_told_once():
    """A block that also stands outside the article is the article's on its side, and is not on the other."""
    lists = pa.list_(pa.int32())
    page = pa.record_batch({"text": ["a b c d e f g"], "head": pa.array([[5]], lists), "tail": pa.array([[]], lists), "other": ["a b c"], "hk": [1], "sketch": [2], "page": [3]})
    (got,) = html_extract._edge_rows([page], np.full(1 << 14, -1))
    assert sorted(got.column("edge").to_pylist()) == [False, True]
    assert len(set(got.column("key").to_pylist())) == 2
