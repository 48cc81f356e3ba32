"""Models, votes, draws and searches against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, features, line_dedup, mixing, ngram_join, pieces, quality, shared, simhash, toxicity, url_filter
from tessera.llm.text import brute_words, grams, mix, utf8, words

SMALL = "/root/testdata/sf0.01"


def texts_of(n: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("total", [1, 100, 10**4, 10**10, 10**12, 10**16])
def test_draws_never_end_at_zero(total):
    limit = shared.draw_limit(total, 3_000)
    assert limit > 0 and math.isclose(min(1.0, 3_000 / total), limit / 2**63, rel_tol=1e-6)


def test_draws_are_about_as_large_as_asked(spark):
    ids = spark.range(100_000).withColumnRenamed("id", "doc_id")
    assert 1_800 < shared.drawn(ids, 100_000, 2_000, "doc_id").count() < 2_200


def test_training_samples_are_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(None, "same")] * 500 + [(8, "other"), (9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = features.training_rows(docs, labels, "toxic", 100, 1_000)
    assert dict(zip(got.texts.to_pylist(), got.label.tolist(), strict=True)).items() <= {"text 0": 1.0, "other": 0.0}.items()
    assert features.unlabelled_rows(docs, 10_000, 1_000).texts.to_pylist().count("same") <= 1


def test_posteriors_are_those_of_plain_naive_bayes(spark):
    """Counts, priors, smoothing, tempering and normalisation, with the same word buckets."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["sun", "sea", "sand"] if i % 3 else ["ice", "snow", "sea"]) + str(r.randrange(4)) for _ in range(r.randrange(0, 25))), "b" if i % 3 else "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.classifier(docs, docs.where("doc_id < 120").select("doc_id", "domain"), 10_000)
    got = {x.doc_id: (x._tokens, x._posteriors) for x in mixing.with_posteriors(docs.select("doc_id", "text"), model).collect()}
    all_words = sorted({w for _, t, _ in rows for w in t.split()})
    bucket = {x.w: x.b for x in spark.createDataFrame([(w,) for w in all_words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    seen = {d: Counter(bucket[w] for i, t, e in rows if i < 120 and e == d for w in t.split()) for d in "ab"}
    size = {d: sum(seen[d].values()) + 0.5 * mixing.BUCKETS for d in "ab"}
    prior = {d: sum(e == d for i, _, e in rows if i < 120) / 120 for d in "ab"}
    for i, t, _ in rows:
        w = t.split()
        scale = min(len(w), mixing.EVIDENCE) / max(len(w), 1)
        score = [math.log(prior[d]) + scale * sum(math.log((seen[d][bucket[x]] + 0.5) / size[d]) for x in w) for d in "ab"]
        want = np.exp(np.array(score) - max(score))
        assert got[i][0] == len(w) and np.allclose(got[i][1], want / want.sum(), atol=1e-6)


def test_toxicity_scores_are_those_of_the_plain_model():
    """Presence of the selected words and 5-grams, summed with their weights, text by text."""
    texts = [*texts_of(150), None, "", "grumble " * 3]
    model = toxicity.fit(features.Sample(pa.array([t + " grumble w1" for t in texts_of(60, 8)]), np.ones(60)), features.Sample(pa.array(texts_of(200, 9)), np.zeros(200)), 0.2)
    assert len(model["codes"])
    batch = pa.record_batch({"doc_id": np.arange(len(texts)), "held_out": np.zeros(len(texts), bool), "text": pa.array(texts, pa.string())})
    got = np.concatenate([b.column("score").to_numpy() for b in toxicity._score(iter([batch]), model)])
    weight = dict(zip(model["codes"].tolist(), model["w"].tolist(), strict=True))
    for t, s in zip(texts, got, strict=True):
        _, code, _ = features.codes(*utf8(pa.array([t], pa.string()), lower=True))
        assert math.isclose(s, 1 / (1 + math.exp(-sum(weight.get(c, 0.0) for c in set(code.tolist())) - model["b"])), rel_tol=1e-5)
    assert got[-1] > got[-2]


def test_risk_is_the_nonnegative_estimator():
    """On data that it can't overfit the fitted weights are near a minimum of pi R_P(+1) + R_U(-1) - pi R_P(-1)."""
    positive, unlabelled, prior = [f"bad word{i % 7}" for i in range(300)], [("bad " if i % 5 == 0 else "") + f"word{i % 7}" for i in range(900)], 0.2
    m = toxicity.fit(features.Sample(pa.array(positive), np.ones(300)), features.Sample(pa.array(unlabelled), np.zeros(900)), prior)
    place = features.placed(m["codes"])

    def matrix(texts):
        x = np.zeros((len(texts), len(m["codes"])))
        row, f = features.presence(pa.array(texts), place)
        x[row, f] = 1
        return x

    p, u = matrix(positive), matrix(unlabelled)

    def risk(w, b):
        zp, zu = p @ w + b, u @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()) + 1e-4 * (w @ w)

    best = risk(m["w"], m["b"])
    assert best < 0.7 * risk(np.zeros(len(m["w"])), math.log(prior / (1 - prior)))
    r = np.random.default_rng(0)
    assert all(risk(m["w"] + r.normal(0, 0.3, len(m["w"])), m["b"] + r.normal(0, 0.3)) > best - 0.01 for _ in range(50))


def test_machine_scores_are_the_sum_over_pairs():
    """The sum-of-squares identity of Machine.score against the double sum over all pairs of inputs."""
    texts = [*texts_of(60), "", None, "!!! ### w3"]
    label = np.array([i % 2 for i in range(len(texts))], float)
    m = quality.fit(features.Sample(pa.array([f"w{i % 2} " + (t or "") for i, t in enumerate(texts)]), label), epochs=5)
    assert len(m.chosen)
    place = features.placed(m.chosen)
    got = m.score(pa.array(texts, pa.string()), place)
    for t, s in zip(texts, got, strict=True):
        column = pa.array([t], pa.string())
        x = list(np.clip((features.statistics(column)[0] - m.mean) / m.scale, -4, 4).astype(float))
        _, f = features.presence(column, place, with_grams=False)
        words_ = np.zeros(len(m.chosen))
        words_[f] = 1 / math.sqrt(max(len(f), 1))
        x = np.array([*x, *words_])
        z = m.b + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i) if x[i] and x[j])
        assert math.isclose(s, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-6)


def test_fingerprints_are_plain_votes():
    """Bits are the signs of the weighted votes of words and pairs."""
    for t in [*texts_of(20), "", "one", "one one one", "x y"]:
        w = words(*utf8(pa.array([t]), lower=True))
        assert len(w.hash) == len(brute_words(t))
        total, norm = np.zeros(simhash.WORDS), 0.0
        for kind, hashes, base in ((0, mix(w.hash), 0.5), (1, grams(w, 2)[1], 1.0)):
            for h, times in Counter((int(x) >> 17) & ~1 & ((1 << 48) - 1) | kind for x in hashes).items():
                h64 = np.array([h], np.uint64)
                votes = np.concatenate([mix(h64 + np.uint64(0x517CC1B727220A95)), mix(h64 ^ np.uint64(0x9E3779B97F4A7C15))])
                weight = base * (1 + math.log(times))
                total += weight * np.unpackbits(votes.view(np.uint8), bitorder="little")
                norm += weight
        want = np.packbits(2 * total > norm * (1 + 1e-6), bitorder="little").view(np.uint64)
        got = simhash.fingerprints(pa.array([t]))[0]
        assert np.bitwise_count(want ^ got).sum() <= 1  # a tie may round either way


def test_edited_fingerprints_are_those_of_the_edited_texts(spark):
    rows = [(i, t) for i, t in enumerate(texts_of(30))]
    got = {x.doc_id: x for x in simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        changed = simhash.edited(t, rows[i - 1][1])
        assert got[i].edited_fingerprint == simhash.as_hex(simhash.fingerprints(pa.array([changed])))[0]


def test_lossless_is_checked_byte_by_byte():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    texts = ["plain text", "", "naïve 日本語 🎉▁ ࠀ ￿", "a" * 100]
    ids, at = pieces.encode(texts, np.arange(4).astype(np.uint64), v, 1)
    assert pieces.spelt_as(ids, at, pa.array(texts), v).all()
    for i, t in enumerate(texts):
        assert pieces.decode(ids[at[i] : at[i + 1]].tolist(), v) == t
    assert pieces.spelt_as(ids, at, pa.array(["plain texT", "", texts[2], "a" * 100]), v).tolist() == [False, True, True, True]
    assert pieces.spelt_as(ids, at, pa.array(["plain text!", "", texts[2], "a" * 99]), v).tolist() == [False, True, True, False]


def test_decoding_what_is_no_encoding(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [-1]), (5, [10**6]), (6, [int(pieces.vocabulary(pieces.MODEL, 1.0).byte_id[0xFF])])]
    df = spark.createDataFrame(rows, "doc_id long, pieces array<int>")
    assert {x.doc_id: x.text for x in pieces.decode_documents(df).collect()} == {1: None, 2: "", 3: None, 4: None, 5: None, 6: None}


def test_url_patterns_of_any_case_and_long_urls(spark):
    entries = spark.createDataFrame(
        [("domain", " Bad.COM. ", "Add", "2024-01-01"), ("prefix", "OK.com/Path/a", "add", "2024-01-01"), ("domain", "odd.com", "pause", "2024-01-01")], "kind string, pattern string, action string, at string"
    )
    long = "http://ok.com/" + "/".join(f"s{i}" for i in range(100_000))
    rows = [(1, "http://bad.com/x"), (2, "http://ok.com/Path/a/b"), (3, "http://ok.com/path/a"), (4, "http://odd.com"), (5, long), (6, "http://" + "a." * 20_000 + "bad.com/")]
    captures = spark.createDataFrame([(*r, "2024-02-01") for r in rows], "page_id long, url string, fetched string")
    url_filter.url_filter(captures.where("page_id < 3"), entries).collect()
    began = time.perf_counter()
    got = {x.page_id: x.rule for x in url_filter.url_filter(captures, entries).collect()}
    assert got == {1: "bad.com", 2: "ok.com/Path/a", 3: None, 4: None, 5: None, 6: "bad.com"} and time.perf_counter() - began < 10


def test_hot_urls_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT", 3)
    entries = spark.createDataFrame([("domain", "bad.com", "add", "2024-01-05"), ("domain", "rare.com", "add", "2024-01-01")], "kind string, pattern string, action string, at string")
    rows = [(i, f"http://bad.com/{i % 20}", f"2024-01-{1 + i % 9:02d}") for i in range(90)] + [(i, "http://rare.com/", "2024-01-02") for i in range(90, 130)] + [(200, "http://ok.com", "2024-01-02")]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetched string"), entries).collect()
    assert sorted((x.page_id, x.blocked) for x in got) == sorted((i, "rare" in u or "bad" in u and d >= "2024-01-05") for i, u, d in rows)


def test_crowded_lines_are_compared_with_few(spark):
    """One line in a third of the documents and 3,000 near-equal lines: no share of rows holds them all, and none is lost."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(24)]
    rows = []
    for i in range(6_000):
        own = " ".join(f"x{r.randrange(10**6)}" for _ in range(12))
        line = "read more about this offer in our shop today" if i % 3 == 0 else own
        near = " ".join([*base, f"n{i}"]) if i % 2 else own + " z"
        rows.append((i, f"{line}\n{near}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(df, least=1, hot=64, crowd=128, side=500).collect()}
    gone = sum(t.count("\n") == 0 for t in got.values())
    assert got[1].endswith("n1") and not any(f"n{i}" in got[i].split() for i in range(3, 6_000, 2))
    assert got[0].startswith("read more") and not any("shop" in got[i] for i in range(3, 6_000, 3)) and gone > 4_900


def test_keys_meet_for_every_similar_pair():
    """Two sets of Jaccard .8 or more share a key at every depth of refinement."""
    r = np.random.default_rng(2)
    for hot in (2, 3, 8, 4096):
        for _ in range(60):
            n = int(r.integers(4, 60))
            a = np.unique(r.integers(0, 2**32, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) > 0.08], r.integers(0, 2**32, int(r.integers(0, 2))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or both < 0.8 * (len(a) + len(b) - both) or set(a.tolist()) == set(b.tolist()):
                continue
            rank = {int(t): int(line_dedup.ranks(np.array([c]))[0]) for t, c in zip(np.union1d(a, b).tolist(), r.integers(2, 100, len(np.union1d(a, b))).tolist(), strict=True)}
            keys = []
            for s in (a, b):
                s = np.array(sorted(s.tolist(), key=lambda t: (rank[t], t)), np.uint64)
                order = np.array([rank[int(t)] for t in s])
                keys.append(set(line_dedup.prefix_keys(np.array([len(s)]), np.array([0]), order, s, np.ones(1, bool), 0.8, hot)[2].tolist()))
            assert keys[0] & keys[1]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
def test_recall_of_neighbours(spark):
    """Recall at 10 against brute force on the table itself, at the reach that is set."""
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = Counter((x.query_id, x.vec_id) for x in ann.nearest_neighbours(rows).collect())
    ids, x = zip(*[(r.vec_id, r.embedding) for r in ann.valid_vectors(rows).withColumnRenamed("v", "embedding").collect()], strict=True)
    ids, x = np.array(ids), np.array(x, np.float64)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hit += sum(got[(ids[q], i)] for i in near.tolist())
        total += len(near)
    assert hit >= 0.95 * total


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0 + 2e-12, 0.0])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(1, 1.0 + 1e-12 - 1.0), (2, 1.0 + 2e-12 - 1.0)]


def test_groups_of_large_buckets_against_brute_force(spark, monkeypatch):
    """Chunks, pivots and what is left outside a bucket's largest group find the groups that comparing all pairs finds."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    r = random.Random(12)
    rows = []
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(70)]
        for c in range(40):  # a chain: each is near the last, the ends are not near each other
            if c % 8 == 0:
                base = list(base)
            base[(c * 3) % 70] = f"x{g}-{c}" if g < 3 else base[(c * 3) % 70]
            own = list(base)
            if g >= 3:
                for _ in range(r.randrange(3)):
                    own[r.randrange(70)] = f"y{r.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(own)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    want = sorted({rows[min(i for i in range(len(rows)) if group[i] == x)][0] for x in set(group)})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4, 16, 1024):
        assert sorted(x.doc_id for x in ngram_join.near_duplicates_removed(df, block=block).collect()) == want


def test_long_units_are_drawn_in_blocks(monkeypatch):
    """A unit of many characters gives the same pieces whatever the size of a block, and all of its text."""
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    text = "theremarkablehistoryofinformation" * 40
    whole, _ = pieces.encode([text], np.ones(1, np.uint64), v, 3)
    for step in (7, 64, 1000):
        monkeypatch.setattr(pieces, "STEP", step)
        got, _ = pieces.encode([text], np.ones(1, np.uint64), v, 3)
        assert got.tolist() == whole.tolist() and pieces.decode(got.tolist(), v) == text


def test_fingerprints_of_rows_that_share_an_id(spark):
    rows = [(1 if i % 3 else None, t) for i, t in enumerate(texts_of(60))]
    got = simhash.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted(hashlib.sha256(simhash.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(x.edited_sha256 for x in got) == want


def test_too_many_domains_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 2)
    docs = spark.createDataFrame([(i, "a b", f"d{i}") for i in range(3)], "doc_id long, text string, domain string")
    with pytest.raises(ValueError, match="3 domains"):
        mixing.classifier(docs, docs.select("doc_id", "domain"))


def test_scores_do_not_depend_on_what_is_scored_beside():
    texts = [*texts_of(80), "a b c", "a b c"]
    m = quality.fit(features.Sample(pa.array([f"w{i % 2} " + (t or "") for i, t in enumerate(texts)]), np.array([i % 2 for i in range(len(texts))], float)), epochs=3)
    place = features.placed(m.chosen)
    whole = m.score(pa.array(texts), place)
    assert whole.tolist() == [m.score(pa.array([t]), place)[0] for t in texts]
