"""The pipeline's stages one by one, and the corpus queries that have SQL."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import ngram_join, queries
from tessera.llm.text import brute_words

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def shingles(text):
    w = brute_words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, documents, tmp_path):
    docs, before = documents, {r.doc_id: r.text for r in documents.collect()}
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert all(seen[n].columns == COLUMNS for n in ("quality", "lines", "near_duplicates", "mixing"))
    assert not rows(seen["quality"]) - rows(documents)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert len(kept.intersection(good)) >= 0.95 * len(good)
    for r in seen["lines"].collect():
        lines = before[r.doc_id].split("\n")
        assert r.n_chars == len(r.text) and not Counter(r.text.split("\n")) - Counter(lines)
    left = seen["near_duplicates"].collect()
    sets = [shingles(r.text) for r in left]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or not b or len(a & b) / len(a | b) < 0.8
    gone = rows(seen["lines"]) - rows(seen["near_duplicates"])
    linked = {r.doc_id for r in ngram_join.ngram_jaccard_join(seen["lines"]).where("n_links > 0").collect()}
    assert {r[0] for r in gone} <= linked
    assert {r.doc_id for r in seen["mixing"].collect()} <= {r.doc_id for r in left}
    assert all(r.lossless for r in seen["pieces"].collect()) and seen["pieces"].count() == seen["mixing"].count()
    assert rows(corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_chars", "n_pieces")) == rows(seen["pieces"].select("doc_id", "n_chars", "n_pieces"))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_no_documents(spark, documents, stage):
    assert stage(spark, documents.where("false"), FOLDER).count() == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = Counter(map(str, found.fetchall()))
    assert Counter(str(tuple(r[n] for n in names)) for r in queries.queries()[name](spark, FOLDER).collect()) == want
