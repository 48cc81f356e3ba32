"""Cases of the third round's findings, each one that gave a wrong result or none before."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import functions as F

from tessera.operators import erasure, graph, index, vector
from tessera.plans import retrieval_queries as R
from tessera.sources import documents as D


def _same(spark, tmp_path, query, sql: str, tables: dict) -> list:
    """Rows of a query over the given tables, which are those of its SQL."""
    folder = str(tmp_path / "tables")
    con = duckdb.connect()
    for name, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{os.path.join(folder, name)}.parquet/*.parquet'")
    found = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    rows = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    assert rows == sorted(result.fetchall(), key=repr)
    return rows


def test_planner_intents_end_words_as_their_sql_does(spark, tmp_path):
    said = ["Osque el noñaróó íado", "я не люблю это", "до 5 мая", "isn’t it", "now and then what", "uno\x0bdos tres cuatro cinco", "First A and then B!", "STEPSñ how", None, "  "]
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(said)], "conv_id int, turn int, role string, text string")
    rows = _same(spark, tmp_path, R.planner_intents, R.ORACLES["planner_intents"], {"conversations": turns})
    assert sum(r[3] for r in rows) >= 2  # the first and the contraction


def test_recall_takes_ties_by_the_id_as_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, "when the rain" if i < 60 else f"other {i}") for i in range(1, 400)], "doc_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "the end and a start")], "conv_id int, turn int, role string, text string")
    events = spark.createDataFrame([(i, "that" if 70 < i < 130 else "click", f"k{i}") for i in range(1, 400)], "event_id long, event_type string, props string")
    rows = _same(spark, tmp_path, R.recall_unified, R.ORACLES["recall_unified"], {"documents": docs, "conversations": turns, "events": events})
    assert len(rows) == 20


def test_reachable_beyond_the_limit_of_recursive_queries(spark):
    edges = spark.createDataFrame([("s", "x"), ("x", "s"), ("x", None), ("x", "y"), ("s", "y"), ("z", "w")], "a string, b string")
    assert sorted(map(tuple, graph.reachable(edges, "s", 5).collect()), key=str) == [("s", 0), ("x", 1), ("y", 1), (None, 2)]
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        wide = spark.range(200).selectExpr("'s' as a", "concat('n', id) as b")
        assert graph.reachable(wide, "s", 3).count() == 201
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)


def test_simhash_blocks_follow_the_bits_that_vary(spark):
    import random

    draw = random.Random(3)
    low = [x * 1048573 + r for x in range(1, 400) for r in range(3)]  # the upper 34 bits are the same for all
    hashes = [h - (1 << 64) if h >> 63 else h for h in [*low, *(h ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for h in low[:200])]]
    rows = spark.createDataFrame(list(enumerate(hashes)) + [(9_998, None), (9_999, hashes[0])], "id long, h long")
    first = {h: i for i, h in reversed(list(enumerate(hashes)))}
    kept = sorted((i, h & (1 << 64) - 1) for h, i in first.items())
    wanted = sorted((a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(kept) for b, y in kept[i + 1 :] if (x ^ y).bit_count() <= 3)
    assert sorted(map(tuple, vector.simhash_neighbours(rows, "id", "h").collect())) == wanted
    only = rows.where("id < 1000")
    masks = vector._dealt_bits(only, "h", 3)
    assert sum(m.bit_count() if m >= 0 else (m & (1 << 64) - 1).bit_count() for m in masks) == 64
    for pair in [(i, j) for i in range(len(masks)) for j in range(i)]:  # no key takes in more than a few rows
        mask = (masks[pair[0]] | masks[pair[1]]) & (1 << 64) - 1
        found = [h & mask for h in hashes[:1000]]
        assert max(found.count(x) for x in set(found)) < 200


def test_answers_in_units_are_those_of_each_question_alone(spark, monkeypatch):
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    said = [" ".join(draw.choices(words, weights=[60 / (i + 1) for i in range(60)], k=draw.randrange(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame([(i, said[i % 400 if i % 3 else 7]) for i in range(900)], "id long, text string")
    asked = spark.createDataFrame([(f"q{i}", said[i] if i % 4 else said[11]) for i in range(120)] + [("none", "unheard"), ("null", None)], "query_id string, query string")
    monkeypatch.setattr(index, "CHUNK", 150)
    monkeypatch.setattr(index, "BLOCK", 30)
    own = index.build(rows, "id", "text")
    found = own.answers(asked, 5)
    cut = {r["query_id"]: list(dict.fromkeys((r["query"] or "").split()))[:12] for r in asked.collect()}
    names = [q for q in cut if cut[q]]
    alone = own.best([cut[q] for q in names], 900).withColumn("s", F.round("score", 9)).collect()
    wanted = []
    for i, q in enumerate(names):
        best = sorted((-r["s"], r["id"]) for r in alone if r["query"] == i)[:5]
        wanted += [(q, x, -s, rank) for rank, (s, x) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()) == sorted(wanted)



def test_units_leave_a_task_in_small_frames():
    import pandas as pd

    files = pd.DataFrame([(i, "a.jsonl", "\n".join(f'{{"n":{j}}}' for j in range(300))) for i in range(30)], columns=["k", "name", "raw"])
    taken = []
    fake = type("Files", (), {"dtypes": [("k", "bigint")], "select": lambda self, *c: self, "mapInPandas": lambda self, run, schema: taken.append(run)})()
    D.units_of(fake, ["k"], "name", "raw")
    frames = list(taken[0](iter([files])))
    assert max(map(len, frames)) <= D.HELD and sum(map(len, frames)) == 9_000
    whole = pd.concat(frames)
    assert whole.groupby("k").size().tolist() == [300] * 30 and whole["ordinal"].tolist() == list(range(300)) * 30



def test_windows_of_markers_leave_a_task_in_small_batches():
    pa = erasure.pa
    search = type("All", (), {"lengths": {1: [1]}, "windows": lambda self, part, begin, limit: [(begin + i, 1, i) for i in range(len(part) - begin)]})()
    batch = pa.record_batch({"k": list(range(90)), "_text": ["abcd" * 250] * 90})
    found = list(erasure._searched(iter([batch]), search, ["k"]))
    assert max(b.num_rows for b in found) < erasure.HELD + 1_000
    assert sum(b.num_rows for b in found) == 90_000 and set(found[-1].column("k").to_pylist()) <= set(range(90))


def test_chunks_over_batches_without_a_group_for_each_document(spark):
    units = [(k, "heading" if i % 9 == 0 else "p", "x" * (50 + 37 * (i * k % 11)), f"t{i // 9}", i) for k in range(40) for i in range(25)] + [(99, "p", "y" * 13_000, "", 0), (None, "p", "of no document", "", 0)]
    frame = spark.createDataFrame(units, "k long, kind string, text string, title string, ordinal int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = D.chunked(frame, ["k"])
    assert "FlatMapGroups" not in whole._jdf.queryExecution().toString()
    rows = sorted(map(tuple, whole.collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, D.chunked(frame, ["k"]).collect()), key=str) == rows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for k in (1, 7, 99, None):
        own = [r for r in rows if r[0] == k]
        assert sorted(r[1] for r in own) == list(range(len(own)))
        assert "".join(r[2].replace("\n", "") for r in sorted(own, key=lambda r: r[1])) == "".join(u[2] for u in units if u[0] == k)
