"""Cases of the fourth round's findings, each one that failed before."""

from __future__ import annotations

from test_findings_three import _same

from tessera.operators import index, vector
from tessera.plans import further_queries as Q


def test_simhash_tables_are_never_broadcast(spark):
    rows = spark.range(300).selectExpr("id", "id div 3 * 1048573 + id % 3 as h")
    near = vector.simhash_neighbours(rows, "id", "h")
    hashes = [i // 3 * 1048573 + i % 3 for i in range(300)]
    wanted = [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(300) for b in range(a + 1, 300) if (hashes[a] ^ hashes[b]).bit_count() <= 3]
    assert sorted(map(tuple, near.collect())) == wanted
    plan = near._jdf.queryExecution().executedPlan().toString()  # the one that ran, with what Spark changed meanwhile
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_answer_policies_use_the_words_after_the_twelfth(spark, tmp_path):
    begin = " ".join(f"b{i}" for i in range(12))
    replies = [(i, 1, "assistant", f"so alpha{i} beta{i} gamma{i} delta{i}") for i in range(300)]
    asked = [(7, 0, "user", f"{begin} alpha7 beta7, gamma7 delta7"), (8, 0, "user", "alpha8 beta8 gamma8 delta8"), (9, 0, "user", f"{begin} so"), (10, 0, "user", None)]
    turns = spark.createDataFrame(replies + asked, "conv_id int, turn int, role string, text string")
    rows = _same(spark, tmp_path, Q.answer_policies, Q.ORACLES["answer_policies"], {"conversations": turns})
    assert {r[0]: r[1] for r in rows} == {"000007-0000": 1, "000008-0000": 1, "000009-0000": 0, "000010-0000": 0}


def test_blocks_of_questions_follow_their_terms(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c{i % 13} d{i}") for i in range(200)], "id long, text string")
    long = " ".join(f"d{i}" for i in range(200))
    asked = spark.createDataFrame([(f"q{i}", f"{long} a{i % 7} b{i % 11} c{i % 13}") for i in range(40)], "query_id string, query string")
    own = index.build(rows, "id", "text")
    plans, written = [], index.stage
    whole = sorted(map(tuple, own.answers(asked, 3, most_terms=None).collect()))
    monkeypatch.setattr(index, "BLOCK", 40)  # all of the questions
    monkeypatch.setattr(index, "TERMS", 24)  # but not all of their terms
    monkeypatch.setattr(index, "stage", lambda df, name, *a: plans.append(df._jdf.queryExecution().toString()) or written(df, name, *a))
    assert sorted(map(tuple, own.answers(asked, 3, most_terms=None).collect())) == whole and len(whole) == 120
    assert "sequence(0, 8," in next(x for x in plans if "FlatMapCoGroups" in x)  # 40 x 203 terms make 9 blocks
