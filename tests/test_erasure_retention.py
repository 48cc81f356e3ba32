"""Erasure by containment, retention of owners of any size, and event ids over streams, against plain versions."""

from __future__ import annotations

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import erasure, ledger
from tessera.streaming import identity
from tessera.streaming import ledger as S

KEY = b"secret"


def plain(text):
    return re.sub(r"[ \t\n\v\f\r]+", " ", text or "").strip(" ").lower()


def held(text, phrase):
    return any((m == 0 or not re.match(r"\w", text[m - 1])) and (m + len(phrase) == len(text) or not re.match(r"\w", text[m + len(phrase)])) for m in range(len(text)) if text.startswith(phrase, m))


def test_hits_are_those_of_whole_word_search(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = ["a", "an", "ana", "Élan", "b-c", "x_y", "日本", "12", "(q)", "banana"]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "  An\t ANA  "), (503, "an" * 200), (503, "ana"), (None, "élan b-c")]
    phrases = list({" ".join(r.choices(vocabulary, k=r.randrange(1, 6))) for _ in range(60)}) + ["an ana", "", "   ", "z" * 9000, "anan"]
    rows = spark.createDataFrame(texts, "id long, text string")
    known = erasure.markers(spark.createDataFrame([(p,) for p in phrases], "phrase string"), KEY)
    name = {hmac.new(KEY, plain(p).encode(), hashlib.sha256).hexdigest(): plain(p) for p in phrases}
    want = {(i, q) for i, t in texts for q in set(name.values()) if 0 < len(q) <= erasure.MOST and held(plain(t), q)}
    for part in (1 << 20, 16):
        monkeypatch.setattr(erasure, "PART", part)
        assert {(x.id, name[x.digest]) for x in erasure.hits(rows, known, KEY, ["id"], "text").collect()} == want
    assert "phrase" not in known.columns and known.where("digest is null").count() == 0
    left = {x.id for x in erasure.without_contained(rows, known, KEY, ["id"], "text").where("id is not null").collect()}
    assert left == {i for i, _ in texts if i is not None} - {i for i, _ in want if i is not None}


def test_owners_moments_and_exact_markers(spark):
    rows = spark.createDataFrame([(1, "a", 5, "my red fox"), (2, "b", 5, "my red fox"), (3, "a", 20, "red fox"), (4, "a", 10, "red fox")], "id long, owner string, at long, text string")
    said = spark.createDataFrame([("Red  FOX", "a", 10)], "phrase string, owner string, at long")
    ids = lambda known, **k: {x.id for x in erasure.hits(rows, known, KEY, ["id"], "text", **k).collect()}
    assert ids(erasure.markers(said, KEY)) == {1, 2, 3, 4}
    assert ids(erasure.markers(said, KEY), owner="owner", moment="at") == {1, 4}
    assert ids(erasure.markers(said, KEY, substring=False)) == {3, 4}
    assert ids(erasure.markers(said, b"another key")) == set()
    assert ids(erasure.markers(said, KEY).limit(0)) == set() and erasure.hits(rows.limit(0), erasure.markers(said, KEY), KEY, ["id"], "text").count() == 0


def test_containment_is_an_equality_join(spark):
    known = erasure.markers(spark.createDataFrame([("red fox",)], "phrase string"), KEY)
    rows = spark.range(100).select("id", F.lit("a red fox").alias("text"))
    plan = erasure.hits(rows, known, KEY, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin [" in plan and "Nested" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most_rows, most_bytes", [(700, 10**9), (10**9, 9_000), (700, 4_000), (0, 10**9), (10**9, 10**9), (10**9, 1)])
def test_an_owner_with_all_rows_is_cut_by_ranges(spark, monkeypatch, most_rows, most_bytes):
    r = random.Random(1)
    rows = [("big" if i % 5 else f"o{i % 3}" if i % 2 else None, r.choice([None, *range(30)]), i, "é" * r.randrange(0, 20) if i % 7 else None) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "owner string, at long, id long, text string").repartition(4)
    cut = lambda: {x.id for x in ledger.retained(frame, ["owner"], ["at", "id"], ["text"], most_rows, most_bytes).collect()}
    want = cut()
    monkeypatch.setattr(ledger, "RANGE", 100)
    sizes = []
    plain_ranges = ledger._ranges
    monkeypatch.setattr(ledger, "_ranges", lambda *a: sizes.append((made := plain_ranges(*a)).groupBy("_range").count().agg(F.max("count")).first()[0]) or made)
    assert cut() == want
    assert sizes and (sizes[0] or 0) <= 300  # of 2,400 rows of one owner no task gets more than a few ranges' worth


def test_event_ids_over_a_stream_are_those_of_a_batch(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    r = random.Random(2)
    rows = [(i, r.randrange(40), r.choice("ab"), 1_700_000_000 + i) for i in range(300)]
    schema = "event_id long, key long, payload string, at long"

    def more(part):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = S.event_stream(spark, folder, spark.read.parquet(folder).schema, 1)
        kept, clash = identity.run_identified(stream, "key", "payload", "event_id", "ts", "ids", root)
        return sorted(x.event_id for x in kept.collect()), sorted(x.event_id for x in clash.collect())

    for a, b in ((0, 100), (100, 150), (150, 300)):  # a restart between each
        more(rows[a:b])
        got = run()
    first, conflicts = ledger.idempotent(spark.createDataFrame(rows, schema), "key", "payload", "event_id")
    assert got == (sorted(x.event_id for x in first.collect()), sorted(x.event_id for x in conflicts.collect()))
    assert run() == got


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "state")
    kept = None
    for part in ([(1, 7, "a", 10**9)], [(2, 8, "a", 10**9 + 90_000)], [(3, 9, "a", 10**9 + 200_000)], [(4, 7, "b", 10**9 + 200_001)]):
        spark.createDataFrame(part, "event_id long, key long, payload string, at long").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
        stream = S.event_stream(spark, folder, spark.read.parquet(folder).schema, 1)
        kept, clash = identity.run_identified(stream, "key", "payload", "event_id", "ts", "ids", root, lateness="10 seconds", forget_seconds=3600)
    assert sorted(x.event_id for x in kept.collect()) == [1, 2, 3, 4] and clash.count() == 0
