"""Transactions, migration by bucket hashes, and files by revision, against plain versions and broken-off runs."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from tessera.operators import journal, migration
from tessera.sources.revised import Reader
from tessera.streaming import inbox

LOG = "scope string, revision long, tx string, op string, key long, value double"


def plain_state(rows):
    """{(scope, key): (revision, value)} by following the log row by row."""
    open_, stack, undone = {}, {}, {}
    for scope, revision, tx, op, key, value in sorted(rows, key=lambda r: r[1]):
        s, u = stack.setdefault(scope, []), undone.setdefault(scope, [])
        if op == "undo":
            if s:
                u.append(s.pop())
        elif op == "redo":
            if u:
                s.append(u.pop())
        elif tx is None:
            if op in journal.MUTATIONS:
                s.append([(key, revision, op, value)])
                u.clear()
        elif op == "begin" or op == "abort":
            open_[scope, tx] = []
        elif op == "commit":
            s.append(open_.pop((scope, tx), []))
            u.clear()
        else:
            open_.setdefault((scope, tx), []).append((key, revision, op, value))
    out = {}
    for scope, groups in stack.items():
        held = {}
        for group in groups:
            for key, revision, op, value in group:
                held[key] = (revision, value) if op == "upsert" else None
        out |= {(scope, k): v for k, v in held.items() if v}
    return out


def test_transactions_against_a_plain_fold(spark):
    r = random.Random(4)
    ops = ["begin", "commit", "commit", "abort", "undo", "undo", "redo", "delete", *["upsert"] * 6]
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, "t1", "t2", "t3"]), r.choice(ops), r.randrange(5), float(i)) for i in range(600)]
    log = spark.createDataFrame(rows, LOG)
    got = {(x.scope, x.key): (x.revision, x.value) for x in journal.state(log, "key").collect()}
    assert got == plain_state(rows) and len(got) > 5
    assert journal.state(log.limit(0), "key").count() == 0


def test_undo_and_redo(spark):
    def held(*rows):
        return {x.key: x.value for x in journal.state(spark.createDataFrame([("s", i, *row) for i, row in enumerate(rows)], LOG), "key").collect()}

    up = lambda v, tx=None: (tx, "upsert", 1, float(v))
    control = lambda op, tx=None: (tx, op, None, None)
    assert held(up(1), up(2), control("undo")) == {1: 1.0}
    assert held(up(1), up(2), control("undo"), control("undo"), control("undo"), control("redo")) == {1: 1.0}
    assert held(up(1), up(2), control("undo"), up(3), control("redo")) == {1: 3.0}
    assert held(up(1), control("begin", "t"), up(5, "t")) == {1: 1.0}
    assert held(up(1), control("begin", "t"), up(5, "t"), control("commit", "t"), control("undo")) == {1: 1.0}
    assert held(control("begin", "t"), up(5, "t"), up(1), control("commit", "t")) == {1: 5.0}  # in effect when committed


def test_lineage_says_what_held_when(spark):
    rows = [("s", 0, None, "upsert", 1, 1.0), ("s", 1, "t", "begin", None, None), ("s", 2, "t", "upsert", 1, 2.0), ("s", 3, "t", "commit", None, None), ("s", 4, None, "delete", 1, None)]
    got = [(x.revision, x.tx, x.since, x.until, x.place) for x in journal.lineage(spark.createDataFrame(rows, LOG), "key").orderBy("place").collect()]
    assert got == [(0, None, 0, 3, 1), (2, "t", 3, 4, 2), (4, None, 4, None, 3)]


def _rows(spark, n, changed=()):
    return spark.range(n).select("id", F.when(F.col("id").isin(list(changed)), "new").otherwise(F.md5(F.col("id").cast("string"))).alias("digest"))


def test_only_buckets_that_differ_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    everything = migration.reconcile(_rows(spark, 3_000), root, "v1", "id", "digest")
    assert len(everything) == 256 and migration.reconcile(_rows(spark, 3_000), root, "v1", "id", "digest") == []
    written = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/v1") for f in names if f.startswith("part-")}
    before = written()
    changed = migration.reconcile(_rows(spark, 3_000, (7, 8)), root, "v1", "id", "digest")
    assert 1 <= len(changed) <= 2 and len(before.keys() & written().keys()) == 256 - len(changed)
    found = {x.id: x.digest for x in migration.stored(spark, root, "v1", _rows(spark, 1).schema).collect()}
    assert len(found) == 3_000 and found[7] == found[8] == "new"
    few = spark.range(2_999, 3_000).select("id", F.lit("only").alias("digest"))
    migration.reconcile(few, root, "v1", "id", "digest")
    assert [x.digest for x in migration.stored(spark, root, "v1", few.schema).collect()] == ["only"]
    assert len(migration.reconcile(few.limit(0), root, "v1", "id", "digest")) == 1 and migration.stored(spark, root, "v1", few.schema).count() == 0


def test_a_copy_that_broke_off_goes_on(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    source = _rows(spark, 2_000)
    half = source.where(migration.bucket(F.col("id").cast("string")) < "80")
    migration.reconcile(half, root, "v2", "id", "digest")  # as if it had ended there
    rest = migration.reconcile(source, root, "v2", "id", "digest")
    assert rest and min(rest) >= "80" and migration.differing(migration.tree(source, "id", "digest"), migration.tree(migration.stored(spark, root, "v2", source.schema), "id", "digest")).count() == 0
    assert migration.current(spark, root) is None
    for version in ("v1", "v2"):
        migration.switch(spark, root, version)
        assert migration.current(spark, root) == version
    assert not [f for f in os.listdir(root) if f.startswith("_next")]


def test_an_inbox_follows_its_files(spark, tmp_path):
    box, root = tmp_path / "in", str(tmp_path / "state")
    (box / "deep").mkdir(parents=True)
    put = lambda name, text: (box / name).write_text(text)
    full = lambda: {str(p.relative_to(box)): p.read_text() for p in box.rglob("*") if p.is_file() and p.name[0] not in "._"}
    run = lambda **o: {x.uri: x.text for x in inbox.take_in(spark, root, folder=str(box), **o).collect()}
    put("a.txt", "one"), put("deep/b.txt", "two"), put(".hidden", "no"), put("_part", "no")
    assert run() == full() == {"a.txt": "one", "deep/b.txt": "two"}
    put("c.txt", "three"), put("a.txt", "one more")
    assert run() == full()
    (box / "deep" / "b.txt").unlink()
    put("d.txt", "é")
    assert run() == full() == run()
    inbox.compact(spark, root)
    assert {x.uri: x.text for x in inbox.state(spark, root).collect()} == full()
    inbox.compact(spark, root)
    (box / "a.txt").unlink()
    assert run() == full() and run(settle="3600") == {}  # nothing is old enough, so all of it waits


def test_unchanged_files_are_not_read(tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "b").write_text("y")
    reader = Reader({"folder": str(tmp_path), "per_task": "1"})
    first = reader.latestOffset()
    assert [p.files[0][0] for p in reader.partitions(reader.initialOffset(), first)] == ["a", "b"]
    (tmp_path / "b").write_text("longer")
    (tmp_path / "a").unlink()
    parts = reader.partitions(first, reader.latestOffset())
    assert [[u for u, _ in p.files] for p in parts] == [["b"], []] and parts[1].gone == ["a"]
    assert [row for p in parts for row in reader.read(p)] == [("b", parts[0].files[0][1], "longer", False), ("a", None, None, True)]


class Remote:
    """A store whose files are named by its options."""

    def __init__(self, options):
        self.names = options["names"].split(",")

    def listing(self):
        return {n: f"rev-{len(n)}" for n in self.names}

    def fetch(self, uri, revision):
        return f"{uri}@{revision}".encode()


def test_a_remote_store_is_a_source(spark, tmp_path):
    root = str(tmp_path / "state")
    ask = lambda names: {x.uri: x.text for x in inbox.take_in(spark, root, store="tests.test_journal_stores:Remote", names=names).collect()}
    assert ask("one,three") == {"one": "one@rev-3", "three": "three@rev-5"}
    assert ask("three,four") == {"three": "three@rev-5", "four": "four@rev-4"}
