"""Transactions over an append-only log of mutations: only committed groups count, and groups are undone and redone in turn.

A log has scope (a store that is folded on its own), revision (its order), tx (null for a mutation that commits itself), op
(begin, commit, abort, undo, redo, upsert, delete), the key of what is changed, and value columns. A group is what a tx
writes from a begin, or from its last end, to its commit; what an abort or another begin ends, and what nothing ends, doesn't count.

Effect follows the order of commits. ``undo`` takes back the last group in effect, ``redo`` brings back what the last undo took,
as long as nothing was committed since; either does nothing where there is nothing to do. So the groups in effect are levels of a stack: a
commit fills the level above the present one, undo and redo move the level, and in the end a level's last commit counts. Only
control records, a few numbers a group, pass through that fold, as a sorted stream with two numbers of state; mutations
never do. They meet the groups in effect in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MUTATIONS, ENDS = ("upsert", "delete"), ("commit", "abort")


def grouped(log: DataFrame) -> DataFrame:
    """The log with _group, the number of a tx's group that a row belongs to, counted within (scope, tx); null without a tx.

    A begin opens the next group, and so does the row after an end.
    """
    w = Window.partitionBy("scope", "tx").orderBy("revision")
    opened = F.sum((F.col("op") == "begin").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ended = F.coalesce(F.sum(F.col("op").isin(*ENDS).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = log.where("tx is not null and op not in ('undo', 'redo')").withColumn("_group", opened + ended)
    return own.unionByName(log.where("tx is null or op in ('undo', 'redo')").withColumn("_group", F.lit(None).cast("long")))


def commits(log: DataFrame) -> DataFrame:
    """(scope, tx, _group, at) of committed groups of a grouped log; a mutation without a tx is one of its own."""
    ended = log.where("op = 'commit' and tx is not null").select("scope", "tx", "_group", F.col("revision").alias("at"))
    alone = log.where(F.col("tx").isNull() & F.col("op").isin(*MUTATIONS)).select("scope", "tx", "_group", F.col("revision").alias("at"))
    return ended.unionByName(alone)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, level, at) of each commit, and (scope, level, null) with the last level when a scope ends."""
    scope, level, undone, started = None, 0, 0, False
    schema = None
    for batch in batches:
        schema = pa.schema([batch.schema.field("scope"), ("level", pa.int64()), ("at", pa.int64())])
        out = []
        for s, kind, at in zip(*(batch.column(c).to_pylist() for c in ("scope", "kind", "at")), strict=True):
            if started and s != scope:
                out.append((scope, level, None))
                level = undone = 0
            scope, started = s, True
            if kind == "commit":
                level, undone = level + 1, 0
                out.append((s, level, at))
            elif kind == "undo" and level:
                level, undone = level - 1, undone + 1
            elif kind == "redo" and undone:
                level, undone = level + 1, undone - 1
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, schema.types, strict=True)], schema=schema)
    if started:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((scope, level, None), schema.types, strict=True)], schema=schema)


def in_effect(log: DataFrame) -> DataFrame:
    """(scope, at): the commits of a grouped log that count in the end."""
    control = commits(log).select("scope", "at", F.lit("commit").alias("kind"))
    control = control.unionByName(log.where("op in ('undo', 'redo')").select("scope", F.col("revision").alias("at"), F.col("op").alias("kind")))
    kind = log.schema["scope"].dataType.simpleString()
    levels = control.repartition("scope").sortWithinPartitions("scope", "at").mapInArrow(_levels, f"scope {kind}, level long, at long")
    last = levels.where("at is null").select(F.col("scope").alias("_s"), F.col("level").alias("_top"))
    filled = levels.where("at is not null").groupBy("scope", "level").agg(F.max("at").alias("at"))
    return filled.join(last, filled["scope"].eqNullSafe(last["_s"])).where("level <= _top").select("scope", "at")


def effective(log: DataFrame) -> DataFrame:
    """The mutations that count, with _at, the revision at which they took effect."""
    marked = grouped(log)
    done = commits(marked)
    kept = in_effect(marked)
    groups = done.join(kept.withColumnRenamed("scope", "_s").withColumnRenamed("at", "_at"), F.col("scope").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at"))).select("scope", "tx", "_group", "_at")
    changes = marked.where(F.col("op").isin(*MUTATIONS))
    within = groups.where("tx is not null").toDF("_s", "_t", "_g", "_at")
    in_groups = changes.where("tx is not null").join(within, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("tx") == F.col("_t")) & (F.col("_group") == F.col("_g"))).drop("_s", "_t", "_g")
    alone = groups.where("tx is null").select(F.col("scope").alias("_s"), "_at")
    single = changes.where("tx is null").join(alone, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("revision") == F.col("_at"))).drop("_s")
    return in_groups.unionByName(single).drop("_group")


def state(log: DataFrame, key: str) -> DataFrame:
    """The present rows: of each (scope, key) the last mutation in effect, unless it deletes."""
    w = Window.partitionBy("scope", key).orderBy(F.desc("_at"), F.desc("revision"))
    return effective(log).withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 'upsert'").drop("_n", "op", "_at", "tx")


def lineage(log: DataFrame, key: str) -> DataFrame:
    """Every mutation in effect with since and until, the revisions between which it held, and place, its number in the key's history.

    What a key holds at a revision is the row with since <= revision < until (null: still); so also why it holds it, by tx.
    """
    w = Window.partitionBy("scope", key).orderBy("_at", "revision")
    own = effective(log).withColumns({"place": F.row_number().over(w), "until": F.lead("_at").over(w)})
    return own.withColumnRenamed("_at", "since")
