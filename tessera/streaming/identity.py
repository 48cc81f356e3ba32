"""Event ids over a stream: the first payload of an id stays, equal repeats vanish, other payloads are set aside as conflicts.

State is a hash and a sequence number for each id. An id whose events have stopped for ``forget`` is dropped by a timer in event
time, which the watermark moves, so state is bounded by the ids of that span. Results are rows marked kept or conflict. Within a
micro-batch the rows of an id count in the order of ``order``, as in a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.staging import shared_dir

#: Keyed state with timers needs the store that keeps columns apart.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = "spark.sql.streaming.stateStore.providerClass"


class FirstPayload(StatefulProcessor):
    """Keeps the hash of each id's first payload; rows are the stream's with a hash, an order and a moment in milliseconds after them."""

    def __init__(self, key: str, columns: list[str], forget_ms: int):
        self.key, self.columns, self.forget_ms = key, columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        every.columns = [*self.columns, "_hash", "_order", "_at"]  # names with an underscore in front don't reach here
        every = every.sort_values("_order", kind="stable")
        held = self.first.get()[0] if self.first.exists() else None
        kind = []
        for h in every["_hash"]:
            if held is None:
                held = h
                kind.append("kept")
            else:
                kind.append("repeat" if h == held else "conflict")
        self.first.update((held,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(every["_at"].max()) + self.forget_ms)
        out = every[self.columns].assign(outcome=kind)
        yield out[out["outcome"] != "repeat"]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def identified(events: DataFrame, key: str, payload: str, order: str, moment: str, lateness: str = "1 hour", forget_seconds: int = 86_400) -> DataFrame:
    """The stream's rows with outcome, kept or conflict; equal repeats of an id are left out. The session's state store must be STORE."""
    columns = events.columns
    own = events.withWatermark(moment, lateness).withColumns({"_hash": F.sha2(F.coalesce(F.col(payload).cast("string"), F.lit("")), 256), "_order": F.col(order), "_at": F.unix_millis(moment)})
    schema = events.schema.add("outcome", "string")
    return own.groupBy(key).transformWithStateInPandas(FirstPayload(key, columns, 1000 * forget_seconds), schema, "Append", "EventTime")


def run_identified(events: DataFrame, key: str, payload: str, order: str, moment: str, name: str, root: str | None = None, **limits: Any) -> tuple[DataFrame, DataFrame]:
    """(kept rows, conflicts) of all that a stream has to read; with the same root a later run goes on where this one ended.

    A batch is written under its number, so one that is repeated overwrites what it wrote.
    """
    spark = events.sparkSession
    root = root or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CONF, None)
    spark.conf.set(CONF, STORE)
    try:
        out = identified(events, key, payload, order, moment, **limits)
        query = (
            out.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(CONF, before) if before else spark.conf.unset(CONF)
    found = spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return found.where("outcome = 'kept'").drop("outcome"), found.where("outcome = 'conflict'").drop("outcome")
