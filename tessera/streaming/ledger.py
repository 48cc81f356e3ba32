"""Structured Streaming over ledgers: capture, deduplication, daily counters, sessions, incremental observations.

Every flow is exactly-once: file sources and checkpoints in the shared folder, and sinks that overwrite by batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ledger, observe
from tessera.plans.staging import shared_dir


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16, glob: str = "*.parquet") -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def captured(events: DataFrame, content: str = "content", most: int = 4000) -> DataFrame:
    """Events fit to keep: none that is all secret; secrets redacted, instructions filtered, long texts cut to head and tail. Batch or stream."""
    # Each step is a column of its own: the guard names its text many times over.
    clean = events.withColumn("_clean", T.redacted(F.col(content))).withColumn("source_length", F.length(content))
    kept = clean.where(F.length(F.regexp_replace("_clean", r"<REDACTED[A-Z_]*>|\s", "")) > 0)
    whole = kept.withColumn("_shown", T.sanitized(F.col("_clean"), 200_000)).withColumn(content, T.excerpt(F.col("_shown"), most)).drop("_clean", "_shown")
    return whole.withColumn("truncated", F.col("source_length") > most).withColumn("content_hash", F.sha2(content, 256))


def first_of_each(events: DataFrame, key: str, moment: str, lateness: str = "1 hour") -> DataFrame:
    """The first event of each id; state is dropped when the watermark has passed."""
    return events.withWatermark(moment, lateness).dropDuplicatesWithinWatermark([key])


def daily_counters(events: DataFrame, operation: str, outcome: str, ms: str, moment: str, lateness: str = "1 day") -> DataFrame:
    """The latency histogram by day as a stream: bounded state, one row for each day, operation, outcome and bucket."""
    whole = F.greatest(F.lit(0), F.least(F.lit(ledger.MOST_MS), F.bround(F.col(ms), 0))).cast("long")
    by = events.withWatermark(moment, lateness).groupBy(
        F.window(moment, "1 day").alias("day"), F.col(operation).alias("operation"), F.col(outcome).alias("outcome"), ledger.latency_bucket(F.col(ms)).alias("latency_bucket_ms")
    )
    return by.agg(F.count("*").alias("sample_count"), F.sum(whole).alias("duration_sum_ms"), F.max(whole).alias("duration_max_ms"))


def user_sessions(events: DataFrame, user: str, moment: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap."""
    own = events.withWatermark(moment, lateness).groupBy(user, F.session_window(moment, gap).alias("session"))
    return own.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(user, F.col("session.start").alias("begin"), F.col("session.end").alias("end"), "events", "value")


def running_usage(events: DataFrame, by: str, size: str) -> DataFrame:
    """Rows and bytes of each partition so far (update mode)."""
    return events.groupBy(by).agg(F.count("*").alias("row_count"), F.sum(F.octet_length(size)).alias("byte_count"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """What a stream gives when it has read all that is there, as a table in the shared folder.

    Complete and update results keep the last row of each batch's write by batch number, so a repeated batch overwrites.
    root: the folder of checkpoint and results; with the same root a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("_batch", "integer")
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out") if _exists(spark, f"{root}/out") else spark.createDataFrame([], schema)
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        out = out.where(F.col("_batch") == (last if last is not None else -1))
    return out.drop("_batch")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def consolidate_stream(events: DataFrame, by: list[str], name: str, now: int, root: str | None = None) -> DataFrame:
    """Observations of a stream of events.

    A batch writes what its own events say of their clusters, under its number, so its work follows its size and a repeated
    batch overwrites; partials add up to the observations when these are read. root: as in ``run_to_end``.
    """
    spark = events.sparkSession
    root = root or f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        observe.partials(batch, by, True).write.mode("overwrite").parquet(f"{root}/partials/batch={number}")

    query = events.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = observe.partials(spark.createDataFrame([], events.schema), by, True).schema
    parts = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/partials") if _exists(spark, f"{root}/partials") else spark.createDataFrame([], schema)
    return observe.merged(parts, by, now)
