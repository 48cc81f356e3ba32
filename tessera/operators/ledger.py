"""Ledgers of episodes and events: usage, retention, idempotent writes, queues, online metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.patterns import LATENCY_BUCKETS
from tessera.plans.staging import discard, stage

MOST_MS = LATENCY_BUCKETS[-1]


def usage(rows: DataFrame, by: list[str], size: list[str]) -> DataFrame:
    """Rows and UTF-8 bytes of the size columns for each owner or partition."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.sum(_bytes(size)).alias("byte_count"))


def _bytes(columns: list[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out.cast("long")


def partition_keys(scope: str = "visibility_scope") -> dict[str, Column]:
    """The keys of a scope's partition: a key that the scope doesn't use is empty."""
    s = F.col(scope)
    return {
        "chat_key": F.when(s == "chat", F.col("owner_chat_hash")).otherwise(""), "session_key": F.when(s == "chat", F.col("owner_session_hash")).otherwise(""),
        "project_key": F.when(s == "project", F.col("project_id")).otherwise(""),
    }


#: Rows that one sort takes; a partition with more is summed by ranges of its order first.
RANGE = 200_000


def _together(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join on columns where nulls are equal; right's keep no names of their own."""
    named = right.select(*[F.col(c).alias(f"_k{i}") if c in by else F.col(c) for i, c in enumerate(right.columns)])
    keys = [f"_k{i}" for i, c in enumerate(right.columns) if c in by]
    on = [F.col(c).eqNullSafe(F.col(f"_k{right.columns.index(c)}")) for c in by]
    return left.join(named, on, how).drop(*keys)


def retained(rows: DataFrame, by: list[str], newest: list[str], size: list[str], most_rows: int, most_bytes: int) -> DataFrame:
    """The longest newest-first prefix of each partition within both limits; a newest row above the byte limit goes too.

    newest: columns by which larger is newer, nulls oldest; together they must tell the rows of a partition apart. Where no
    partition has more than RANGE rows, sizes add up in a running window. Otherwise the order's columns alone are dealt
    into ranges, of about RANGE rows, whichever partition they belong to; rows and bytes add up by range, which gives the range that a
    limit cuts and what lies before it; only that range is sorted, for its first row that goes. Rows newer than that stay.
    """
    order = [F.desc_nulls_last(c) for c in newest]
    sized = rows.withColumn("_b", _bytes(size))
    totals = sized.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_b").alias("_t"))
    largest = totals.agg(F.max("_n")).first()[0] or 0
    if largest <= RANGE:
        w = Window.partitionBy(*by).orderBy(*order)
        marked = sized.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.where((F.col("_n") <= most_rows) & (F.col("_b") <= most_bytes)).drop("_n", "_b")
    over = totals.where((F.col("_n") > most_rows) | (F.col("_t") > most_bytes))
    ranges = _ranges(_together(sized.select(*by, *[c for c in newest if c not in by], "_b"), over.select(*by), by, "left_semi"), by, order)
    first = stage(_first_gone(ranges, by, newest, order, most_rows, most_bytes), "retained-cuts")
    discard(ranges)
    newer = F.col("_first").isNull() | (F.struct(*newest) > F.col("_first"))
    return _together(rows, first, by, "left").where(newer).select(*rows.columns)


def _ranges(keys: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Keys with the number of their range, staged, so that a number stays what it is."""
    n = max(1, -(-keys.count() // RANGE))
    return stage(keys.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "retained-ranges")


def _first_gone(ranges: DataFrame, by: list[str], newest: list[str], order: list[Column], most_rows: int, most_bytes: int) -> DataFrame:
    """(by, _first): the newest row of each partition that goes, as a struct of the order's columns."""
    sums = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sum("_b").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    placed = sums.withColumns({"_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_t0": F.coalesce(F.sum("_t").over(before), F.lit(0))})
    crossed = placed.where((F.col("_n0") + F.col("_n") > most_rows) | (F.col("_t0") + F.col("_t") > most_bytes))
    cut = crossed.groupBy(*by).agg(F.min(F.struct("_range", "_n0", "_t0")).alias("_c")).select(*by, "_c.*")
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    inside = _together(ranges, cut, [*by, "_range"], "inner")
    inside = inside.withColumn("_n", F.col("_n0") + F.row_number().over(w)).withColumn("_t", F.col("_t0") + F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = inside.where((F.col("_n") > most_rows) | (F.col("_t") > most_bytes))
    return gone.groupBy(*by).agg(F.min_by(F.struct(*newest), "_n").alias("_first"))


def newest_versions(versions: DataFrame, key: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def evidence_sample(links: DataFrame, key: str, order: list[str], most: int = 128) -> DataFrame:
    """The oldest quarter and the newest three quarters of ``most`` links of each target; all of them if there are no more."""
    old = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    new = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return links.withColumn("_o", old).withColumn("_n", new).where((F.col("_o") <= most // 4) | (F.col("_n") <= most - most // 4)).drop("_o", "_n")


def latest_operation(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last operation of each object: what an outbox still has to send."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def idempotent(events: DataFrame, key: str, payload: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each id, rows that repeat an id with another payload): equal repeats vanish."""
    w = Window.partitionBy(key).orderBy(order)
    marked = events.withColumn("_h", F.sha2(F.col(payload), 256)).withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("_h").over(w))
    return marked.where("_n = 1").drop("_h", "_n", "_first"), marked.where("_n > 1 and _h <> _first").drop("_h", "_n", "_first")


def coalesced_jobs(requests: DataFrame) -> DataFrame:
    """One live job for each key, at the highest watermark that was asked for."""
    return requests.groupBy("job_key").agg(F.max("watermark").alias("watermark"), F.count("*").alias("requests"))


def backoff(attempts: Column, base: int = 30, cap: int = 3600) -> Column:
    """Seconds to wait after an attempt: base * 2**(attempts - 1), no more than cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1)).cast("long")


def job_health(jobs: DataFrame, now: int, most_attempts: int = 5) -> DataFrame:
    """Counts by state, jobs that are dead after ``most_attempts``, leases that ran out, and the oldest pending job's age."""
    state = F.col("status")
    return jobs.agg(
        F.count_if(state == "pending").alias("pending"), F.count_if(state == "running").alias("running"), F.count_if(state == "done").alias("done"),
        F.count_if((state == "dead") | (F.col("attempts") >= most_attempts)).alias("dead"), F.count_if((state == "running") & (F.col("lease_until") < now)).alias("expired_leases"),
        (F.lit(now) - F.min(F.when(state == "pending", F.col("created_at")))).alias("oldest_pending_age"),
    )


def undecided(events: DataFrame, decisions: DataFrame, retries: DataFrame, now: int) -> DataFrame:
    """Events without a decision that have no retry or whose retry is due."""
    rest = events.join(decisions.select("event_id"), "event_id", "left_anti")
    return rest.join(retries.select("event_id", F.col("due_at").alias("_due")), "event_id", "left").where(F.col("_due").isNull() | (F.col("_due") <= now)).drop("_due")


def latency_bucket(ms: Column) -> Column:
    """The first bound that holds a duration in milliseconds, which is rounded and kept within 0 and 300,000."""
    whole = F.greatest(F.lit(0), F.least(F.lit(MOST_MS), F.bround(ms, 0))).cast("int")
    bucket = F.lit(MOST_MS)
    for bound in reversed(LATENCY_BUCKETS):
        bucket = F.when(whole <= bound, bound).otherwise(bucket)
    return bucket


def latency_histogram(samples: DataFrame, operation: str, outcome: str, ms: str, moment: str) -> DataFrame:
    """Daily counters by operation, outcome and bucket: sample_count, duration_sum_ms, duration_max_ms."""
    whole = F.greatest(F.lit(0), F.least(F.lit(MOST_MS), F.bround(F.col(ms), 0))).cast("long")
    return samples.groupBy(
        F.floor(F.unix_timestamp(moment) / 86400).alias("day_utc"), F.col(operation).alias("operation"), F.col(outcome).alias("outcome"), latency_bucket(F.col(ms)).alias("latency_bucket_ms")
    ).agg(F.count("*").alias("sample_count"), F.sum(whole).alias("duration_sum_ms"), F.max(whole).alias("duration_max_ms"))


def latency_snapshot(histogram: DataFrame, last_day: int, days: int = 7) -> DataFrame:
    """For each operation over the last days: samples, mean, and upper bounds of the 50th and 95th percentile from the buckets."""
    own = histogram.where(F.col("day_utc").between(last_day - days + 1, last_day))
    by = own.groupBy("operation", "latency_bucket_ms").agg(F.sum("sample_count").alias("n"), F.sum("duration_sum_ms").alias("s"))
    w = Window.partitionBy("operation")
    seen = by.withColumn("_seen", F.sum("n").over(w.orderBy("latency_bucket_ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    upper = lambda f: F.min(F.when(F.col("_seen") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * f)), F.col("latency_bucket_ms")))
    return seen.groupBy("operation").agg(
        F.sum("n").alias("samples"), upper(0.50).alias("latency_p50_upper_ms"), upper(0.95).alias("latency_p95_upper_ms"), F.bround(F.sum("s") / F.sum("n"), 1).alias("latency_mean_ms")
    )
