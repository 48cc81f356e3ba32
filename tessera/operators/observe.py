"""Derived observations: events that say the same become one observation, by a grouping.

Two texts say the same exactly if their words in order, articles aside, are equal, so consolidation groups by
(partition, topic, key) with no comparison of pairs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.patterns import OBSERVED_WORD, SOFT_WORDS

RAW_TOPICS = ("dialogue_turn", "visual_ocr")


def folded(text: Column) -> Column:
    """NFKC and full case folding, which Spark SQL lacks; for texts beyond ASCII."""

    def fold(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return F.pandas_udf(fold, "string")(text)


def normalized(text: Column, ascii_only: bool = False) -> Column:
    """Words in order, folded, joined by spaces, 4,000 characters at most. With ascii_only lower() does, in the JVM."""
    whole = F.lower(text) if ascii_only else folded(text)
    return F.substring(F.array_join(F.regexp_extract_all(whole, F.lit(OBSERVED_WORD), F.lit(0)), " "), 1, 4000)


def cluster_key(normal: Column, topic: Column) -> Column:
    """The words without articles; all of the text for raw topics."""
    words = F.filter(F.split(normal, " "), lambda w: ~w.isin(*SOFT_WORDS))
    return F.when(topic.isin(*RAW_TOPICS), normal).otherwise(F.array_join(words, " "))


def confidence(independent: Column, topic: Column) -> Column:
    """.35 + .15 log2(n), no more than .85, or .35 for raw topics; 0 without support."""
    value = F.bround(F.least(F.lit(0.85), 0.35 + 0.15 * F.log2(F.greatest(independent, F.lit(1)))), 4)
    return F.when(independent <= 0, 0.0).when(topic.isin(*RAW_TOPICS), F.least(value, F.lit(0.35))).otherwise(value)


def consolidated(events: DataFrame, by: list[str], now: int = 0, ascii_only: bool = False, keep_days: int = 365) -> DataFrame:
    """One row for each observation: by, topic, cluster_key, observation_id, content, support, independent, confidence, first_seen, last_seen, expires_at.

    events: by, event_id, topic, content, turn_id (may be blank), occurred_at, observed_at, created_at, expires_at. Support counts
    events; independent support counts distinct turns, and events without a turn once together. The content is that of the
    latest event. Expiry is the earliest of the events', and ``keep_days`` from now at most.
    """
    return merged(partials(events, by, ascii_only), by, now, keep_days)


def partials(events: DataFrame, by: list[str], ascii_only: bool = False) -> DataFrame:
    """What some of the events say of their clusters, one row a turn: partials of any parts of the events add up in ``merged``."""
    own = events.withColumn("_k", normalized(F.col("content"), ascii_only)).withColumn("cluster_key", cluster_key(F.col("_k"), F.col("topic"))).where("cluster_key <> ''")
    own = own.withColumn("turn", F.when(F.coalesce("turn_id", F.lit("")) != "", F.col("turn_id")))
    return own.groupBy(*by, "topic", "cluster_key", "turn").agg(
        F.count("*").alias("support"), F.max(F.struct("occurred_at", "observed_at", "created_at", "event_id", "content")).alias("latest"), F.min(F.struct("created_at", "observed_at", "event_id")).alias("first"),
        F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.min(F.when(F.coalesce("expires_at", F.lit(0)) > 0, F.col("expires_at"))).alias("_e"),
    )


def merged(parts: DataFrame, by: list[str], now: int = 0, keep_days: int = 365) -> DataFrame:
    """The observations that partials add up to."""
    out = parts.groupBy(*by, "topic", "cluster_key").agg(
        F.sum("support").alias("support"), (F.count_distinct("turn") + F.max(F.col("turn").isNull().cast("int"))).alias("independent"), F.max("latest")["content"].alias("content"),
        F.min("first")["event_id"].alias("first_event"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("_e").alias("_e"),
    )
    ident = F.concat(F.lit("obs_"), F.substring(F.sha2(F.concat_ws("\0", *by, "topic", F.col("first_event").cast("string")), 256), 1, 24))
    return out.withColumn("observation_id", ident).withColumn("confidence", confidence(F.col("independent"), F.col("topic"))).withColumn(
        "expires_at", F.least(F.coalesce("_e", F.lit(2**62)), F.lit(now + keep_days * 86_400))
    ).drop("_e", "first_event")


def versioned(observations: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of observations that are new or changed since previous(observation_id, version, digest), with their next version."""
    digest = F.sha2(F.to_json(F.struct("content", "support", "independent", "confidence", "first_seen", "last_seen")), 256)
    last = previous.groupBy("observation_id").agg(F.max(F.struct("version", "digest")).alias("_p"))
    own = observations.withColumn("digest", digest).join(last, "observation_id", "left").where(F.col("_p").isNull() | (F.col("_p.digest") != F.col("digest")))
    return own.withColumn("version", F.coalesce(F.col("_p.version"), F.lit(0)) + 1).drop("_p")


def history(changes: DataFrame, key: str, moment: str) -> DataFrame:
    """Before-images as validity intervals: valid_from and valid_to (null for the present row)."""
    w = Window.partitionBy(key).orderBy(moment)
    return changes.withColumn("valid_from", F.col(moment)).withColumn("valid_to", F.lead(moment).over(w)).withColumn("version", F.row_number().over(w))
