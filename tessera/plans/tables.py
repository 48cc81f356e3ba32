"""The generic tables as evidence: claims from documents, episodes from conversations, a ledger from events; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index
from tessera.operators.index import Index
from tessera.operators.lexical import CODE, FOLDED, WORDS

#: The moment that all queries take as now: epoch seconds of 2024-02-01.
NOW = 1_706_745_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_index(spark: SparkSession, sf_dir: str, name: str) -> Index:
    """The index over a table's texts, one of SHAPES, built once a session."""
    source, shape, key, text, analyzer = SHAPES[name]
    return index.of(spark, f"{sf_dir}/{source}.parquet", lambda t: shape(t).select(key, text), key, text, f"{name}-{sf_dir.rstrip('/').rpartition('/')[2]}", analyzer)


def texts(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str, str]:
    """(rows, id column, text column) of one of SHAPES."""
    source, shape, key, text, _ = SHAPES[name]
    return shape(table(spark, sf_dir, source)), key, text


def _spoken(t: DataFrame) -> DataFrame:
    return t.where("role in ('user', 'assistant')")


def _prefixed(prefix: str, *columns: str):
    return F.concat_ws("-", *columns) if not prefix else F.concat(F.lit(prefix), F.concat_ws("-", *columns))


#: Name to table, its rows with ids and texts, id column, text column and analyzer. Episodes, turns and replies are dialogue turns.
SHAPES = {
    "documents": ("documents", lambda t: t, "doc_id", "text", WORDS),
    "episodes": ("conversations", lambda t: _spoken(t).withColumn("id", F.format_string("%06d-%02d-%s", "conv_id", "turn", "role")), "id", "text", WORDS),
    "events": ("events", lambda t: t.withColumn("text", F.concat_ws(" ", "event_type", "props")), "event_id", "text", WORDS),
    "turns": ("conversations", lambda t: _spoken(t).withColumn("id", _prefixed("", "conv_id", "turn", "role")), "id", "text", WORDS),
    "replies": ("conversations", lambda t: t.where("role = 'assistant'").withColumn("id", F.format_string("%06d-%04d", "conv_id", "turn")), "id", "text", WORDS),
    "units": ("documents", lambda t: t.withColumn("id", _prefixed("u", "doc_id")), "id", "text", FOLDED),
    "chunks": ("conversations", lambda t: t.withColumn("id", _prefixed("c-", "conv_id", "turn", "role")), "id", "text", FOLDED),
    "symbols": ("part", lambda t: t.withColumn("id", _prefixed("s", "p_partkey")), "id", "p_name", CODE),
    "code chunks": ("part", lambda t: t.withColumn("id", _prefixed("c", "p_partkey")), "id", "p_type", CODE),
    "lines": ("part", lambda t: t.withColumn("id", _prefixed("l", "p_partkey")), "id", "p_brand", CODE),
}


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that documents lack follow from doc_id by rule."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("source").alias("topic"), F.col("lang").alias("project"), F.col("text").alias("claim"), "n_chars",
        ((d * 7 % 100) / 100.0).alias("confidence"), ((d * 13 % 100) / 100.0).alias("salience"), (d % 17).alias("access_count"),
        F.when(d % 11 == 0, "archived").otherwise("active").alias("status"), (d % 19 == 0).alias("pinned"),
        (F.lit(NOW) - d * 7919 % 7_776_000).alias("updated_at"), F.when(d % 3 == 0, F.lit(NOW) - d * 104_729 % 7_776_000).otherwise(0).alias("freshness_at"),
    )


CLAIMS = f"""claims as (select doc_id as id, source as topic, lang as project, text as claim, n_chars, (doc_id * 7 % 100) / 100.0 as confidence,
    (doc_id * 13 % 100) / 100.0 as salience, doc_id % 17 as access_count, case when doc_id % 11 = 0 then 'archived' else 'active' end as status, doc_id % 19 = 0 as pinned,
    {NOW} - doc_id * 7919 % 7776000 as updated_at, case when doc_id % 3 = 0 then {NOW} - doc_id * 104729 % 7776000 else 0 end as freshness_at from documents)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "props", F.unix_timestamp("ts").alias("occurred_at"), (F.unix_timestamp("ts") + F.col("event_id") % 5).alias("created_at"),
        F.concat(F.lit("bot"), (u % 3).cast("string")).alias("owner_bot_id"), F.concat(F.lit("chat"), (u % 20).cast("string")).alias("owner_chat_hash"),
        F.concat(F.lit("s"), (u % 40).cast("string")).alias("owner_session_hash"), F.concat(F.lit("p"), (u % 5).cast("string")).alias("project_id"),
        F.when(u % 4 == 0, "bot").when(u % 4 == 1, "project").otherwise("chat").alias("visibility_scope"), F.when(F.col("event_id") % 7 == 0, F.unix_timestamp("ts") + 864_000).otherwise(0).alias("expires_at"),
    )


LEDGER = """ledger as (select event_id, event_type, value, props, cast(floor(epoch(ts)) as bigint) as occurred_at, cast(floor(epoch(ts)) as bigint) + event_id % 5 as created_at,
    'bot' || (user_id % 3) as owner_bot_id, 'chat' || (user_id % 20) as owner_chat_hash, 's' || (user_id % 40) as owner_session_hash, 'p' || (user_id % 5) as project_id,
    case when user_id % 4 = 0 then 'bot' when user_id % 4 = 1 then 'project' else 'chat' end as visibility_scope,
    case when event_id % 7 = 0 then cast(floor(epoch(ts)) as bigint) + 864000 else 0 end as expires_at from events)"""
