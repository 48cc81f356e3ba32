"""Bundles, backups and journals: tables out to Parquet or JSON and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_bundle(rows: DataFrame, folder: str) -> None:
    """One JSON object for each row."""
    rows.write.mode("errorifexists").json(folder)


def import_bundle(spark: SparkSession, folder: str, schema, owner: str) -> DataFrame:
    """Rows of a bundle, bound to a new owner."""
    return spark.read.schema(schema).json(folder).withColumn("owner_bot_id", F.lit(owner))


def backup(rows: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """A table as Parquet, laid out by scope columns so that a scoped restore reads its part only."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def restore(spark: SparkSession, folder: str, **scope: str) -> DataFrame:
    out = spark.read.parquet(folder)
    for column, value in scope.items():
        out = out.where(F.col(column) == value)
    return out


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array or of JSON lines: question_id, question, answer, gold, turns (session, position, role, content)."""
    turn = "array<array<struct<role string, content string, has_answer boolean>>>"
    raw = spark.read.schema(
        f"question_id string, question string, question_type string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_sessions {turn}"
    ).option("multiLine", "true" if path.endswith(".json") else "false").json(path)
    sessions = raw.select("question_id", "haystack_session_ids", F.posexplode("haystack_sessions").alias("n", "session"))
    return sessions.select("question_id", F.get("haystack_session_ids", F.col("n")).alias("session_id"), F.posexplode("session").alias("position", "turn")).select(
        "question_id", "session_id", "position", "turn.role", "turn.content", F.coalesce("turn.has_answer", F.lit(False)).alias("has_answer")
    )
