"""Connectors: files on disk, single remote files through a fetcher, published index versions, erasures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.documents import scan

RECORD = "uri string, revision string, text string, fetched boolean"


def observed(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, status) of registered files (path, digest) against what is on disk: current, changed, missing, or new for unregistered ones."""
    both = registry.select("path", F.col("digest").alias("_r")).join(listing.select("path", F.col("digest").alias("_d")), "path", "full")
    status = F.when(F.col("_r").isNull(), "new").when(F.col("_d").isNull(), "missing").when(F.col("_r") == F.col("_d"), "current").otherwise("changed")
    return both.select("path", status.alias("status"))


def file_listing(spark: SparkSession, folder: str, glob: str = "*", min_age_before: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, modificationTime, length, digest) below a folder, the newest ``limit`` files if one is given."""
    rows = scan(spark, folder, glob)
    rows = rows if min_age_before is None else rows.where(F.col("modificationTime") < F.lit(min_age_before).cast("timestamp"))
    rows = rows if limit is None else rows.orderBy(F.desc("modificationTime"), "path").limit(limit)
    return rows.select("path", "modificationTime", "length", F.sha2("content", 256).alias("digest"))


class _One(InputPartition):
    def __init__(self, uri: str):
        self.value = uri


class RemoteFiles(DataSource):
    """``spark.read.format("remote_files")``: one record for each uri of the option ``uris`` (one a line).

    ``FETCH`` must be set to a function of (uri, known revision) that gives (revision, text), or (revision, None) if the
    revision is the known one. There is no network here, so none is set by default.
    """

    FETCH: Callable[[str, str | None], tuple[str, str | None]] | None = None

    @classmethod
    def name(cls) -> str:
        return "remote_files"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _RemoteReader(self.options, type(self).FETCH)


class _RemoteReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.uris, self.known, self.fetch = [u for u in options.get("uris", "").split("\n") if u], options.get("revision"), fetch

    def partitions(self) -> list[InputPartition]:
        return [_One(u) for u in self.uris]

    def read(self, partition) -> Iterator[tuple]:
        if self.fetch is None:
            raise ValueError("no fetcher is set")
        revision, text = self.fetch(partition.value, self.known)
        yield (partition.value, revision, text, text is not None)


def source_list(registry: DataFrame, limit: int = 100) -> DataFrame:
    return registry.where("active").orderBy("source_key").limit(limit)


def source_deleted(registry: DataFrame, key: str) -> DataFrame:
    """A source deleted softly."""
    return registry.withColumn("active", F.col("active") & (F.col("source_key") != key))


def publish(rows: DataFrame, root: str, version: int) -> None:
    """A version of an index beside its predecessors; readers follow ``current_version``, so a switch is one small write."""
    rows.write.mode("errorifexists").parquet(f"{root}/version={version}")
    rows.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}_pointer")


def published(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}_pointer").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/version={version}")


def reindexed(source: DataFrame, index: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows still to be indexed or indexed anew, index rows to be dropped), by key and digest: a copy that can be resumed."""
    todo = source.join(index.select(key, digest), [key, digest], "left_anti")
    return todo, index.join(source.select(key, digest), [key, digest], "left_anti")


def erased(rows: DataFrame, intents: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without erased digests, intents applied by this run): each intent (sequence, digest) is applied once."""
    new = intents.join(applied.select("sequence"), "sequence", "left_anti")
    return rows.join(new.select("digest").distinct(), "digest", "left_anti"), new
