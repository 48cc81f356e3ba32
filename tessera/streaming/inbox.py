"""An inbox of files as a stream: new and changed files are taken in, those that are gone are pruned, however often a batch repeats.

Every batch writes its rows under its number. The state is, of each uri, the row of the last batch, unless it says deleted; so
a batch that is repeated after a failure overwrites its own rows and changes nothing else. ``compact`` folds the batches
into one, so that reading the state doesn't grow with the number of runs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.revised import SCHEMA, RevisedFiles
from tessera.streaming.ledger import _exists


def take_in(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Run until all that is there has been taken in; the state afterwards. options: those of ``revised_files``; root: of checkpoint and state."""
    spark.dataSource.register(RevisedFiles)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/rows/number={number}")

    stream = spark.readStream.format("revised_files").options(**options).load()
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return state(spark, root)


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = f"{SCHEMA}, batch long"
    if not _exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")


def state(spark: SparkSession, root: str) -> DataFrame:
    """(uri, revision, text) of the files that are there."""
    w = Window.partitionBy("uri").orderBy(F.desc("batch"))
    return _rows(spark, root).withColumn("_n", F.row_number().over(w)).where("_n = 1 and not deleted").select("uri", "revision", "text")


def compact(spark: SparkSession, root: str) -> None:
    """Fold all batches into the last one's folder; a reader sees the rows before or, for a moment, some of them twice, which changes nothing."""
    rows = _rows(spark, root)
    last = rows.agg(F.max("batch")).first()[0]
    old = sorted(rows.inputFiles(), key=lambda f: int(re.search(r"/(?:number|folded)=(\d+)/", f)[1]))
    if all("/folded=" in f for f in old):
        return
    w = Window.partitionBy("uri").orderBy(F.desc("batch"))
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not deleted").drop("_n")
    kept.write.mode("overwrite").parquet(f"{root}/rows/folded={last}")
    for f in old:  # the oldest first: a row goes before what deletes it
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
