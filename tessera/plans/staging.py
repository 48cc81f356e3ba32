"""Tables written to the shared folder, so that lineage ends there and every executor can read them again.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is unset and the master is
local, as in tests, a temporary folder stands in for it: on a cluster each executor would write to a disk of its own.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Where the staged tables that are still in use lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables, without a closing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _FALLBACK[app]


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there. options: those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; frames that ``stage`` didn't return are left alone."""
    for df in staged:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has staged, indexes too: for its end, when no frame that reads them is used any more."""
    from tessera.operators import index

    index._BUILT.clear()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages; call it once their results are staged.

    Spark drops them when the driver's JVM has collected the plans, and that holds only after Python has let go of them.
    """
    import gc
    import time

    if not hasattr(spark.sparkContext, "_jvm"):  # a client without the driver's JVM
        return
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
