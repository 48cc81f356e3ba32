"""Moving an index to another store: hash trees tell which buckets differ, those alone are copied, and one rename switches.

Rows fall into buckets by the first two hexadecimal digits of the md5 of their key. A tree has a node for each prefix of
length 0 to 2, with its rows and the sum of its rows' hashes, so equal nodes need no look below. A store keeps a version's rows
by bucket in folders; a bucket is replaced as a whole, so a copy that broke off goes on with the buckets that still differ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 2


def bucket(key: Column) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, DIGITS)


def tree(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """(level, node, rows, hash) for every prefix of the buckets that has rows. Sums combine before the shuffle and wrap at 2**61."""
    own = rows.select(bucket(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("node"), F.pmod(F.xxhash64(key, digest), F.lit(1 << 61)).cast("decimal(38,0)").alias("h"))
    level = own.groupBy("node").agg(F.count("*").alias("rows"), (F.sum("h") % (1 << 61)).cast("long").alias("hash"))
    out = level.withColumn("level", F.lit(DIGITS))
    for n in range(DIGITS - 1, -1, -1):
        level = level.groupBy(F.substring("node", 1, n).alias("node")).agg(F.sum("rows").alias("rows"), (F.sum(F.col("hash").cast("decimal(38,0)")) % (1 << 61)).cast("long").alias("hash"))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select("level", "node", "rows", "hash")


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """The buckets of two trees that differ, found from the top: below a node that is equal nothing is compared."""
    parents = None
    for n in range(DIGITS + 1):
        a, b = (t.where(F.col("level") == n).select("node", F.struct("rows", "hash").alias(c)) for t, c in ((one, "_a"), (other, "_b")))
        if parents is not None:
            above = parents.withColumnRenamed("node", "_p")
            a, b = (t.join(above, F.substring(F.col("node"), 1, n - 1) == F.col("_p"), "left_semi") for t in (a, b))
        parents = a.join(b, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
    return parents.withColumnRenamed("node", "bucket")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(spark: SparkSession, root: str, version: str, schema) -> DataFrame:
    """The rows of a version, with their bucket; none if it isn't there."""
    path, fs = _files(spark, f"{root}/{version}")
    own = schema if "bucket" in schema.names else schema.add("bucket", "string")
    return spark.read.schema(own).parquet(f"{root}/{version}") if fs.exists(path) else spark.createDataFrame([], own)


def reconcile(source: DataFrame, root: str, version: str, key: str, digest: str) -> list[str]:
    """Make a version hold the rows of source: buckets that differ are written anew, those without rows deleted. The buckets that differed (256 at most)."""
    spark = source.sparkSession
    plain = spark.createDataFrame([], source.schema).schema
    own = source.withColumn("bucket", bucket(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    there = stored(spark, root, version, plain)
    changed = sorted(r[0] for r in differing(tree(source, key, digest), tree(there, key, digest)).collect())
    if changed:
        (
            own.where(F.col("bucket").isin(changed)).repartition("bucket").write.partitionBy("bucket")
            .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{version}")
        )
        left = {r[0] for r in own.where(F.col("bucket").isin(changed)).select("bucket").distinct().collect()}
        for gone in set(changed) - left:
            path, fs = _files(spark, f"{root}/{version}/bucket={gone}")
            fs.delete(path, True)
    return changed


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the one that readers get: its name is written aside and renamed over the pointer in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside, fs = _files(spark, f"{root}/_next-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    there, _ = _files(spark, f"{root}/_current")
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf).rename(aside, there, overwrite)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers get."""
    path, fs = _files(spark, f"{root}/_current")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
