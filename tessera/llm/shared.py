"""Parts that several operators use: streaming over sorted groups, bitmaps of bounded size and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.staging import stage

#: Documented splitting rule for training rows: a row is held out where this remainder is 0.
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def draw_limit(total: int, most: int) -> int:
    """The largest 63-bit hash that a draw of about most of total rows lets through; above 0 for any total."""
    return min((1 << 63) - 1, -(-(most << 63) // max(total, 1)))


def drawn(rows: DataFrame, total: int, most: int, *columns: str) -> DataFrame:
    """Rows, about ``most`` of ``total``, whose hash of the columns is small: the same rows whenever and wherever it runs."""
    return rows.where(F.shiftrightunsigned(F.xxhash64(*columns), 1) <= F.lit(draw_limit(total, most)))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 0) -> Iterator[pa.Table]:
    """Runs of equal keys in batches that come sorted by them, as tables; with rows, as many whole runs at a time.

    Groups must be bounded by the caller; apart from the run in hand only one batch is held.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def marks(t: pa.RecordBatch) -> np.ndarray:
        changed = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            x = t.column(k).to_numpy(zero_copy_only=False)
            changed |= x[1:] != x[:-1]
        return np.flatnonzero(changed) + 1

    def key(t: pa.RecordBatch, i: int) -> tuple:
        return tuple(t.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and n >= rows and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held, n = [], 0
        cuts = marks(batch)
        start = 0
        for c in cuts.tolist():
            if n + c - start >= rows:
                yield pa.Table.from_batches([*held, batch.slice(start, c - start)])
                held, n, start = [], 0, c
        held.append(batch.slice(start))
        n += batch.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


#: A bitmap has this many bits a key, and never more than 2**MOST_BITS (16 MiB), whatever the number of keys.
BITS_A_KEY, MOST_BITS = 8, 27


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of which one is set for every key: a filter whose size follows the number of keys, up to a fixed bound.

    What it lets through beyond the keys is dropped by the join that follows; it only saves shuffling. With many more
    than 2**MOST_BITS keys it lets all through, and the join gets every row: more is shuffled, in proportion to the input.
    """
    bits = min(MOST_BITS, max(20, (BITS_A_KEY * keys.count()).bit_length()))
    at = f"(({column} ^ shiftrightunsigned({column}, 23) ^ shiftrightunsigned({column}, 46)) & {(1 << bits) - 1})"
    words = (
        keys.select(F.expr(f"shiftright({at}, 6)").alias("w"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit) the bitmap lets through."""
    k = keys.view(np.uint64)
    at = ((k ^ (k >> np.uint64(23)) ^ (k >> np.uint64(46))) & np.uint64(len(words) * 64 - 1)).astype(np.int64)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), for all nodes of the edges.

    Alternates large-star and small-star steps, each staged, until the edges stay as they are. A step has one row for
    each edge at most, groups only by sums and minima that combine before the shuffle, and sends nothing to the driver
    but the count and the checksum of the edges.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    last = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen[0] == 0 or seen == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        last = seen
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stage(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(),
            name,
        )


def pair_blocks(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Concatenated ranges i..j-1."""
    n = j - i
    return np.repeat(i - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


#: Rows of an Arrow batch; Spark's own bound on its bytes (64 MiB) ends it sooner where texts are long.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, for operators that read it in Arrow batches of BATCH_ROWS rows at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
