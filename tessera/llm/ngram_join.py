"""Jaccard self-join of documents over word n-grams: MinHash banding, then verification on the full n-gram sets.

Contract. Words and n-grams are those of ``text.py``; a document of 1 to n - 1 words has one n-gram of all its words,
and one without words (null, empty, punctuation only) has none and links to nothing, not even to its like. Documents with
equal n-gram sets form a class and link to each other. Two classes link if the Jaccard similarity of their sets is at
least ``threshold``. Rows that repeat count as documents of their own. Other columns are ignored, whatever their names.

Plan. One pass over the texts makes the class key (64-bit hash of the set) and the band hashes. Copies collapse to classes
before anything is paired. A band bucket is a set of classes; buckets with the same members count once, so a group of
copies that agrees in all bands is verified once. The sets of classes that share a bucket come from a second pass and are
joined to their buckets. A bucket of more than ``block`` classes or 2 million n-grams is dealt out in chunks, and each
pair of chunks is a task's unit of bounded size. A pair is verified in the smallest bucket that both classes share, so
links are counted once without listing pairs: a unit returns a count and one edge for each class.

Groups alone need no such count. There each chunk of a large bucket is compared within itself and with ``PIVOTS`` classes of the
bucket, which joins a cluster of near copies; only classes outside a bucket's largest group are then compared with
all of its chunks. Two classes of the largest group are linked already, so no link that would join two groups is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bitmap, components, maybe, pair_blocks, sorted_groups
from tessera.llm.text import U64, mix, shingle_sets
from tessera.plans.staging import discard, partitions, release, stage

#: What a unit of verification may hold, in n-grams.
UNIT_GRAMS = 2_000_000
PIVOTS = 64


def choose_bands(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the largest row count, and the bands it needs, with 1 - (1 - t**r)**b >= recall in 64 hashes."""
    for r in range(most_rows, 0, -1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)) if threshold < 1 else 1
        if b * r <= 64:
            return b, r
    return 64, 1


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set that doesn't depend on order; equal sets have equal keys."""
    return np.array([int(np.bitwise_xor(mix(s).sum(dtype=U64), U64(len(s)))) if len(s) else 0 for s in sets], U64)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each set that isn't empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, bands), U64)
    out = np.empty((len(full), bands), U64)
    at = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
    flat = np.concatenate(full)
    draw = np.random.default_rng(20_230_517)
    for b in range(bands):
        h = np.full(len(full), U64(b + 1))
        for _ in range(rows):
            a, c = (U64(x) for x in draw.integers(1, 2**63, 2))
            v = flat * (a | U64(1)) + c
            v ^= v >> U64(29)
            v *= U64(0x94D049BB133111EB)
            h = mix(h * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at))
        out[:, b] = h
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sets = list(shingle_sets(part.column("text"), n))
            size = np.array([len(s) for s in sets], np.int32)
            sig = iter(signatures(sets, bands, rows).view(np.int64).tolist())
            yield pa.record_batch(
                {c: part.column(c) for c in part.schema.names if c != "text"}
                | {
                    "k": class_keys(sets).view(np.int64), "n": size,
                    "bands": pa.array([next(sig) if x else [] for x in size], pa.list_(pa.int64())),
                }
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            ids = part.column("doc_id").fill_null(0).to_numpy()
            likely = np.flatnonzero(maybe(wanted, ids))
            if len(likely):
                sets = list(shingle_sets(part.column("text").take(pa.array(likely)), n))
                keys = class_keys(sets)
                kept = [x for x, s in enumerate(sets) if len(s)]
                yield pa.record_batch({"k": keys[kept].view(np.int64), "grams": pa.array([sets[x].tobytes() for x in kept], pa.binary())})


def links_in(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of similar sets; within one chunk left equals right and i < j."""
    same = left is right
    if len(left) * len(right) <= 64:
        found = []
        for x in left:
            for y in right:
                if (not same or x < y) and min(len(sets[x]), len(sets[y])) >= threshold * max(len(sets[x]), len(sets[y])):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if common >= threshold * (len(sets[x]) + len(sets[y]) - common):
                        found.append((x, y))
        a = np.array(found, np.int64).reshape(-1, 2)
        return a[:, 0], a[:, 1]
    size = np.array([len(s) for s in sets])
    ids = np.concatenate([left, right]) if not same else left
    grams, code, seen = np.unique(np.concatenate([sets[x] for x in ids]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size[ids])
    kept = seen[code] > 1
    row, code = row[kept], code[kept]
    shared = np.flatnonzero(seen > 1)
    place = np.zeros(len(seen), np.int64)
    place[shared] = np.arange(len(shared))
    code = place[code]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(1, 4_000_000 // len(ids))
    for c in range(0, len(shared), width):
        a, b = np.searchsorted(code, [c, c + width])
        m = np.zeros((len(ids), min(width, len(shared) - c)), np.float32)
        m[row[a:b], code[a:b] - c] = 1
        common += m[: len(left)] @ (m.T if same else m[len(left) :].T)
    total = size[left][:, None] + size[right][None, :]
    alike = common >= threshold * (total - common) - 1e-6
    i, j = np.nonzero(np.triu(alike, 1) if same else alike)
    return left[i], right[j]


def _met_before(flat: np.ndarray, size: np.ndarray, bucket: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair also shares a bucket with a smaller id than this one."""
    n, width = len(size), int(size.max())
    own = np.full((n, width), bucket, np.int64)
    own[np.repeat(np.arange(n), size), pair_blocks(np.zeros(n, np.int64), size)] = flat
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 18):
        x, y = own[i[a : a + (1 << 18)]], own[j[a : a + (1 << 18)]]
        for s in range(width):
            less = x[:, s] < bucket
            if less.any():
                for t in range(width):
                    out[a : a + (1 << 18)] |= less & (x[:, s] == y[:, t])
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["bucket", "ci", "cj"]):
        k, chunk, cnt = (group[x].to_numpy() for x in ("k", "chunk", "cnt"))
        sets = [np.frombuffer(x.as_buffer(), U64) for x in group["grams"].combine_chunks()]
        bucket, ci, cj = (group[x][0].as_py() for x in ("bucket", "ci", "cj"))
        left = np.flatnonzero(chunk == ci)
        i, j = links_in(sets, left, left if ci == cj else np.flatnonzero(chunk == cj), threshold)
        if len(i):
            own = group["buckets"].combine_chunks()
            good = ~_met_before(own.flatten().to_numpy(), own.value_lengths().to_numpy(), bucket, i, j)
            i, j = i[good], j[good]
        if not len(i):
            continue
        links = np.bincount(i, cnt[j], len(k)) + np.bincount(j, cnt[i], len(k))
        root = _roots(len(k), i, j)
        has = np.flatnonzero(links)
        yield pa.record_batch({"k": k[has], "root": k[root[has]], "links": links[has].astype(np.int64)})


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that links i - j reach from each of n rows."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _joined(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(k, root): an edge for each class of a unit that similarity joins to another. Sides: 0 and 1 are compared; where inner, 0 within itself too."""
    for group in sorted_groups(batches, ["bucket", "ci", "cj"]):
        k, side = group["k"].to_numpy(), group["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in group["grams"].combine_chunks()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = links_in(sets, left, right, threshold) if len(left) and len(right) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if group["inner"][0].as_py():
            a, b = links_in(sets, left, left, threshold)
            i, j = np.concatenate([i, a]), np.concatenate([j, b])
        apart = k[i] != k[j]
        i, j = i[apart], j[apart]
        if len(i):
            root = _roots(len(k), i, j)
            has = np.unique(np.concatenate([i, j]))
            yield pa.record_batch({"k": k[has], "root": k[root[has]]})


def _groups(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, root) of the groups that similarity makes of rows(k, grams, bucket, chunks)."""
    p = partitions(rows.sparkSession)
    own = F.expr("cast(pmod(xxhash64(k, 7), chunks) as int)")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = ["bucket", "ci", "cj"]
    flags = lambda side, inner: [F.lit(side).alias("side"), F.lit(inner).alias("inner")]

    def found(units: DataFrame) -> DataFrame:
        return units.repartition(p, *unit).sortWithinPartitions(*unit, "side", "k").mapInArrow(lambda b: _joined(b, threshold), "k long, root long")

    crowded = rows.where("chunks > 1")
    first = Window.partitionBy("bucket").orderBy(F.xxhash64("k", F.lit(11)), "k")
    pivots = crowded.select("bucket", "chunks", "k").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= PIVOTS).select("bucket", "k")
    inner = rows.select("k", "grams", "bucket", own.alias("ci"), own.alias("cj"), *flags(0, True))
    asked = crowded.join(pivots, ["bucket", "k"], "left_semi").select("k", "grams", "bucket", each("chunks").alias("ci")).select("k", "grams", "bucket", "ci", F.col("ci").alias("cj"), *flags(1, True))
    edges = stage(found(inner.unionByName(asked)), "ngram-near")
    groups = components(edges.select(F.col("k").alias("a"), F.col("root").alias("b")), "ngram-groups")
    if crowded.isEmpty():
        return groups
    placed = stage(
        crowded.select("k", "bucket", "chunks").join(groups.withColumnRenamed("node", "k"), "k", "left").select("k", "bucket", "chunks", F.coalesce("root", "k").alias("root")), "ngram-crowded"
    )
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("m", "root"))["root"].alias("largest"), F.sum("m").alias("m"), F.max("m").alias("most"))
    rest_chunks = largest.where("m > most").select("bucket", "largest", F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("parts"))
    rest = placed.join(rest_chunks, "bucket").where("root <> largest").select("bucket", "k", "chunks", "parts")
    if rest.isEmpty():
        return groups
    grams = crowded.select("bucket", "k", "grams")
    part = F.expr("cast(pmod(xxhash64(k, 13), parts) as int)")
    outside = rest.join(grams, ["bucket", "k"]).select("k", "grams", "bucket", part.alias("ci"), each("chunks").alias("cj"), *flags(1, False))
    every = crowded.join(rest_chunks, "bucket").select("k", "grams", "bucket", each("parts").alias("ci"), own.alias("cj"), *flags(0, False))
    more = stage(found(outside.unionByName(every)), "ngram-rest")
    both = edges.unionByName(more)
    return components(both.select(F.col("k").alias("a"), F.col("root").alias("b")), "ngram-groups")


def _linked(texts: DataFrame, n: int, threshold: float, recall: float, block: int, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of texts(doc_id, text, other longs) with k and n in place of text, and (k, rep, cnt, links, root) of each class.

    Without ``counted`` links is 1 for classes that link at all.
    """
    spark = texts.sparkSession
    bands, rows = choose_bands(threshold, recall)
    others = "".join(f"{c} long, " for c in texts.columns if c != "text")
    sketch = stage(
        texts.mapInArrow(lambda b: _sketch(b, n, bands, rows), f"{others}k long, n int, bands array<long>"), "ngram-sketch"
    )
    classes = stage(
        sketch.where("n > 0").groupBy("k").agg(
            F.count("*").alias("cnt"), F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")
        ),
        "ngram-classes",
    )
    banded = classes.select("k", "n", F.posexplode("bands").alias("band", "h")).select("k", "n", F.xxhash64("band", "h").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("k")).alias("same"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("also")).where("m > 1")
    chosen = crowded.groupBy("same", "also", "m").agg(F.min(F.struct("bucket", "grams")).alias("x")).select("x.bucket", "m", "x.grams")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("m") / block), F.ceil(F.col("grams") / UNIT_GRAMS)).cast("int")
    joined = banded.select("k", "bucket").join(chosen.select("bucket", chunks.alias("chunks")), "bucket")
    placed = stage(joined.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("bucket", "chunks"))).alias("at")), "ngram-placed")
    release(spark)
    needed = placed.join(classes.select("k", "rep", "cnt"), "k")
    wanted = spark.sparkContext.broadcast(bitmap(needed.select(F.coalesce("rep", F.lit(0)).alias("key")), "key"))
    sets = texts.select("doc_id", "text").mapInArrow(lambda b: _sets(b, n, wanted.value), "k long, grams binary").dropDuplicates(["k"])
    if not counted:
        rows = stage(needed.join(sets, "k").select("k", "grams", F.explode("at").alias("x")).select("k", "grams", "x.bucket", "x.chunks"), "ngram-sets")
        release(spark)
        groups = _groups(rows, threshold, block)
        known = classes.select("k", "rep", "cnt").join(groups.withColumnRenamed("node", "k"), "k", "left")
        known = stage(known.select("k", "rep", "cnt", F.col("root").isNotNull().cast("long").alias("links"), F.coalesce("root", "k").alias("root")), "ngram-known")
        discard(rows, placed, classes)
        return sketch, known
    units = (
        needed.join(sets, "k")
        .select("k", "cnt", "grams", F.col("at.bucket").alias("buckets"), F.explode("at").alias("x"))
        .select("k", "cnt", "grams", "buckets", "x.bucket", "x.chunks", F.expr("cast(pmod(xxhash64(k, 7), x.chunks) as int)").alias("chunk"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("k", "cnt", "grams", "buckets", "bucket", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    )
    p = partitions(spark)
    found = stage(
        units.repartition(p, "bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj", "k")
        .mapInArrow(lambda b: _verify(b, threshold), "k long, root long, links long"),
        "ngram-found",
    )
    release(spark)
    linked = found.groupBy("k").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")), "ngram-groups")
    known = classes.select("k", "rep", "cnt").join(linked, "k", "left").join(groups.withColumnRenamed("node", "k"), "k", "left")
    return sketch, stage(known.select("k", "rep", "cnt", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "k").alias("root")), "ngram-known")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 1024) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, class_id, group_id, n_grams, n_links.

    class_id: the smallest doc_id with the same n-gram set. group_id: the smallest doc_id that links reach. n_links: how
    many other documents are at least ``threshold`` similar, copies included. Without n-grams class_id and group_id are
    the row's own doc_id and n_links is 0. A null doc_id counts as larger than others. The banding finds a pair that is
    exactly at the threshold with probability ``recall`` (0.999) and nearer ones more surely; all that it finds is
    verified, and no bucket is capped.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch, known = _linked(texts, n, threshold, recall, block)
    least = known.groupBy("root").agg(F.min("rep").alias("least"))
    known = known.join(least, "root").select("k", "rep", "cnt", "links", "least")
    return (
        sketch.select("doc_id", "k", "n").join(known, "k", "left")
        .select(
            "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("least", "doc_id").alias("group_id"),
            F.col("n").cast("long").alias("n_grams"), F.coalesce(F.col("cnt") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        )
    )


def near_duplicates_removed(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 1024) -> DataFrame:
    """docs less all but one row of each group: the one with the smallest doc_id stays, a null one only if all are null.

    Every row counts for itself, whatever doc_id it shares with others; of rows with equal doc_ids that with the smallest
    hash of id and text stays. Rows that repeat both are copies. Rows without words link to nothing and stay.
    """
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    keyed = docs.withColumn("_tessera_row", F.xxhash64(text, F.coalesce(key, F.lit(-1)), key.isNull()))
    sketch, known = _linked(keyed.select(key.alias("doc_id"), text.alias("text"), F.col("_tessera_row").alias("row")), n, threshold, recall, block, counted=False)
    own = sketch.select("doc_id", "row", "k").join(known.where("cnt + links > 1").select("k", "root"), "k")
    rows = stage(own.groupBy("row", "root").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "ngram-linked")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row")).select("row")
    gone = rows.join(first, "row", "left_anti").select(F.col("row").alias("_tessera_row"))
    again = rows.where("rows > 1").join(first, "row", "left_semi").select(F.col("row").alias("_tessera_row"))
    if again.isEmpty():
        return keyed.join(gone, "_tessera_row", "left_anti").select(*docs.columns)
    once = keyed.join(again, "_tessera_row", "left_semi").dropDuplicates(["_tessera_row"])
    return keyed.join(gone.union(again), "_tessera_row", "left_anti").unionByName(once).select(*docs.columns)
