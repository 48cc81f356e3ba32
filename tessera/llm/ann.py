"""Approximate nearest neighbours with balanced posting lists.

A bounded sample of the vectors (``sample_size``) is clustered by k-means with a penalty on large clusters, so that posting
lists come out balanced: first into about as many cells as each cell then has clusters. The number of lists grows with the
vectors, one for ``LIST_SIZE`` of them up to ``LISTS``. Every vector goes to the list of its nearest centroid, looked for in the
``PROBED`` nearest cells, and a boundary vector to further lists too: up to ``REPLICAS``, while the next centroid is within
``SPREAD`` of the nearest one's distance. A query searches the centroids by best-first search in a graph held in memory
(each centroid's nearest neighbours, and a chain that keeps the graph connected) and reads the lists whose centroids' distance is within ``REACH`` of the nearest one's, and further ones
while those hold too few vectors. Distances to the vectors of the lists read are exact.

Contract. Vectors that are null, zero or hold null, NaN or infinite components take no part, nor do vectors of another
length than the commonest (of equally common lengths the largest). Components are compared as given, in single or double
precision. A query is a vec_id divisible by ``every``; if rows repeat
its vec_id, its smallest vector asks. Its own vec_id is never an answer; a vec_id that repeats counts by its nearest row.
Up to ``k`` answers for each query, nearest first, ties to the smaller vec_id; score is the Euclidean distance in double
precision. A null vec_id neither asks nor answers. Other columns are ignored.

Of equal vectors only the k + 1 smallest vec_ids can be answers, and only those are indexed: the limit is applied before the
shuffle, so a vector that a third of all rows share costs nothing. A list and the queries that read it meet in units of
at most ``UNIT`` vectors and ``ASKED`` queries, whatever their sizes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import drawn, sorted_groups
from tessera.plans.staging import partitions, stage

#: The sample: so many vectors, or so many a list if that is more, but no more bytes than the last figure.
SAMPLE, SAMPLE_A_LIST, SAMPLE_BYTES = 20_000, 4, 64e6
LISTS = 32_768
LIST_SIZE = 96
PROBED = 8
REPLICAS, SPREAD = 3, 1.12
REACH = 1.35
LINKS = 12
UNIT, ASKED = 4_096, 1_024


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((centre**2).sum(1)[None, :] - 2 * x @ centre.T + (x**2).sum(1)[:, None], 0))


class Centroids:
    """Centroids in cells, with their search graph."""

    def __init__(self, cells: np.ndarray, centre: np.ndarray, cell: np.ndarray):
        """cells: a centre for each cell; cell: of each centroid its cell."""
        self.cells, self.centre = cells, centre
        self.members = [np.flatnonzero(cell == c) for c in range(len(cells))]
        n = len(centre)
        self.links: list = [set() for _ in range(n)]
        if n > 1:
            near = self.nearest(centre, LINKS + 1)[0]
            for a, x in enumerate(near.tolist()):
                for b in x:
                    if a != b >= 0:
                        self.links[a].add(b)
                        self.links[b].add(a)
        chain = np.argsort((centre**2).sum(1), kind="stable")
        for a, b in zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True):
            self.links[a].add(b)
            self.links[b].add(a)
        self.links = [np.array(sorted(x), np.int64) for x in self.links]

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest centroids of the nearest cells, nearest first (-1 if there are fewer), and their distances."""
        ids, far = np.full((len(x), most), -1, np.int64), np.full((len(x), most), np.inf)
        probed = np.argsort(distances(x, self.cells), 1, kind="stable")[:, :PROBED]
        for c, members in enumerate(self.members):
            row = np.flatnonzero((probed == c).any(1))
            if len(row) and len(members):
                d = np.concatenate([far[row], distances(x[row], self.centre[members])], 1)
                all_ids = np.concatenate([ids[row], np.broadcast_to(members, (len(row), len(members)))], 1)
                order = np.argsort(d, 1, kind="stable")[:, :most]
                far[row], ids[row] = np.take_along_axis(d, order, 1), np.take_along_axis(all_ids, order, 1)
        return ids, far

    def search(self, q: np.ndarray, reach: float, enough: int, sizes: np.ndarray) -> list[int]:
        """Lists near q, nearest first: best-first through the graph until all that is left lies beyond reach."""
        start = [0, len(self.centre) // 2]
        seen = np.zeros(len(self.centre), bool)
        seen[start] = True
        d = np.sqrt(((self.centre[start] - q) ** 2).sum(1))
        heap = [(x, c) for x, c in zip(d.tolist(), start, strict=True)]
        heapq.heapify(heap)
        best, found, held, beyond = float(min(d)), [], 0, 0
        while heap:
            x, c = heapq.heappop(heap)
            if x > reach * best and held >= enough:
                beyond += 1
                if beyond > LINKS:
                    break
            found.append((x, c))
            best = min(best, x)
            held += int(sizes[c])
            new = self.links[c][~seen[self.links[c]]]
            if len(new):
                seen[new] = True
                for y, b in zip(np.sqrt(((self.centre[new] - q) ** 2).sum(1)).tolist(), new.tolist(), strict=True):
                    heapq.heappush(heap, (y, b))
        out, held = [], 0
        for x, c in sorted(found):
            if x > reach * best and held >= enough:
                break
            out.append(c)
            held += int(sizes[c])
        return out


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids; a cluster's distance is raised in proportion to its size in the round before."""
    draw = np.random.default_rng(11)
    centre = x[draw.choice(len(x), k, replace=False)].astype(np.float64)
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        total, which = np.zeros((k, x.shape[1])), np.zeros(len(x), np.int64)
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048].astype(np.float64)
            d = (centre**2).sum(1)[None, :] - 2 * part @ centre.T + (part**2).sum(1)[:, None]
            which[a : a + 2048] = (d * (0.9 + 0.1 * size / (len(x) / k))[None, :]).argmin(1)
        np.add.at(total, which, x)
        size = np.bincount(which, minlength=k)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[draw.integers(0, len(x), k)])
    return centre


def clustered(x: np.ndarray, k: int) -> Centroids:
    """About k centroids in about sqrt(k) cells, each cell with a share of them that follows its vectors."""
    if not len(x):
        return Centroids(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64))
    cells = balanced_kmeans(x, int(np.ceil(np.sqrt(k))))
    which = np.concatenate([distances(x[a : a + 2048].astype(np.float64), cells).argmin(1) for a in range(0, len(x), 2048)])
    centre, cell = [], []
    for c in range(len(cells)):
        own = x[which == c]
        if len(own):
            centre.append(balanced_kmeans(own, int(np.clip(round(k * len(own) / len(x)), 1, len(own)))))
            cell.append(np.full(len(centre[-1]), c))
    return Centroids(cells, np.concatenate(centre), np.concatenate(cell))


def sample_size(lists: int, width: int) -> int:
    """Vectors of the sample: a bound whatever the number of vectors."""
    return int(max(1, min(max(SAMPLE, SAMPLE_A_LIST * lists), SAMPLE_BYTES // (8 * max(width, 1)))))


def _vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.float32)


def _assigned(batches: Iterator[pa.RecordBatch], index: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            x = _vectors(part, "v").astype(np.float64)
            near, far = index.nearest(x, REPLICAS)
            kept = (far <= SPREAD * far[:, :1] + 1e-12) & (near >= 0)
            row, place = np.nonzero(kept)
            yield pa.record_batch({"list": near[row, place].astype(np.int32), "first": place == 0, "vec_id": part.column("vec_id").take(pa.array(row)), "v": part.column("v").take(pa.array(row))})


def _asked(batches: Iterator[pa.RecordBatch], index: Centroids, reach: float, enough: int, sizes: np.ndarray, chunks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            row, lists, chunk = [], [], []
            for r, q in enumerate(_vectors(part, "v").astype(np.float64)):
                for c in index.search(q, reach, enough, sizes):
                    row += [r] * int(chunks[c])
                    lists += [c] * int(chunks[c])
                    chunk += range(int(chunks[c]))
            at = pa.array(row, pa.int64())
            yield pa.record_batch({"list": np.array(lists, np.int32), "chunk": np.array(chunk, np.int32), "vec_id": part.column("vec_id").take(at), "v": part.column("v").take(at)})


class Best:
    """The k nearest candidates seen so far of each query."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, query: int, ids: np.ndarray, d: np.ndarray) -> None:
        if query in self.held:
            ids, d = np.concatenate([self.held[query][0], ids]), np.concatenate([self.held[query][1], d])
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        _, first = np.unique(ids, return_index=True)
        first.sort()
        self.held[query] = (ids[first[: self.k]], d[first[: self.k]])

    def rows(self) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.held.values()]
        query = np.repeat(np.fromiter(self.held, np.int64, len(self.held)), n)
        ids, d = (np.concatenate([x[i] for x in self.held.values()]) if self.held else np.zeros(0) for i in (0, 1))
        self.held = {}
        return pa.record_batch({"query_id": query, "vec_id": ids.astype(np.int64), "score": d.astype(np.float64)})


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best = Best(k)
    for group in sorted_groups(batches, ["list", "chunk", "block"]):
        group = group.combine_chunks().to_batches()[0]
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids, x = group.column("vec_id").to_numpy(), _vectors(group, "v").astype(np.float64)
        v, vid = x[~asks], ids[~asks]
        order = np.argsort(vid, kind="stable")
        v, vid = v[order], vid[order]
        own = np.flatnonzero(np.append(True, vid[1:] != vid[:-1])) if len(vid) else np.zeros(0, np.int64)
        vid = vid[own]
        for q, query in zip(x[asks], ids[asks].tolist(), strict=True):
            d = np.sqrt(((v - q) ** 2).sum(1))
            d = np.minimum.reduceat(d, own) if len(own) else d  # the nearest row of each vec_id
            d[vid == query] = np.inf
            near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]) if len(d) else np.zeros(0, np.int64)
            near = near[np.isfinite(d[near])]
            if len(near):
                best.add(query, vid[near], d[near])
        if len(best.held) > 100_000:
            yield best.rows()
    if best.held:
        yield best.rows()


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in the precision that they have."""
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))
    common = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("v") == (common["n"] if common else 0))


def nearest_neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, reach: float = REACH) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    spark = embeddings.sparkSession
    p = partitions(spark)
    valid = valid_vectors(embeddings)
    copies = Window.partitionBy("v").orderBy("vec_id")
    indexed = stage(valid.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "ann-vectors")
    total = indexed.count()
    t = indexed.schema["v"].dataType.simpleString()
    lists = int(np.clip(total // LIST_SIZE, 1, LISTS))
    width = (indexed.select(F.size("v").alias("n")).first() or {"n": 1})["n"]
    got = drawn(indexed, total, sample_size(lists, width), "vec_id", "v").toArrow().sort_by([("vec_id", "ascending")]).combine_chunks()
    x = got["v"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1), np.float32)
    index = clustered(x, min(lists, len(x)))
    sent = spark.sparkContext.broadcast(index)
    posted = stage(indexed.mapInArrow(lambda b: _assigned(b, sent.value), f"list int, first boolean, vec_id long, v {t}"), "ann-lists")
    sizes, rows = np.zeros(len(index.centre), np.int64), np.zeros(len(index.centre), np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most LISTS rows
        rows[r["list"]] = r["n"]
    once = posted.where("first").groupBy("vec_id").agg(F.min("list").alias("list"))  # a vec_id with many vectors counts in one list
    for r in once.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most LISTS rows
        sizes[r["list"]] = r["n"]
    chunks = np.maximum(1, -(-rows // UNIT))
    queries = valid.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(
        queries.mapInArrow(lambda b: _asked(b, sent.value, reach, 12 * k, sizes, chunks), f"list int, chunk int, vec_id long, v {t}"), "ann-asked"
    )
    numbers = {r["list"]: -(-r["n"] // ASKED) for r in asked.where("chunk = 0").groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    blocks = F.from_json(F.lit("[" + ",".join(str(numbers.get(i, 0)) for i in range(len(rows))) + "]"), "array<int>")
    parts = F.from_json(F.lit("[" + ",".join(map(str, chunks)) + "]"), "array<int>")
    block = F.get(blocks, F.col("list"))
    left = posted.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), F.get(parts, F.col("list"))).cast("int")).withColumn("blocks", block).where("blocks > 0")
    left = left.select("list", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    right = asked.select("list", "chunk", F.pmod(F.xxhash64("vec_id"), block).cast("int").alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    met = left.unionByName(right).repartition(p, "list", "chunk", "block").sortWithinPartitions("list", "chunk", "block")
    found = met.mapInArrow(lambda b: _compared(b, k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
