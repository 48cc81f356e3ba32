"""Vectors and near-duplicates: exact top-k by cosine, hashed n-gram embeddings, simhash neighbours, pending rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query by cosine, ties by key; a filter on the payload comes before the limit.

    Rows of another dimension take no part. One scan, no shuffle but that of the k best of each task.
    """
    own = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return own.where(F.size(vector) == len(query)).withColumn("score", cosine(F.col(vector), q)).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def hashed_ngrams(rows: DataFrame, key: str, text: str, dims: int = 64, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(key, embedding): counts of word n-grams over the largest count, added at md5(n-gram) modulo dims, to unit length.

    dims is kept within 8 and 65,536. Texts without words give the zero vector.
    """
    import hashlib
    import re
    from collections import Counter
    from functools import lru_cache

    dims = max(8, min(dims, 65_536))

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = lru_cache(1 << 16)(lambda g: int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big") % dims)
        for frame in frames:
            out = []
            for t in frame[text]:
                words = re.findall(r"\w+", (t or "").lower())
                counts = Counter(g for w in words for n in sizes for g in ([w] if len(w) < n else [w[i : i + n] for i in range(len(w) - n + 1)]))
                v = np.zeros(dims)
                if counts:
                    np.add.at(v, [place(g) for g in counts], np.fromiter(counts.values(), float, len(counts)) / max(counts.values()))
                    v /= np.sqrt((v**2).sum()) or 1.0
                out.append(v)
            yield pd.DataFrame({key: frame[key], "embedding": out})

    return rows.select(key, text).mapInPandas(embed, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def same_manifest(vectors: DataFrame, dims: int, manifest: str) -> DataFrame:
    """Vectors that may be compared: of one dimension and one model manifest."""
    return vectors.where((F.col("dims") == dims) & (F.col("manifest_hash") == manifest) & (F.size("vec") == dims))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_classes(rows: DataFrame, key: str, simhash: str) -> DataFrame:
    """rows(key, simhash) with class_id, the smallest key of all rows with the same hash."""
    first = rows.groupBy(simhash).agg(F.min(key).alias("class_id"))
    return rows.select(key, simhash).join(first, simhash)


def _dealt_bits(rows: DataFrame, simhash: str, most: int) -> list[int]:
    """Masks of the blocks that 64 bits are dealt into, the bits that vary most first, so that each block gets its share of them.

    There are most + 2 to most + 4 blocks: as many as it takes that those that near hashes share have about a bit for each doubling of the rows.
    """
    h = F.col(simhash)
    n, *ones = rows.where(h.isNotNull()).agg(F.count("*"), *[F.sum(F.shiftrightunsigned(h, i).bitwiseAND(1)) for i in range(64)]).first()  # 65 numbers
    rarer = [min(x or 0, n - (x or 0)) for x in ones]
    varied = sum(x > 0 for x in rarer)
    blocks = next((b for b in range(most + 2, most + 4) if varied * (b - most) / b >= math.log2(max(n, 1)) - 1), most + 4)
    masks = [0] * blocks
    for place, bit in enumerate(sorted(range(64), key=lambda i: -rarer[i])):
        turn = place % (2 * blocks)  # to and fro, so that no block always picks first
        masks[min(turn, 2 * blocks - 1 - turn)] |= 1 << bit
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_neighbours(rows: DataFrame, key: str, simhash: str, most: int = 3) -> DataFrame:
    """Pairs (a, b, distance), a < b, of the class representatives (``simhash_classes``) whose 64-bit simhashes are within ``most`` bits.

    Rows of one hash are one class, so copies make no pairs. The bits are dealt into n blocks (``_dealt_bits``); hashes so near agree in
    n - most of them, meet in the tables keyed by so many blocks, and are kept in the first that they share. Bits that hardly vary are
    spread over the blocks, as a block of them alone would be one key for all rows; groups by a key so stay small as tables grow.
    """
    masks = _dealt_bits(rows, simhash, most)
    n = len(masks)
    classes = rows.groupBy(F.col(simhash).alias("h")).agg(F.min(key).alias("k"))
    tables = list(combinations(range(n), n - most))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("h").bitwiseAND(F.lit(reduce(or_, (masks[i] for i in table))).cast("long")).alias("x")) for t, table in enumerate(tables)])
    cut = classes.where("h is not null").select("k", F.col("h").cast("long").alias("h")).select("k", "h", F.explode(keys).alias("_b")).select("k", "h", "_b.*")
    # Spark's estimate leaves out that a row gives one for each table, so without the hint it would send all of them to every task through the driver.
    met = cut.toDF("a", "ha", "t", "x").join(cut.toDF("b", "hb", "t", "x").hint("merge"), ["t", "x"]).where("a < b")
    near = met.withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    same = F.filter(F.array(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)]), lambda i: i.isNotNull())
    table = F.array_position(F.array(*[F.array(*map(F.lit, t)) for t in tables]), F.slice(same, 1, n - most))
    return near.where(table == F.col("t") + 1).select("a", "b", "distance")


def word_pairs(rows: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of word sets with Jaccard similarity ``least`` or more. Rows of equal sets are paired by set.

    Sets meet under words of their prefixes: of n words, rarest first, two similar sets share one of the first n - ceil(least n) + 1.
    Only those are joined, sizes are compared before the sets, and equal sets are paired once and expanded to their rows last.
    """
    own = rows.select(key, F.array_sort(F.array_distinct(words)).alias("_w")).where(F.size("_w") > 0)
    sets = own.groupBy("_w").agg(F.min(key).alias("_s"))
    counts = sets.select(F.explode("_w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ordered = sets.select("_s", F.explode("_w").alias("w")).join(counts, "w").groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("_o"))
    prefix = F.slice(F.col("_o.w"), F.lit(1), (F.size("_o") - F.ceil(F.lit(least) * F.size("_o") - 1e-9) + 1).cast("int"))
    each = ordered.select("_s", F.size("_o").alias("_n"), F.explode(prefix).alias("w"))
    met = each.alias("a").join(each.alias("b"), F.expr(f"a.w = b.w and a._s < b._s and a._n >= {least} * b._n - 1e-9 and b._n >= {least} * a._n - 1e-9"))
    pairs = met.select(F.col("a._s").alias("x"), F.col("b._s").alias("y")).distinct()
    whole = sets.select("_s", "_w")
    full = pairs.join(whole.select(F.col("_s").alias("x"), F.col("_w").alias("p")), "x").join(whole.select(F.col("_s").alias("y"), F.col("_w").alias("q")), "y")
    common = F.size(F.array_intersect("p", "q"))
    near = full.withColumn("similarity", common / (F.size("p") + F.size("q") - common)).where(F.col("similarity") >= least).select("x", "y", "similarity")
    near = near.unionByName(sets.select(F.col("_s").alias("x"), F.col("_s").alias("y"), F.lit(1.0).alias("similarity")))
    member = own.join(sets, "_w").select("_s", key)
    both = near.join(member.select(F.col("_s").alias("x"), F.col(key).alias("a")), "x").join(member.select(F.col("_s").alias("y"), F.col(key).alias("b")), "y")
    both = both.where("x <> y or a < b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def pending(chunks: DataFrame, embedded: DataFrame, key: str, digest: str) -> DataFrame:
    """Chunks without a vector of their present text."""
    return chunks.join(embedded.select(key, digest), [key, digest], "left_anti")


#: Rows of a block of queries, and of a chunk of vectors.
ASKED, CHUNK = 2_048, 16_384


def nearest_by_cosine(vectors: DataFrame, key: str, vector: str, every: int, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest by cosine to each row whose key is divisible by ``every``, ties by id, itself aside.

    The stated query set is dealt into blocks and all rows into chunks by hash; a block and a chunk are a task's unit of
    fixed size, and each unit returns k rows a query. Zero vectors and those of other lengths than the query's take no part.
    """
    own = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null")
    n, asked_n = own.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()  # two numbers
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-asked_n // ASKED))
    dealt = lambda m: F.pmod(F.xxhash64("id", F.lit(m)), F.lit(m)).cast("int")
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = own.select(dealt(chunks).alias("chunk"), every_one(blocks).alias("block"), F.lit(False).alias("asks"), "id", "v")
    right = own.where(F.col("id") % every == 0).select(every_one(chunks).alias("chunk"), dealt(blocks).alias("block"), F.lit(True).alias("asks"), "id", "v")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in frame.groupby(frame["v"].map(len)):
            x, ids, asks = np.stack(part["v"].to_numpy()), part["id"].to_numpy(), part["asks"].to_numpy()
            norm = np.sqrt((x * x).sum(1))
            kept = (norm > 0) & ~asks
            y, known, length = x[kept], ids[kept], norm[kept]
            for q, query, z in zip(x[asks], ids[asks].tolist(), norm[asks], strict=True):
                if z > 0 and len(y):
                    score = (y * q).sum(1) / (length * z)
                    score[known == query] = -np.inf
                    near = np.flatnonzero(score >= np.partition(score, -min(k, len(score)))[-min(k, len(score))])
                    near = near[np.isfinite(score[near])]
                    near = near[np.lexsort((known[near], -score[near]))][:k]
                    out.append(pd.DataFrame({"query_id": query, "id": known[near], "score": score[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    near = left.unionByName(right).groupBy("chunk", "block").applyInPandas(compare, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_agreement(vectors: DataFrame, key: str, vector: str, label: str, every: int, k: int = 10) -> DataFrame:
    """For each row whose key is divisible by ``every``, the share of its k nearest that have its label: how well vectors keep classes apart."""
    near = nearest_by_cosine(vectors, key, vector, every, k)
    labels = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("_l"))
    both = near.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("_l").alias("_q")), "query_id")
    return both.groupBy("query_id").agg(F.avg((F.col("_l") == F.col("_q")).cast("double")).alias("agreement"))
