"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables.

A fingerprint has 128 bits, as 32 hex digits. Terms are a text's words (weight 1/2) and pairs of adjacent words (weight 1),
each times 1 + ln(occurrences); every term's hash votes with its weight for or against each bit. Likeness of two
fingerprints is the share of equal bits.

Contract. Null texts count as empty; a text without words has the fingerprint 0. Equal texts have equal fingerprints.
Rows that repeat count as documents of their own; other columns are ignored.

Search. The bits are cut into ``radius + 2`` blocks. Two fingerprints within the radius agree in two blocks at least, so
they meet in one of the tables keyed by two blocks, and are compared in the first such table only. Copies collapse
to distinct fingerprints before; a key of more than ``BLOCK`` fingerprints is dealt out in chunks, and each pair of
chunks is compared on its own, so no task holds an unbounded group and no list of pairs is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import sorted_groups
from tessera.llm.text import U64, grams, mix, slices, utf8, words
from tessera.plans.staging import partitions, release, stage

WORDS = 128
#: Bits. Of texts of 600 to 2,500 characters with a Jaccard similarity of .95, .9, .85 and .8 or more on five-word shingles (up to
#: the next step) 94, 75, 49 and 29 % lie within it; within 5 bits it was 68, 36, 16 and 6 %, within 12 it would be 100, 96, 87 and 71 %.
RADIUS = 8
BLOCK = 2048


def fingerprints(column: pa.Array) -> np.ndarray:
    """Two 64-bit words for each text."""
    out = np.zeros((len(column), 2), U64)
    for i, j in slices(column):
        buf, off = utf8(column[i:j], lower=True)
        w = words(buf, off)
        pair_row, pair = grams(w, 2)
        row = np.concatenate([w.row, pair_row]).astype(U64)
        key = (row << U64(48)) | (np.concatenate([mix(w.hash), pair]) >> U64(17)) & ~U64(1) | np.repeat(np.array([0, 1], U64), [len(w.row), len(pair_row)])
        key, times = np.unique(key, return_counts=True)
        weight = ((1 + np.log(times)) * np.where(key & U64(1), 1.0, 0.5)).astype(np.float32)
        h = key & U64((1 << 48) - 1)
        votes = np.stack([mix(h + U64(0x51_7C_C1_B7_27_22_0A_95)), mix(h ^ U64(0x9E_37_79_B9_7F_4A_7C_15))], 1)
        at = np.searchsorted((key >> U64(48)).astype(np.int64), np.arange(j - i + 1))
        for r in range(j - i):
            a, b = at[r], at[r + 1]
            if a < b:
                total = np.zeros(WORDS, np.float32)
                for c in range(a, b, 4096):
                    d = min(c + 4096, b)
                    total += weight[c:d] @ np.unpackbits(votes[c:d].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                out[i + r] = np.packbits(total > weight[a:b].sum() / 2, bitorder="little").view(U64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(-1).astype(np.float64) / WORDS


def as_hex(fp: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in fp]


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, f0 long, f1 long, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], fp: np.ndarray, fp_next: np.ndarray) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    fp_edited = fingerprints(pa.array(changed, pa.string()))
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "f0": fp[:, 0].view(np.int64), "f1": fp[:, 1].view(np.int64),
        "edited_fingerprint": as_hex(fp_edited), "near_edited": likeness(fp, fp_edited), "near_next": likeness(fp, fp_next),
    }


def _pairs_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the next of its partition. The first and last rows are sent with their texts, to be matched later."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for i, j in slices(batch.column("text")):
            ids, texts = batch.column("doc_id")[i:j].to_pylist(), [t or "" for t in batch.column("text")[i:j].to_pylist()]
            fp = fingerprints(pa.array(texts, pa.string()))
            if held is None:
                yield _edge(part, 0, ids[0], texts[0])
            else:
                ids, texts, fp = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], fp])
            if len(ids) > 1:
                got = _compared(ids[:-1], texts[:-1], texts[1:], fp[:-1], fp[1:])
                n = len(ids) - 1
                yield pa.record_batch(got | {"part": pa.nulls(n, pa.int32()), "kind": pa.nulls(n, pa.int32()), "text": pa.nulls(n, pa.string())})
            held = (ids[-1], texts[-1], fp[-1:])
    if held is not None:
        yield _edge(part, 1, held[0], held[1])


def _edge(part: int, kind: int, doc_id, text: str) -> pa.RecordBatch:
    empty = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "f0": pa.int64(), "f1": pa.int64(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return pa.record_batch(
        {"doc_id": pa.array([doc_id], pa.int64())} | {k: pa.nulls(1, t) for k, t in empty.items()}
        | {"part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "text": pa.array([text], pa.string())}
    )


def _joined_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            a, c = b.column("text").to_pylist(), b.column("following").to_pylist()
            yield pa.record_batch(_compared(b.column("doc_id").to_pylist(), a, c, fingerprints(pa.array(a, pa.string())), fingerprints(pa.array(c, pa.string()))))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and how like it are its edited text's and the next document's.

    Next is the document of the next smaller doc_id; after the smallest (null counts as smaller still) comes the largest.
    Documents are dealt out by ranges of doc_id, so only two texts of each range meet outside their task.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = 2 * partitions(spark)
    order = F.col("doc_id").desc_nulls_last()
    # The texts' beginnings part rows that share an id, in the order in which they are sorted.
    ranged = own.repartitionByRange(p, order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
    out = stage(ranged.mapInArrow(_pairs_in_order, f"{_RESULT}, part int, kind int, text string"), "simhash-ranges")
    release(spark)
    results = out.where("kind is null").drop("part", "kind", "text")
    edges = out.where("kind is not null").select("part", "kind", "doc_id", "text")
    parts = sorted(r["part"] for r in edges.where("kind = 0").select("part").collect())  # one number for each range
    if not parts:
        return results
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int")
    firsts = edges.where("kind = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    last = edges.where("kind = 1").join(after, "part").join(firsts, "after").select("doc_id", "text", "following")
    return results.unionByName(last.mapInArrow(_joined_edges, _RESULT))


def _cuts(radius: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Masks (two words each) of the radius + 2 blocks, and the tables: pairs of blocks."""
    n = radius + 2
    masks = []
    for bits in np.array_split(np.arange(WORDS), n):
        m = np.zeros(WORDS, np.uint8)
        m[bits] = 1
        masks.append(np.packbits(m, bitorder="little").view(U64))
    return masks, list(combinations(range(n), 2))


def _keys(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    masks, tables = _cuts(radius)
    for b in batches:
        fp = np.stack([b.column(c).to_numpy().view(U64) for c in ("f0", "f1")], 1)
        for t, (x, y) in enumerate(tables):
            cut = fp & (masks[x] | masks[y])
            key = mix(cut[:, 0] * U64(0x9E3779B97F4A7C15) + mix(cut[:, 1] + U64(t + 1)))
            yield pa.record_batch({"t": np.full(len(fp), t, np.int32), "key": key.view(np.int64), "f0": b.column("f0"), "f1": b.column("f1"), "cnt": b.column("cnt")})


def _near(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    masks, tables = _cuts(radius)
    for group in sorted_groups(batches, ["t", "key", "ci", "cj"]):
        if group.num_rows < 2:
            continue
        t, ci, cj = (group[c][0].as_py() for c in ("t", "ci", "cj"))
        fp = np.stack([group[c].to_numpy().view(U64) for c in ("f0", "f1")], 1)
        cnt, chunk = group["cnt"].to_numpy(), group["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == ci), np.flatnonzero(chunk == cj)
        links = np.zeros(len(fp), np.int64)
        for a in range(0, len(left), 256):
            x = left[a : a + 256]
            apart = fp[x][:, None, :] ^ fp[right][None, :, :]
            near = np.bitwise_count(apart).sum(-1) <= radius
            if ci == cj:
                near &= x[:, None] < right[None, :]
            i, j = np.nonzero(near)
            if len(i):
                clean = np.stack([((apart[i, j] & m) == 0).all(-1) for m in masks], 1)
                met = np.stack([clean[:, u] & clean[:, v] for u, v in tables[: t + 1]], 1)
                i, j = (z[met.argmax(1) == t] for z in (i, j))
                np.add.at(links, x[i], cnt[right[j]])
                np.add.at(links, right[j], cnt[x[i]])
        has = np.flatnonzero(links)
        if len(has):
            yield pa.record_batch({"f0": fp[has, 0].view(np.int64), "f1": fp[has, 1].view(np.int64), "links": links[has]})


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, n_near) for each distinct fingerprint of prints(f0, f1): how many other rows lie within the radius."""
    spark = prints.sparkSession
    p = partitions(spark)
    distinct = stage(prints.groupBy("f0", "f1").agg(F.count("*").alias("cnt")), "simhash-distinct")
    keyed = distinct.mapInArrow(lambda b: _keys(b, radius), "t int, key long, f0 long, f1 long, cnt long")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1").select("t", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks"))
    units = (
        keyed.join(shared, ["t", "key"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(f0, f1), chunks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", "f0", "f1", "cnt", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    )
    dealt = units.repartition(p, "t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj", "f0", "f1")
    links = dealt.mapInArrow(lambda b: _near(b, radius), "f0 long, f1 long, links long").groupBy("f0", "f1").agg(F.sum("links").alias("links"))
    return distinct.join(links, ["f0", "f1"], "left").select("f0", "f1", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each row of docs(doc_id, text): with_neighbours' columns, the fingerprint as text, and n_near."""
    compared = stage(with_neighbours(docs), "simhash-compared")
    near = stage(within_radius(compared.select("f0", "f1"), radius), "simhash-near")
    release(docs.sparkSession)
    as_text = F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("f0", "f1"))))
    return compared.join(near, ["f0", "f1"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_near"
    )
