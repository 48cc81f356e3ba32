"""Ranked lists: reciprocal-rank fusion, boosts, rerank fusion, diversity, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Weights of a unified recall's sources and of the code and document searches' lists.
RECALL_WEIGHTS = {"claim": 1.0, "observation": 0.95, "event": 0.9, "episode": 0.85, "graph": 0.65}
CODE_WEIGHTS = {"symbol": 1.15, "chunk": 1.0, "line": 0.75, "semantic": 1.25}
DOCUMENT_WEIGHTS = {"unit": 0.95, "chunk": 1.1, "semantic": 1.3}


def ranked(rows: DataFrame, by: list[Column], lists: list[str] | None = None) -> DataFrame:
    """rows with rank from 1 within each list."""
    w = Window.partitionBy(*lists) if lists else Window.partitionBy()
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*by)))


def reciprocal_rank_fusion(lists: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """keys, rrf and first_rank from rows of (keys, rank, weight): the sum of weight / (k + rank), and the best rank."""
    return lists.groupBy(*keys).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("first_rank"))


def exact_boost(fused: DataFrame, matches: str, each: float, most: float) -> DataFrame:
    """rrf raised by ``each`` for every exact term match, by ``most`` at most."""
    return fused.withColumn("rrf", F.col("rrf") + F.least(F.lit(most), each * F.col(matches)))


def neighbour_boost(fused: DataFrame, edges: DataFrame, key: str, seeds: int = 20, per_seed: int = 80) -> DataFrame:
    """Neighbours of the best ``seeds`` rows gain 0.12 of the seed's score, between 0.003 and 0.012.

    edges(a, b, confidence) are undirected. Of a seed's edges the ``per_seed`` most confident count, ties by key; of several
    seeds the largest gain counts.
    """
    best = fused.orderBy(F.desc("rrf"), key).limit(seeds).select(F.col(key).alias("a"), F.col("rrf").alias("_s"))
    both = edges.select("a", "b", "confidence").union(edges.select("b", "a", "confidence"))
    near = both.join(F.broadcast(best), "a")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "b"))).where(F.col("_n") <= per_seed)
    gain = near.groupBy(F.col("b").alias(key)).agg(F.max(F.greatest(F.lit(0.003), F.least(F.lit(0.012), 0.12 * F.col("_s")))).alias("_g"))
    return fused.join(gain, key, "left").withColumn("rrf", F.col("rrf") + F.coalesce("_g", F.lit(0.0))).drop("_g")


def rerank_fusion(rows: DataFrame, w: float, k: int = K) -> DataFrame:
    """fusion = (1 - w) / (k + local) + w / (k + model) over rows(id, local, model), best first by position.

    With w = 0 or without a model rank the local order stands. Where every row has a whole model rank and no two the same,
    the model's order decides; otherwise the model is refused and the local order stands.
    """
    n = F.count("*").over(Window.partitionBy())
    good = (F.count("model").over(Window.partitionBy()) == n) & (F.size(F.collect_set("model").over(Window.partitionBy())) == n) & (F.min("model").over(Window.partitionBy()) >= 1)
    use = F.lit(w > 0) & good
    fused = rows.withColumn("_use", use).withColumn("fusion", F.when(F.col("_use"), (1 - w) / (k + F.col("local")) + w / (k + F.col("model"))).otherwise(1 / (k + F.col("local"))))
    order = Window.orderBy(F.when(F.col("_use"), F.col("model")).otherwise(F.col("local")), "id")  # a candidate list, bounded by its search
    return fused.withColumn("position", F.row_number().over(order)).drop("_use")


def capped_per_group(rows: DataFrame, group: str, order: list[Column], most: int = 8) -> DataFrame:
    """The first ``most`` rows of each group: topics in a result, chunks of a source, edges of a node."""
    return rows.withColumn("_c", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_c") <= most).drop("_c")


def source_share_penalty(rows: DataFrame, source: str = "source", share: float = 0.65, penalty: float = 0.9) -> DataFrame:
    """Scores of a source that holds over ``share`` of the list are multiplied by ``penalty`` (a choice of this library)."""
    own = F.count("*").over(Window.partitionBy(source))
    return rows.withColumn("score", F.when(own > share * F.count("*").over(Window.partitionBy()), F.col("score") * penalty).otherwise(F.col("score")))


def keep_rerank_order(fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """Claims of fused(position, kind, id) in the order of reranked(id, rank), in the places that claims hold; other kinds stay.

    Claims that reranked lacks follow in their own order.
    """
    claims = fused.where("kind = 'claim'")
    slots = claims.withColumn("slot", F.row_number().over(Window.orderBy("position"))).select("slot", F.col("position").alias("_at"))
    order = claims.join(reranked.select("id", F.col("rank").alias("_r")), "id", "left")
    order = order.withColumn("slot", F.row_number().over(Window.orderBy(F.asc_nulls_last("_r"), "position"))).drop("position", "_r")
    placed = order.join(slots, "slot").withColumnRenamed("_at", "position").drop("slot")
    return fused.where("kind <> 'claim'").unionByName(placed)


def char_budget(rows: DataFrame, text: str, order: list[Column], budget: int, least: int = 32, groups: list[str] | None = None) -> DataFrame:
    """The longest prefix of each ordered list within ``budget`` characters; the row that crosses it is cut to what is left.

    A cut of fewer than ``least`` characters is left out.
    """
    w = Window.partitionBy(*(groups or [])).orderBy(*order)
    used = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = budget - F.col("_used")
    marked = rows.withColumn("_used", used).where((room >= F.length(text)) | (room >= least))
    return marked.where(F.col("_used") < budget).withColumn(text, F.rtrim(F.substring(F.col(text), F.lit(1), room.cast("int")))).drop("_used")


def greedy_budget(rows: DataFrame, group: str, length: str, order: list[str], budget: int, most: int) -> DataFrame:
    """Rows taken in order while they fit: one that doesn't fit is skipped and later, shorter ones may follow.

    ``order`` columns ascend. The greedy choice is a fold over each group's ordered lengths, so it stays in the JVM; a
    group is a query's candidate list and so is bounded.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    item = "struct<" + ",".join([f"{o}:{kinds[o]}" for o in order] + ["_len:int"]) + ">"
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast(f"array<{item}>").alias("rows"))

    def step(acc, x):
        fits = (acc["used"] + x["_len"] <= budget) & (acc["n"] < most)
        return F.struct(
            F.when(fits, acc["used"] + x["_len"]).otherwise(acc["used"]).alias("used"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(fits, F.array_append(acc["rows"], x)).otherwise(acc["rows"]).alias("rows"),
        )

    picked = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(length).cast("int").alias("_len")))).alias("_all"))
    kept = picked.select(group, F.aggregate("_all", start, step)["rows"].alias("_kept"))
    return kept.select(group, F.explode("_kept").alias("x")).select(group, *[F.col(f"x.{o}").alias(o) for o in order], F.col("x._len").alias(length))


def mmr(rows: DataFrame, group: str, key: str, score: str, words: str, weight: float = 0.18, most: int = 40) -> DataFrame:
    """Maximal marginal relevance in each list: the best row first, then by score - weight * the largest word overlap (Jaccard) with those picked.

    One list of at most ``most`` rows is a task's unit; longer lists are cut to their best rows first.
    """
    best = capped_per_group(rows.select(group, key, F.col(score).cast("double").alias(score), words), group, [F.desc(score), F.col(key)], most)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        items = sorted(frame[[key, score, words]].itertuples(index=False, name=None), key=lambda x: (-x[1], x[0]))
        sets = {k: set(w) for k, _, w in items}
        done: list = []
        while items:
            def worth(x):
                near = [len(sets[x[0]] & sets[k]) / max(1, len(sets[x[0]] | sets[k])) for k, _ in done]
                return x[1] - weight * max(near, default=0.0)

            chosen = max(items, key=lambda x: (worth(x), -items.index(x)))
            items.remove(chosen)
            done.append((chosen[0], chosen[1]))
        return pd.DataFrame({group: frame[group].iloc[0], key: [k for k, _ in done], score: [s for _, s in done], "position": range(1, len(done) + 1)})

    kinds = dict(rows.dtypes)
    return best.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {key} {kinds[key]}, {score} double, position long")


def event_diversity(rows: DataFrame, group: str, key: str, score: str, event: str, keep: int = 2, near: float = 0.95) -> DataFrame:
    """Each list in order, its first ``keep`` rows fixed; later a row of an event seen before gives way to the next row of an unseen event within ``near`` of its score."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        rest = sorted(frame[[key, score, event]].itertuples(index=False, name=None), key=lambda x: (-x[1], x[0]))
        done = rest[:keep]
        rest = rest[keep:]
        seen = {e for _, _, e in done}
        while rest:
            at = 0
            if rest[0][2] in seen:
                at = next((i for i, x in enumerate(rest) if x[2] not in seen and x[1] >= near * rest[0][1]), 0)
            done.append(rest.pop(at))
            seen.add(done[-1][2])
        return pd.DataFrame({group: frame[group].iloc[0], key: [x[0] for x in done], "position": range(1, len(done) + 1)})

    kinds = dict(rows.dtypes)
    return rows.select(group, key, score, event).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {key} {kinds[key]}, position long")


def compare_lists(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both ranks of every hit of two ranked lists (key, rank), and which list has it."""
    joined = left.select(key, F.col("rank").alias("left_rank")).join(right.select(key, F.col("rank").alias("right_rank")), key, "full")
    return joined.withColumn("found_by", F.when(F.col("left_rank").isNull(), "right").when(F.col("right_rank").isNull(), "left").otherwise("both"))

