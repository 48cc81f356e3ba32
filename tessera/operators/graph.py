"""Code, document and entity graphs: bounded traversal, contexts, snapshots, invalidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.patterns import CODE_PREDICATES, DOCUMENT_PREDICATES
from tessera.plans.staging import stage


def known_predicate(predicate: Column, kind: str = "code") -> Column:
    """Predicates that the graph doesn't know are references."""
    return F.when(predicate.isin(*(CODE_PREDICATES if kind == "code" else DOCUMENT_PREDICATES)), predicate).otherwise("references")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2, limit: int = 200, distinct: bool = False) -> DataFrame:
    """Edges (a, b, predicate, confidence, depth) reached from seeds(node) within ``depth`` hops (1 to 3), undirected.

    Each hop takes the most confident edges first, ties by a and b, up to what ``limit`` leaves. An edge may come again at a
    deeper hop; with ``distinct`` only its first hop counts. Nodes outside the repository (external:) aren't entered. The
    frontier has ``limit`` nodes at most and so may be broadcast.
    """
    depth = max(1, min(depth, 3))
    frontier, seen, found, left = seeds.select("node").distinct(), seeds.select("node").distinct(), None, limit
    for hop in range(1, depth + 1):
        if left <= 0:
            break
        # Both ends of an edge are looked up on their own, so no join has an OR.
        near = F.broadcast(frontier)
        touching = edges.join(near, edges["a"] == near["node"], "left_semi").union(edges.join(near, edges["b"] == near["node"], "left_semi")).distinct()
        if distinct and found is not None:
            touching = touching.join(found.select("a", "b", "predicate"), ["a", "b", "predicate"], "left_anti").select(*edges.columns)
        step = touching.orderBy(F.desc("confidence"), "a", "b", "predicate").limit(left).withColumn("depth", F.lit(hop))
        found = step if found is None else found.unionByName(step)
        left -= step.count()
        reached = step.select(F.explode(F.array("a", "b")).alias("node")).distinct().where(~F.col("node").startswith("external:"))
        frontier = reached.join(seen, "node", "left_anti")
        seen = seen.union(frontier)
    return found


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, depth): every node within ``depth`` directed hops of one node, at its least depth.

    A join for each hop, from the nodes that the last one reached first; what it finds is staged, so plans don't grow and
    a node is entered once. A recursive query would be held to ``spark.sql.cteRecursionRowLimit`` rows and carry every path.
    """
    ends = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    found = frontier = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    for hop in range(1, int(depth) + 1):
        near = ends.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        known = found.select(F.col("node").alias("_k"))
        frontier = stage(near.join(known, F.col("node").eqNullSafe(F.col("_k")), "left_anti").withColumn("depth", F.lit(hop)), "reachable")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def line_context(lines: DataFrame, wanted: DataFrame, radius: int = 20) -> DataFrame:
    """Lines within ``radius`` (100 at most) of wanted(path, line): the asked lines are spread to their neighbours and met by equality."""
    radius = max(0, min(radius, 100))
    near = wanted.select("path", F.col("line").alias("asked"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - radius), F.col("line") + radius)).alias("line"))
    return lines.join(near, ["path", "line"])


def unit_context(units: DataFrame, wanted: DataFrame, radius: int = 2) -> DataFrame:
    """Units whose ordinal is within ``radius`` of wanted(revision_id, ordinal), in the same revision."""
    near = wanted.select("revision_id", F.col("ordinal").alias("asked"), F.explode(F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius)).alias("ordinal"))
    return units.join(near, ["revision_id", "ordinal"])


def entity_query(entities: DataFrame, relations: DataFrame, word: str, limit: int = 50) -> DataFrame:
    """Relations of entities that have the word in their name or aliases as a whole token, and of those entities' neighbours.

    entities(id, name, aliases), relations(id, subject, predicate, object), both restricted to what the reader may see.
    """
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))
    aliases = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), split))
    hit = entities.where(F.array_contains(F.concat(split(F.col("name")), aliases), word.lower())).select(F.col("id").alias("node"))
    first = relations.join(hit, relations["subject"] == hit["node"], "left_semi").union(relations.join(hit, relations["object"] == hit["node"], "left_semi")).distinct()
    beyond = first.select(F.explode(F.array("subject", "object")).alias("node")).distinct().join(hit, "node", "left_anti")
    second = relations.join(beyond, relations["subject"] == beyond["node"], "left_semi").union(relations.join(beyond, relations["object"] == beyond["node"], "left_semi")).distinct()
    second = second.join(first.select("id"), "id", "left_anti").select(*relations.columns)
    return first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2))).orderBy("hop", "id").limit(limit)


def next_edges(units: DataFrame) -> DataFrame:
    """(a, b, predicate): each unit to the one that follows it in its revision."""
    w = Window.partitionBy("revision_id").orderBy("ordinal")
    return units.select(F.lag("anchor").over(w).alias("a"), F.col("anchor").alias("b"), F.lit("next").alias("predicate")).where("a is not null")


def applied_snapshot(now: DataFrame, snapshot: DataFrame, repository: str, full: bool) -> DataFrame:
    """Files (or edges) of a code graph after a snapshot: a full one replaces its repository's rows, a delta the paths that it has."""
    others = now.where(F.col("repository_id") != repository)
    own = now.where(F.col("repository_id") == repository)
    kept = own.where(F.lit(False)) if full else own.join(snapshot.select("path").distinct(), "path", "left_anti").select(*now.columns)
    return others.unionByName(kept).unionByName(snapshot.select(*now.columns))


def implicit_deletions(before: list[DataFrame], after: list[DataFrame]) -> DataFrame:
    """Paths that any table had before and none has now."""
    union = lambda frames: reduce(DataFrame.union, [f.select("path") for f in frames]).distinct()
    return union(before).join(union(after), "path", "left_anti")


def invalidated(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims without those that rest on a changed file (path, digest) at another digest."""
    stale = claims.join(changed.select("path", F.col("digest").alias("_d")), "path").where(F.col("digest") != F.col("_d")).select("id")
    return claims.join(stale, "id", "left_anti")


def totals(tables: dict[str, DataFrame], by: str = "repository_id") -> DataFrame:
    """Rows of each table for each repository."""
    frames = [t.groupBy(by).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, t in tables.items()]
    return reduce(DataFrame.unionByName, frames).groupBy(by).pivot("kind", sorted(tables)).agg(F.first("n"))


def provenance_roots(items: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """(id, root): each item's ancestors without parents within ``depth`` steps of parents(id, parent)."""
    now = items.select("id", F.col("id").alias("at"))
    done = None
    step = parents.select(F.col("id").alias("at"), F.col("parent").alias("up"))
    for _ in range(depth):
        ended = now.join(step, "at", "left_anti").select("id", F.col("at").alias("root"))
        done = ended if done is None else done.union(ended)
        now = now.join(step, "at").select("id", F.col("up").alias("at"))
    return done.union(now.join(step, "at", "left_anti").select("id", F.col("at").alias("root"))).distinct()


def added_entities(entities: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """entities(id, name, aliases, updated_at) with new(name, aliases): names that are there, case aside, gain the aliases; others are appended with an id of their own."""
    key = lambda c: F.lower(F.trim(c))
    fresh = new.groupBy(key("name").alias("_k")).agg(F.min(F.trim("name")).alias("_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("_a"))
    both = entities.withColumn("_k", key("name")).join(fresh, "_k", "full")
    ident = F.concat(F.lit("ent_"), F.substring(F.sha2("_k", 256), 1, 24))
    known = F.coalesce("aliases", F.array().cast("array<string>"))
    return both.select(
        F.coalesce("id", ident).alias("id"), F.coalesce("name", "_name").alias("name"), F.array_sort(F.array_union(known, F.coalesce("_a", F.array().cast("array<string>")))).alias("aliases"),
        F.when(F.col("_k").isNotNull() & F.col("_a").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def added_relations(relations: DataFrame, new: DataFrame, claims: DataFrame, now: int) -> DataFrame:
    """relations with new(subject, predicate, object, source_claim_id) appended, once each.

    A relation takes owner and visibility from the claim that it comes from, is valid from now on, and is left out if that claim
    isn't active. relations: subject, predicate, object, source_claim_id, owner, visibility, valid_from, valid_to.
    """
    live = claims.where("status = 'active'").select(F.col("id").alias("source_claim_id"), "owner", "visibility")
    made = new.withColumn("predicate", known_predicate(F.col("predicate"))).join(live, "source_claim_id").dropDuplicates(["subject", "predicate", "object", "source_claim_id"])
    made = made.join(relations.where("valid_to is null"), ["subject", "predicate", "object", "source_claim_id"], "left_anti")
    made = made.withColumns({"valid_from": F.lit(now).cast("long"), "valid_to": F.lit(None).cast("long")})
    return relations.unionByName(made.select(*relations.columns))
