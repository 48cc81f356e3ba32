"""Whole searches: events, observations, episodes, code and documents, composed from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import access
from tessera.functions import patterns as P
from tessera.functions import text as T
from tessera.operators import fusion, lexical, recall
from tessera.operators.index import Index


def fetched(rows: DataFrame, key: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """found(key, columns), a bounded list, with the rows that it names: their keys go to the reader of the files as a predicate."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    best = found.select(key, *columns).collect()  # as many rows as the caller's limit
    placed = spark.createDataFrame(best, found.select(key, *columns).schema)
    own = rows.where(F.col(key).isin([F.lit(r[0]).cast(kind) for r in best]) if best else F.lit(False))
    return own.join(F.broadcast(placed), key)


def _scored(rows: DataFrame, key: str, text: str, terms: list[str], allowed: Column, order: str, index: Index | None) -> DataFrame:
    """(key, order, score, matched) of the allowed rows with any of the terms; with an index no text is read."""
    if index is None:
        return lexical.bm25(rows, key, text, terms).where(allowed).select(key, order, "score", "matched")
    return index.bm25(terms).withColumnRenamed("id", key).join(rows.where(allowed).select(key, order), key)


def event_query(
    events: DataFrame, reader: access.Principal, query: str, now: int, kinds: list[str] | None = None, limit: int = 10, chars: int = 1200, index: Index | None = None
) -> DataFrame:
    """Events that a reader may see, for a query: rows with all words first, then any; intact, free of secrets and instructions, cut to an excerpt.

    events: event_id, event_type, content, content_hash, occurred_at, expires_at and the owner's columns; index: of their contents. limit is 50 at most.
    Candidates are 8 times the limit, between 40 and 400.
    """
    limit = max(1, min(limit, 50))
    terms = lexical.event_terms(query)
    most = max(40, min(8 * limit, 400))
    allowed = reader.sees() & access.unexpired(now) & access.of_kinds("event_type", kinds)
    if terms:
        seen = _scored(events, "event_id", "content", terms, allowed, "occurred_at", index)
        best = lexical.two_pass_scored(seen, "event_id", terms, most, F.desc("occurred_at"), F.col("event_id"))
        found = fetched(events, "event_id", best, ["score", "pass_no", "position"])
    else:
        own = lexical.newest(events.where(allowed), most, "occurred_at", "event_id")
        found = own.withColumns({"score": F.lit(0.0), "pass_no": F.lit(0), "position": F.row_number().over(Window.orderBy(F.desc("occurred_at"), "event_id"))})
    return _shown(found.where(access.intact()), limit, chars)


def _shown(found: DataFrame, limit: int, chars: int) -> DataFrame:
    clean = found.withColumn("content", T.redacted(F.col("content")))
    fit = clean.withColumn("content", T.sanitized(F.col("content"), 200_000)).where((F.col("content") != P.FILTERED) & (F.col("content") != ""))
    return fit.orderBy("position").limit(limit).withColumn("content", T.excerpt(F.col("content"), chars))


def observation_query(observations: DataFrame, versions: DataFrame, query: str, limit: int = 10, active_only: bool = True, index: Index | None = None) -> DataFrame:
    """Observations for a query whose stored version has the digest that they carry; ties by last_seen, then id. index: of their contents. limit is 50 at most."""
    limit = max(1, min(limit, 50))
    terms = lexical.event_terms(query)
    seen = _scored(observations, "observation_id", "content", terms, access.in_status(active_only), "last_seen", index)
    best = lexical.two_pass_scored(seen, "observation_id", terms, max(40, min(8 * limit, 400)), F.desc("last_seen"), F.col("observation_id"))
    found = fetched(observations, "observation_id", best, ["score", "matched", "pass_no", "position"])
    same = versions.select("observation_id", "version", "digest")
    return found.join(same, ["observation_id", "version", "digest"], "left_semi").orderBy("position").limit(limit)


def episode_query(
    episodes: DataFrame, query: str, semantic: DataFrame | None = None, mode: str = "auto", limit: int = 8, chars: int = 2400, index: Index | None = None
) -> DataFrame:
    """Dialogue turns for a query, with the other half of each turn, within a budget of characters.

    episodes: conv_id, turn, role, text. Each variant gives 40 rows with all its words, then 40 with any; a turn's lexical rank
    is its first place over all. semantic(id, rank) and index have ids conv-turn-role; semantic joins by reciprocal ranks of weight 1. Turns that
    don't fit the budget are skipped, and shorter ones may follow.
    """
    own = episodes.where("role in ('user', 'assistant')").withColumn("id", F.concat_ws("-", "conv_id", "turn", "role"))
    variants = [lexical.event_terms(v) for v in recall.expanded(query, mode)]
    hits = index.best(variants, 80) if index else lexical.bm25_many(own, "id", "text", variants, 80)
    full = F.coalesce(*[F.when(F.col("query") == i, F.col("matched") == len(set(v))) for i, v in enumerate(variants)])
    order = Window.orderBy("query", F.desc(full), F.desc("score"), "id")  # 80 rows a variant
    first = hits.withColumn("_p", F.row_number().over(order)).groupBy("id").agg(F.min("_p").alias("_p"))
    lists = first.select("id", F.row_number().over(Window.orderBy("_p")).alias("rank"), F.lit(1.0).alias("weight"))
    if semantic is not None:
        lists = lists.unionByName(semantic.select("id", "rank", F.lit(1.0).alias("weight")))
    fused = fusion.reciprocal_rank_fusion(lists, ["id"]).orderBy(F.desc("rrf"), F.desc("id")).limit(max(1, min(limit, 8)))
    placed = fused.select(F.substring_index("id", "-", 1).cast("long").alias("conv_id"), F.substring_index(F.substring_index("id", "-", 2), "-", -1).cast("long").alias("turn"), F.row_number().over(Window.orderBy(F.desc("rrf"), F.desc("id"))).alias("rank"))
    best = placed.collect()  # 8 rows
    ranked = episodes.sparkSession.createDataFrame(best, placed.schema)
    near = own.where(F.col("conv_id").isin(sorted({r[0] for r in best})) if best else F.lit(False))  # the conversations of the hits alone are read
    pairs = recall.turn_pairs(near.drop("id"), F.broadcast(ranked)).withColumns({"all": F.lit(1), "length": F.length("text")})
    fit = fusion.greedy_budget(pairs, "all", "length", ["rank", "conv_id", "turn", "role"], chars, 2 * limit)
    return pairs.join(fit.select("conv_id", "turn", "role"), ["conv_id", "turn", "role"]).select("conv_id", "turn", "role", "text", "rank")


#: Rows with ids and texts, or rows and the index of their texts.
Listed = DataFrame | tuple[DataFrame, Index]


def _rows(listed: Listed) -> DataFrame:
    return listed[0] if isinstance(listed, tuple) else listed


def _hybrid(lists: dict[str, Listed], weights: dict[str, float], words: list[str], semantic: DataFrame | None, candidates: int, analyzer: lexical.Analyzer) -> DataFrame:
    """id, rrf, first_rank over lists of rows(id, text), each ranked by BM25, and semantic(id, rank). Words are cut as the texts are."""
    out, terms = None, analyzer.terms(words)
    for kind, listed in lists.items():
        best = listed[1].best([terms], candidates) if isinstance(listed, tuple) else lexical.bm25_many(listed.select("id", "text"), "id", "text", [terms], candidates, analyzer)
        part = best.select("id", "rank", F.lit(weights[kind]).alias("weight"))
        out = part if out is None else out.unionByName(part)
    if semantic is not None:
        out = out.unionByName(semantic.select("id", "rank", F.lit(weights["semantic"]).alias("weight")))
    return fusion.reciprocal_rank_fusion(out, ["id"])


def _with_texts(lists: dict[str, Listed], fused: DataFrame) -> DataFrame:
    """fused(id, rrf), some hundred candidates, with their texts."""
    best = fused.select("id", "rrf").collect()  # candidates of each list
    placed = fused.sparkSession.createDataFrame(best, fused.select("id", "rrf").schema)
    wanted = F.col("id").isin([r[0] for r in best]) if best else F.lit(False)
    texts = [_rows(listed).select("id", "text").where(wanted) for listed in lists.values()]
    return reduce(DataFrame.unionByName, texts).join(F.broadcast(placed), "id")


def _matches(texts: DataFrame, terms: list[str]) -> DataFrame:
    """texts with matches: how many terms a text holds as they are."""
    n = F.lit(0)
    for t in terms:
        n = n + F.contains(F.lower("text"), F.lit(t)).cast("int")
    return texts.withColumn("matches", n)


def document_query(units: Listed, chunks: Listed, query: str, semantic: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Units and chunks (id, text) for a query: weighted reciprocal ranks, then .008 for each exact term up to .04; texts with instructions are left out.

    Words match with and without diacritics; indexes must have the analyzer FOLDED. limit is 50 at most.
    """
    limit = max(1, min(limit, 50))
    words = lexical.graph_terms(query, 20)
    lists = {"unit": units, "chunk": chunks}
    fused = _hybrid(lists, fusion.DOCUMENT_WEIGHTS, words, semantic, max(20, min(8 * limit, 500)), lexical.FOLDED)
    boosted = fusion.exact_boost(_matches(_with_texts(lists, fused), words), "matches", 0.008, 0.04)
    return boosted.withColumn("text", T.sanitized(F.col("text"), 200_000)).where(F.col("text") != P.FILTERED).orderBy(F.desc(F.round("rrf", 12)), "id").limit(limit)


def code_query(symbols: Listed, chunks: Listed, lines: Listed, edges: DataFrame, query: str, semantic: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Symbols, chunks and lines (id, text) for a query: weighted reciprocal ranks, .007 for each exact term up to .035, and a share of what neighbours in edges(a, b, confidence) have.

    Paths, numbers and names with _ . / : @ # $ - are single terms; indexes must have the analyzer CODE. limit is 50 at most.
    """
    limit = max(1, min(limit, 50))
    words = lexical.graph_terms(query, 16)
    lists = {"symbol": symbols, "chunk": chunks, "line": lines}
    fused = _hybrid(lists, fusion.CODE_WEIGHTS, words, semantic, max(20, min(8 * limit, 500)), lexical.CODE)
    boosted = fusion.exact_boost(_matches(_with_texts(lists, fused), words), "matches", 0.007, 0.035)
    return fusion.neighbour_boost(boosted, edges, "id").orderBy(F.desc(F.round("rrf", 12)), "id").limit(limit)


def common_term_window(events: DataFrame, query: str, order: str, limit: int, frequent: int = 10_000, window: int = 100_000, most: int = 4_000) -> DataFrame | None:
    """The newest rows with a single very common word, by order; None where ranking is called for instead.

    It holds for one word of three letters or more that over ``frequent`` rows contain: of the last ``window`` numbers of ``order``,
    the newest ``most`` rows are read, and those with the word as a whole word count, if there are ``limit`` of them.
    """
    terms = lexical.event_terms(query)
    if len(terms) != 1 or len(query) > 96 or len(terms[0]) < 3:
        return None
    has = F.array_contains(lexical.tokens("content"), terms[0])
    n, last = events.agg(F.count_if(has), F.max(order)).first()  # two numbers
    if n <= frequent:
        return None
    found = events.where(F.col(order) >= max(1, last - window)).orderBy(F.desc(order)).limit(most).where(has).orderBy(F.desc(order)).limit(limit)
    return found if found.count() >= limit else None


def prefetched(hits: DataFrame, heading: str, most_items: int = 6, chars: int = 8_000) -> DataFrame:
    """One row with a context block of the best hits(id, kind, text, score), or an empty text without hits: a heading, then a line and an excerpt for each."""
    best = hits.orderBy(F.desc("score"), "id").limit(most_items).withColumn("text", T.redacted(F.col("text"))).withColumn("text", T.sanitized(F.col("text"), 200_000))
    excerpt = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 900)
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "id", F.lit(" score="), F.format_number("score", 5), F.when(excerpt != "", F.concat(F.lit("\n  "), excerpt)).otherwise(""))
    rows = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("line")))).alias("all"))  # most_items rows
    whole = F.concat(F.lit(heading + "\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    return rows.select(F.when(F.size("all") > 0, F.substring(whole, 1, max(1_000, min(chars, 24_000)))).otherwise("").alias("context"))
