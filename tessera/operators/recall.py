"""Recall: intent, query variants, unified search over sources, dialogue pairs, context collapse, coverage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.operators import fusion, lexical
from tessera.operators.index import Index

PRIORITY = {"claim": 0, "observation": 1, "event": 2, "episode": 3, "graph": 4}


def cleaned(query: str, most: int = 500) -> str:
    """One line without outer punctuation."""
    return re.sub(r"\s+", " ", query or "").strip(" \t\r\n,.;:!?-")[:most]


def intent(query: str) -> dict[str, object]:
    """Primary intent and flags of a query."""
    text = cleaned(query)
    has = lambda pattern: bool(re.search(pattern, text, re.I))
    clauses = [c for c in map(cleaned, re.split(P.CLAUSE, text, flags=re.I)) if len(c) >= 3]
    flags = {
        "preference": has(P.PREFERENCE), "procedural": has(P.PROCEDURE), "current_state": has(P.CURRENT), "temporal": has(P.TEMPORAL) or _russian_endpoint(text),
        "multi_hop": len(clauses) > 1 or len(re.findall(P.QUOTED, text)) > 1, "negative_premise": has(P.NEGATIVE),
    }
    primary = next((k for k in ("preference", "procedural", "current_state", "temporal", "multi_hop") if flags[k]), "factual")
    return {"primary": primary, **flags, "deep_recommended": flags["multi_hop"] or flags["temporal"] or flags["negative_premise"]}


def _russian_endpoint(text: str) -> bool:
    """Whether с, до or после is followed by a date that the calendar has, a month, or a plain year."""
    import calendar

    for m in re.finditer(r"\b(?:с|со|до|после)\s+", text, re.I):
        rest = text[m.end() :].lower()
        if d := re.match(r"(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[./-](\d{1,2})(?:[./-](\d{4}|\d{2}))?)(?![\w./-])", rest):
            year, month, day = (int(d[1]), int(d[2]), int(d[3])) if d[1] else (int(d[6] or 2000), int(d[5]), int(d[4]))
            year += 2000 if year < 100 else 0
            if 1 <= month <= 12 and 1 <= day <= calendar.monthrange(max(1, year), month)[1]:
                return True
        if d := re.match(r"(?:(\d{1,2})\s+)?(" + "|".join(P.MONTHS_RU) + r")\b", rest):
            if not d[1] or 1 <= int(d[1]) <= calendar.monthrange(2000, P.MONTHS_RU.index(d[2]) + 1)[1]:
                return True
        if (d := re.match(r"(\d{4})(?![\w./-])\s*(\w*)", rest)) and 1000 <= int(d[1]) <= 2999 and d[2] in ("", "года", "год", "г", "по", "до", "и"):
            return True
    return False


def expanded(query: str, mode: str = "auto", most: int | None = None) -> list[str]:
    """Variants of a query, the cleaned original first: fast 1, auto up to 3, deep up to 5, never over 8.

    A query with a negation keeps its original only, since parts of it may lose the negation.
    """
    limits = {"fast": 1, "auto": 3, "deep": 5}
    if mode not in limits:
        raise ValueError(f"mode must be one of {sorted(limits)}")
    first = cleaned(query)
    if not first:
        return []
    limit = max(1, min(most if most is not None else limits[mode], 8))
    parts = [first]
    if mode != "fast" and not re.search(P.NEGATIVE, first, re.I):
        content = cleaned(re.sub(P.QUESTION_PREFIX, "", first, flags=re.I)) or first
        parts.append(content)
        if mode == "deep" or intent(first)["multi_hop"]:
            parts += [c for c in map(cleaned, re.split(P.CLAUSE, content, flags=re.I)) if len(c) >= 5]
        if mode == "deep":
            parts += map(cleaned, re.findall(P.QUOTED, first))
    unique = {p.casefold(): p for p in reversed([p for p in parts if len(p) >= 3])}
    return sorted(unique.values(), key=parts.index)[:limit]


#: What \b, \w and \s are where a pattern only knows ASCII, as in SQL engines; Java's own \b and \s are neither this nor Unicode's.
_ASCII = {r"\b": r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"\w": "[A-Za-z0-9_]", r"\s": r"[\t\n\f\r ]"}


def classified(queries: DataFrame, text: str = "query", ascii_words: bool = False) -> DataFrame:
    """queries with their intent and flags, as columns, by the same rules as ``intent``: for tables of queries.

    ascii_words: words end at any character but ASCII letters, digits and _, and only ASCII's white space counts, as in SQL engines;
    Cyrillic words, and the dates after them, are then never whole words.
    """
    edge = " \t\r\n,.;:!?-"

    def rule(pattern: str) -> str:
        return "(?iu)" + re.sub(r"\\[bws]", lambda m: _ASCII[m[0]], pattern) if ascii_words else "(?iU)" + pattern

    q = F.substring(F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rule(r"\s+"), " "), F.lit(edge)), 1, 500)
    flag = lambda pattern: F.coalesce(q.rlike(rule(pattern)), F.lit(False))
    clauses = F.size(F.filter(F.split(q, rule(P.CLAUSE)), lambda c: F.length(F.btrim(c, F.lit(edge))) >= 3))
    russian = F.lit(False)
    if not ascii_words:
        russian = F.pandas_udf(lambda column: column.map(lambda t: t is not None and _russian_endpoint(t)), "boolean")(F.when(q.rlike("[а-яА-ЯёЁ]"), q))
    out = queries.withColumns({
        "preference": flag(P.PREFERENCE), "procedural": flag(P.PROCEDURE), "current_state": flag(P.CURRENT), "temporal": flag(P.TEMPORAL) | russian,
        "multi_hop": (clauses > 1) | (F.regexp_count(q, F.lit(rule(P.QUOTED))) > 1), "negative_premise": flag(P.NEGATIVE),
    })
    primary = F.lit("factual")
    for name in ("multi_hop", "temporal", "current_state", "procedural", "preference"):
        primary = F.when(F.col(name), name).otherwise(primary)
    return out.withColumn("primary", primary)


def query_mode(text: Column) -> Column:
    """technical if a query spells code or paths, semantic if it is a sentence of five words or more, else mixed (a choice of this library)."""
    code = text.rlike(r"[A-Za-z0-9_]+[./\\:]{1,2}[A-Za-z0-9_]+|[a-z]+_[a-z]+|[a-z][A-Z]|\(\)|`")
    return F.when(code, "technical").when(F.size(F.split(F.trim(text), r"[\t\n\f\r ]+")) >= 5, "semantic").otherwise("mixed")


def unified(
    sources: dict[str, tuple[DataFrame, str, str]], query: str, mode: str = "auto", limit: int = 8, chars: int = 2400, per_list: int = 40, indexes: dict[str, Index] | None = None
) -> DataFrame:
    """Ranked evidence of several kinds for one query: kind, id, rrf, first_rank, position, text.

    sources: kind to (rows, id column, text column), each already restricted to what the reader may see; indexes: kind to the
    index of those rows, which spares the scan of their texts. Every variant of the query ranks every source by BM25; weights over 60 + rank add up across variants and sources. Order: rrf, the kind's
    priority, best rank, id. The texts share ``chars`` characters (128 to 24,000); ``limit`` is 20 at most.
    """
    limit, chars = max(1, min(limit, 20)), max(128, min(chars, 24_000))
    variants = [lexical.event_terms(v) for v in expanded(query, mode)]
    lists = None
    for kind, (rows, key, text) in sources.items():
        if index := (indexes or {}).get(kind):
            best = index.best(variants, per_list, F.col("id").cast("string"))  # as without an index: ids of all kinds are strings
        else:
            best = lexical.bm25_many(rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")), "id", "text", variants, per_list)
        best = best.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "rank", F.lit(fusion.RECALL_WEIGHTS[kind]).alias("weight"))
        lists = best if lists is None else lists.unionByName(best)
    fused = lists.groupBy("kind", "id").agg(F.sum(F.col("weight") / (fusion.K + F.col("rank"))).alias("rrf"), F.min("rank").alias("first_rank"))
    priority = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in PRIORITY.items()])
    order = [F.desc(F.round("rrf", 12)), priority, F.col("first_rank"), F.col("id")]
    best = fused.orderBy(*order).limit(limit)
    rows = best.withColumn("position", F.row_number().over(Window.orderBy(*order))).collect()  # limit rows
    spark = fused.sparkSession
    placed = spark.createDataFrame(rows, "kind string, id string, rrf double, first_rank int, position int")
    texts = spark.createDataFrame([], "kind string, id string, text string")
    for kind, (own, key, text) in sources.items():
        if ids := [r["id"] for r in rows if r["kind"] == kind]:
            typed = F.col(key).isin([F.lit(i).cast(own.schema[key].dataType) for i in ids])
            texts = texts.unionByName(own.where(typed).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(text).alias("text")))
    return fusion.char_budget(placed.join(texts, ["kind", "id"]), "text", [F.col("position")], chars)


def citations(items: DataFrame) -> DataFrame:
    """items with a citation such as [M:C:id]: C claim, O observation, V event, E episode, G graph."""
    letter = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in {"claim": "C", "observation": "O", "event": "V", "episode": "E", "graph": "G"}.items()])
    return items.withColumn("citation", F.concat(F.lit("[M:"), letter, F.lit(":"), F.col("id"), F.lit("]")))


def answer_policy(items: DataFrame, questions: DataFrame | None = None, by: str = "query_id") -> DataFrame:
    """Whether to answer from the items or to abstain: one row, or with questions(by) one for each, those without items too."""
    policy = F.when(F.col("items") > 0, "answer_with_citations").otherwise("abstain")
    if questions is None:
        return items.agg(F.count("*").alias("items")).withColumn("policy", policy)
    found = items.groupBy(by).agg(F.count("*").alias("items"))
    return questions.select(by).join(found, by, "left").withColumn("items", F.coalesce("items", F.lit(0))).withColumn("policy", policy)


def conflict_status(selected: DataFrame, contradictions: DataFrame) -> DataFrame:
    """present for selected claims (id) in an open contradiction (claim_a, claim_b, status), else absent."""
    sides = contradictions.where("status = 'open'").select(F.explode(F.array("claim_a", "claim_b")).alias("id")).distinct()
    return selected.select("id").join(sides.withColumn("hit", F.lit(1)), "id", "left").select("id", F.when(F.col("hit") == 1, "present").otherwise("absent").alias("conflict"))


def turn_pairs(episodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Both sides of each turn that hits(conv_id, turn, rank) name: a user's turn with the assistant's that follows, or the reverse."""
    mate = F.when(F.col("role") == "user", F.col("turn") + 1).when(F.col("role") == "assistant", F.col("turn") - 1)
    found = episodes.join(hits, ["conv_id", "turn"]).select("conv_id", "turn", "rank", mate.alias("mate"), F.col("role").alias("_role"))
    partner = found.select("conv_id", F.col("mate").alias("turn"), "rank", F.when(F.col("_role") == "user", "assistant").otherwise("user").alias("role"))
    both = found.select("conv_id", "turn", "rank", F.col("_role").alias("role")).unionByName(partner.where("turn is not null"))
    best = both.groupBy("conv_id", "turn", "role").agg(F.min("rank").alias("rank"))
    return episodes.join(best, ["conv_id", "turn", "role"])


def collapse_tokens(text: Column) -> Column:
    """Distinct lower-case words of four characters or more, hyphens within."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{Nd}_-]+"), F.lit(0)), lambda w: F.length(w) >= 4))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def collapse(hits: DataFrame, query: str, budget: int = 6, alike: float = 0.45, group: str | None = None) -> DataFrame:
    """Deduplicated context of several sources, best first: group, id, source, corroborating, overlap, score, place.

    hits: source, id, root, text, salience, confidence, position. Rows of equal text and id count once, the first. The score
    is .50 salience + .25 confidence + .20 overlap with the query + .05 for each other source (two at most) that says much the
    same (Jaccard ``alike`` or more) with a root not yet counted, in the order of position. That order matters, so a query's
    hits, a bounded candidate list, are folded together; ``group`` names the column that tells queries apart.
    """
    asked = set(w for w in re.findall(r"[\w-]+", query.casefold()) if len(w) >= 4)

    def near(x: set, y: set) -> float:
        common = len(x & y)
        return common / (len(x) + len(y) - common) if common else 0.0

    def unit(x) -> float:
        return 0.5 if x is None or x != x else max(0.0, min(1.0, float(x)))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen, items = set(), []
        for r in frame.sort_values("position").itertuples(index=False):
            key = (r.id, " ".join((r.text or "").casefold().split()))
            if key not in seen:
                seen.add(key)
                items.append((r, {w for w in re.findall(r"[\w-]+", (r.text or "").casefold()) if len(w) >= 4}))
        out = []
        for r, words in items:
            roots, votes = {r.root}, set()
            for o, theirs in items:
                if len(votes) < 2 and r.root and o.root and o.source != r.source and o.root not in roots and o.source not in votes and near(words, theirs) >= alike:
                    votes.add(o.source)
                    roots.add(o.root)
            overlap = near(asked, words)
            out.append((r.id, r.source, len(votes), overlap, 0.50 * unit(r.salience) + 0.25 * unit(r.confidence) + 0.20 * overlap + 0.05 * len(votes)))
        out.sort(key=lambda x: -round(x[4], 9))
        best = [(frame[name].iloc[0], *x, i) for i, x in enumerate(out[:budget], 1)]
        return pd.DataFrame(best, columns=[name, "id", "source", "corroborating", "overlap", "score", "place"])

    name = group or "_query"
    own = hits if group else hits.withColumn(name, F.lit(1))
    kinds = dict(own.dtypes)
    own = own.select(name, "source", "id", "root", "text", "salience", "confidence", "position")
    found = own.groupBy(name).applyInPandas(fold, f"{name} {kinds[name]}, id {kinds['id']}, source string, corroborating int, overlap double, score double, place int")
    return found if group else found.drop(name)


def coverage(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """NOVEL, STALE, DUPLICATE or CONFLICTING for wanted(path, digest, revision) against manifest(path, digest, revision), and a token estimate.

    The newest manifest row of a path counts. Equal digest: DUPLICATE; an older revision: STALE; else CONFLICTING.
    """
    newest = manifest.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("revision"), "digest"))).where("_r = 1").select("path", F.col("digest").alias("_d"), F.col("revision").alias("_v"))
    state = F.when(F.col("_d").isNull(), "NOVEL").when(F.col("_d") == F.col("digest"), "DUPLICATE").when(F.col("_v") < F.col("revision"), "STALE").otherwise("CONFLICTING")
    return wanted.join(newest, "path", "left").withColumn("coverage", state).drop("_d", "_v")
