"""Life of claims: decay, supersession, contradictions, feedback, history, health, evaluation, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


def decay_factor(now: int, moment: Column, confidence: Column, salience: Column, accesses: Column) -> Column:
    """max(0, 1 - .015 / max(.3, confidence * salience) * days + .05 ln(1 + accesses)); confidence and salience default to .7."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(moment, F.lit(0))) / DAY)
    quality = F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.7))) * F.greatest(F.lit(0.0), F.coalesce(salience, F.lit(0.7)))
    return F.greatest(F.lit(0.0), 1.0 - 0.015 / F.greatest(F.lit(0.3), quality) * days + 0.05 * F.log1p(F.greatest(F.coalesce(accesses, F.lit(0)), F.lit(0))))


def with_decay(claims: DataFrame, now: int) -> DataFrame:
    """Active claims with decay. Days count from freshness_at, or updated_at where that is unset."""
    moment = F.when(F.coalesce("freshness_at", F.lit(0)) > 0, F.col("freshness_at")).otherwise(F.col("updated_at"))
    return claims.where("status = 'active'").withColumn("decay", decay_factor(now, moment, F.col("confidence"), F.col("salience"), F.col("access_count")))


def decay_scan(claims: DataFrame, now: int, threshold: float = 0.15) -> DataFrame:
    """Claims below the threshold, the most decayed first."""
    return with_decay(claims, now).where(F.col("decay") < max(0.0, min(1.0, threshold))).withColumn("decay", F.bround("decay", 4)).orderBy("decay", "id")


def decay_archive(claims: DataFrame, now: int, threshold: float = 0.05) -> DataFrame:
    """Claims below the threshold as archived, or as protected if pinned or of confidence .7 or more."""
    safe = F.coalesce("pinned", F.lit(False)) | (F.coalesce("confidence", F.lit(0.7)) >= 0.7)
    return with_decay(claims, now).where(F.col("decay") < threshold).withColumn("action", F.when(safe, "protected").otherwise("archived"))


def decay_stats(claims: DataFrame) -> DataFrame:
    return claims.where("status = 'active'").agg(
        F.count("*").alias("active"), F.avg("confidence").alias("avg_confidence"), F.avg("salience").alias("avg_salience"), F.avg("access_count").alias("avg_accesses"),
        F.max("updated_at").alias("newest"), F.min("updated_at").alias("oldest"),
    )


def collectable(claims: DataFrame, now: int, least_salience: float = 0.2, days: int = 180) -> DataFrame:
    """Claims for garbage collection: unpinned, of little salience and long untouched (a choice of this library)."""
    return claims.where(~F.coalesce("pinned", F.lit(False)) & (F.coalesce("salience", F.lit(0.7)) < least_salience) & (F.lit(now) - F.col("updated_at") > days * int(DAY)))


def superseded(claims: DataFrame, slot: list[str], by: list[str]) -> DataFrame:
    """Claims with status superseded where a newer one has the same slot in the same partition."""
    w = Window.partitionBy(*by, *slot).orderBy(F.desc("updated_at"), F.desc("id"))
    return claims.withColumn("status", F.when((F.row_number().over(w) > 1) & (F.col("status") == "active"), "superseded").otherwise(F.col("status")))


def contradictions(claims: DataFrame, slot: list[str], value: str) -> DataFrame:
    """Pairs (claim_a, claim_b), a before b, of active claims that give one slot different values.

    The first claim of each value of a slot stands for it, so every two values meet once, however many claims hold them.
    """
    first = claims.where("status = 'active'").groupBy(*slot, value).agg(F.min("id").alias("id"))
    a, b = first.select(*slot, F.col("id").alias("claim_a")), first.select(*slot, F.col("id").alias("claim_b"))
    return a.join(b, slot).where("claim_a < claim_b").select("claim_a", "claim_b")


def resolved(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """pairs(claim_a, claim_b, status) with the latest decision(claim_a, claim_b, decided_at, status)."""
    last = decisions.groupBy("claim_a", "claim_b").agg(F.max(F.struct("decided_at", "status"))["status"].alias("_s"))
    return pairs.join(last, ["claim_a", "claim_b"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


#: What decides between two claims, by policy: the larger is kept.
POLICIES = {"newest": ("updated_at", "confidence"), "confident": ("confidence", "updated_at"), "salient": ("salience", "confidence")}


def resolved_by_policy(pairs: DataFrame, claims: DataFrame, policy: str) -> DataFrame:
    """Open pairs(claim_a, claim_b, status) with kept, dropped and status by a policy of POLICIES.

    A pinned claim wins over one that isn't. Where all that the policy looks at is equal the pair stays open, with nothing kept. Pairs of claims that
    aren't there, or aren't active any more, are resolved: what is left is kept.
    """
    first, second = POLICIES[policy]
    worth = F.struct(F.coalesce("pinned", F.lit(False)).alias("p"), F.coalesce(F.col(first).cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col(second).cast("double"), F.lit(0.0)).alias("y"))
    live = claims.where("status = 'active'").select("id", worth.alias("w"))
    own = pairs.where("status = 'open'").join(live.toDF("claim_a", "_a"), "claim_a", "left").join(live.toDF("claim_b", "_b"), "claim_b", "left")
    a = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a") > F.col("_b")))
    b = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_b") > F.col("_a")))
    kept = F.when(a, F.col("claim_a")).when(b, F.col("claim_b"))
    dropped = F.when(a, F.col("claim_b")).when(b, F.col("claim_a"))
    tie = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") == F.col("_b"))
    return own.select("claim_a", "claim_b", kept.alias("kept"), dropped.alias("dropped"), F.when(tie, "open").otherwise("resolved").alias("status"))


def feedback(marks: DataFrame) -> DataFrame:
    """Counts of outcomes for each claim; a mark counts once for each (answer_id, claim_id, outcome)."""
    once = marks.where(F.col("outcome").isin("used", "helpful", "irrelevant", "contradicted", "harmful")).select("answer_id", "claim_id", "outcome").distinct()
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("used", "helpful", "irrelevant", "contradicted", "harmful")]
    return once.groupBy("claim_id").agg(*counts)


def latest_state(mutations: DataFrame, key: str = "id", order: str = "revision") -> DataFrame:
    """The present rows of an append-only log of mutations (op: upsert or delete): also journal replay."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return mutations.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op <> 'delete'").drop("_n", "op")


def undone(mutations: DataFrame, order: str = "revision") -> DataFrame:
    """The log without its last revision."""
    last = mutations.agg(F.max(order).alias("_last"))
    return mutations.join(F.broadcast(last), F.col(order) < F.col("_last"), "left_semi")


def recent(log: DataFrame, order: str, n: int) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def merged(store: DataFrame, other: DataFrame, digest: str, profile: str) -> DataFrame:
    """Two stores as one: rows of the other that the first lacks by digest, marked with their profile."""
    fresh = other.dropDuplicates([digest]).join(store.select(digest), digest, "left_anti")
    return store.withColumn("profile", F.lit("local")).unionByName(fresh.select(*store.columns).withColumn("profile", F.lit(profile)))


def topics(claims: DataFrame, aliases: dict[str, str], most: int = 8) -> DataFrame:
    """Claims by normalised topic: how many, and the ids of the most salient."""
    name = F.lower(F.trim("topic"))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    topic = F.coalesce(F.try_element_at(known, name), name) if known is not None else name
    w = Window.partitionBy("_topic").orderBy(F.desc("salience"), "id")
    best = claims.withColumn("_topic", topic).withColumn("_n", F.row_number().over(w))
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "id")))), lambda x: x["id"])
    return best.groupBy(F.col("_topic").alias("topic")).agg(F.count("*").alias("claims"), ids.alias("best"))


def health_window(claims: DataFrame, rows: int = 20_000) -> DataFrame:
    """The newest claims that a health check reads: by updated_at, ties by id."""
    return claims.orderBy(F.desc("updated_at"), "id").limit(rows)


def health_findings(claims: DataFrame, contradictions: DataFrame, rows: int = 20_000, best: int = 80) -> DataFrame:
    """The counts that ``health`` scores, one row, over the newest ``rows`` claims (id, topic, claim, status, confidence, salience, updated_at).

    anomalies: unknown states and blank topics. secrets: claims that hold one. low_quality: of the ``best`` most salient, those of
    confidence below .3. bad_topics: topics that aren't lower-case names. raw_blobs: claims of over 8,000 characters. artifacts:
    of under 10. open_contradictions: rows of contradictions(status) that are open.
    """
    from tessera.functions.text import has_secret

    own = health_window(claims, rows)
    top = own.orderBy(F.desc("salience"), F.desc("confidence"), "id").limit(best).agg(F.count_if(F.col("confidence") < 0.3).alias("low_quality"))
    size, topic = F.length("claim"), F.coalesce(F.trim("topic"), F.lit(""))
    found = own.agg(
        F.count_if(~F.col("status").isin("active", "archived", "superseded") | (topic == "")).alias("anomalies"), F.count_if(has_secret(F.col("claim"))).alias("secrets"),
        F.count_distinct(F.when(~topic.rlike("^[a-z0-9_-]*$"), topic)).alias("bad_topics"), F.count_if(size > 8000).alias("raw_blobs"), F.count_if(size < 10).alias("artifacts"),
    )
    disputed = contradictions.agg(F.count_if(F.col("status") == "open").alias("open_contradictions"))
    return found.crossJoin(top).crossJoin(disputed)  # one row each


def dashboard(claims: DataFrame) -> DataFrame:
    """Claims by topic and state: how many, mean confidence and salience, the newest."""
    return claims.groupBy("topic", "status").agg(F.count("*").alias("claims"), F.avg("confidence").alias("confidence"), F.avg("salience").alias("salience"), F.max("updated_at").alias("newest"))


def recall_recorded(items: DataFrame, claims: DataFrame, moment: int, source: str = "unified_recall") -> DataFrame:
    """Telemetry rows of a recall: one for each final item that is a claim still on record; other kinds leave none.

    items(kind, id, rrf, position), claims(id). recall_event_id follows from the claim, the place and the moment.
    """
    own = items.where("kind = 'claim'").join(claims.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    key = F.concat_ws("\0", F.lit(source), "id", F.col("position").cast("string"), F.lit(str(moment)))
    return own.select(
        F.concat(F.lit("recall_"), F.substring(F.sha2(key, 256), 1, 24)).alias("recall_event_id"), F.col("id").alias("claim_id"), F.col("rrf").alias("score"), "position",
        F.lit(True).alias("injected"), F.lit(source).alias("source"), F.lit(moment).alias("recalled_at"),
    )


def health(findings: DataFrame) -> DataFrame:
    """Scores from counts: anomalies, secrets, low_quality, bad_topics, raw_blobs, artifacts, open_contradictions. An overall score isn't given."""
    less = lambda x: F.greatest(F.lit(0.0), 1.0 - x)
    return findings.select(
        less(0.10 * F.col("anomalies")).alias("database"), less(0.10 * F.col("secrets")).alias("secrecy"),
        less(0.03 * F.col("low_quality") + 0.02 * F.col("bad_topics") + 0.04 * F.col("raw_blobs")).alias("semantic"),
        less(0.06 * F.col("artifacts")).alias("pollution"), less(0.015 * F.col("open_contradictions")).alias("contradiction"), F.lit(None).cast("double").alias("overall"),
    )


def evaluated(cases: DataFrame) -> DataFrame:
    """One row: cases, passed, score (null without cases). A case passes if found holds all of required and none of forbidden."""
    empty = F.array().cast("array<string>")
    found = F.coalesce("found", empty)
    ok = (F.size(F.array_except(F.coalesce("required", empty), found)) == 0) & (F.size(F.array_intersect(F.coalesce("forbidden", empty), found)) == 0)
    return cases.agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed")).withColumn("score", F.when(F.col("cases") > 0, F.col("passed") / F.col("cases")))


def retrieval_metrics(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query: any and all gold items within the first k, recall, and reciprocal rank. results(query_id, id, rank), gold(query_id, id)."""
    hit = gold.join(results.where(F.col("rank") <= k), ["query_id", "id"], "left")
    per = hit.groupBy("query_id").agg(F.count("*").alias("gold"), F.count("rank").alias("found"), F.min("rank").alias("_first"))
    return per.select(
        "query_id", (F.col("found") > 0).cast("int").alias("any_at_k"), (F.col("found") == F.col("gold")).cast("int").alias("all_at_k"),
        (F.col("found") / F.col("gold")).alias("recall_at_k"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def benchmark_report(questions: DataFrame, per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means of ``retrieval_metrics`` for each group of questions(query_id, by): questions, scored (those with gold), recall, any_found, all_found, mrr, to four digits.

    A question without gold counts as a question only; a group without any scored one has null means.
    """
    both = questions.join(per_query, "query_id", "left")
    mean = lambda c: F.round(F.avg(c), 4)
    return both.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count("recall_at_k").alias("scored"), mean("recall_at_k").alias("recall"), mean("any_at_k").alias("any_found"),
        mean("all_at_k").alias("all_found"), mean("reciprocal_rank").alias("mrr"),
    )


def summary(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median and the discrete 95th percentile of each column, by one reading of the rows."""
    parts = [x for c in columns for x in (F.avg(c), F.percentile(c, 0.5), F.expr(f"percentile_disc(0.95) within group (order by {c})").cast("double"))]
    one = per_query.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)])
    rows = F.array(*[F.struct(F.col(f"_{3 * i}").alias("mean"), F.col(f"_{3 * i + 1}").alias("median"), F.col(f"_{3 * i + 2}").alias("p95"), F.lit(c).alias("metric")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "role", "action").agg(F.count("*").alias("n"))


def session_scores(sessions: DataFrame, text: str = "text", by: str = "conv_id") -> DataFrame:
    """What a session is worth keeping: .25 for each kind of statement that it holds, and up to .3 for its length; 1 at most."""
    from tessera.functions.patterns import KEPT

    kinds = [F.max(F.coalesce(F.col(text).rlike("(?iU)" + p), F.lit(False)).cast("int")) for p in KEPT.values()]
    total = kinds[0] + kinds[1] + kinds[2] + kinds[3]
    return sessions.groupBy(by).agg(F.least(F.lit(1.0), 0.25 * total + F.least(F.lit(0.3), F.sum(F.length(text)) / 20_000)).alias("score"))


def block_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live blocks, live attachments) of shared blocks from their log: block_id, principal, op, at. A revoke or retire ends what came before."""
    last = latest_per(events, ["block_id", "principal", "family"], "at")
    blocks = last.where("family = 'block' and op = 'create'").select("block_id")
    grants = last.where("family = 'grant' and op = 'grant'").select("block_id", "principal")
    attached = last.where("family = 'attachment' and op = 'attach'").select("block_id", "principal")
    return blocks, attached.join(grants, ["block_id", "principal"]).join(blocks, "block_id", "left_semi")


def latest_per(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def registry_search(entries: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entries(key, text) scored by terms: 5 for the exact key, 3 within the key, 1 elsewhere; best first."""
    score = F.lit(0)
    for t in query.lower().split():
        key = F.lower("key")
        score = score + F.when(key == t, 5).when(F.contains(key, F.lit(t)), 3).when(F.contains(F.lower("text"), F.lit(t)), 1).otherwise(0)
    return entries.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def registry_lookup(entries: DataFrame, name: str) -> DataFrame:
    """The entries with this key or alias, case aside."""
    return entries.where((F.lower("key") == name.lower()) | F.exists("aliases", lambda a: F.lower(a) == name.lower()))
