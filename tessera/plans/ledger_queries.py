"""Queries of ledgers, observations, claims' lives, evaluation and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import access
from tessera.functions.patterns import KEPT
from tessera.operators import codeclaims, erasure, fusion, journal
from tessera.operators import ledger as L
from tessera.operators import lifecycle as C
from tessera.operators import observe
from tessera.plans.further_queries import _SECRET
from tessera.plans.tables import CLAIMS, LEDGER, NOW, claims, ledger, table


def owner_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage(ledger(spark, sf_dir), ["owner_bot_id"], ["props"])


def partition_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usage(ledger(spark, sf_dir).withColumns(L.partition_keys()), ["owner_bot_id", "visibility_scope", "chat_key", "session_key", "project_key"], ["event_type", "props"])


def visible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = access.Principal("bot1", "chat4", "s4", "p2")
    own = ledger(spark, sf_dir).where(reader.sees() & access.unexpired(NOW) & access.of_kinds("event_type", ["click", "error"]))
    return own.select("event_id", "event_type", "visibility_scope")


def valid_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir).withColumns({"valid_from": F.col("updated_at") - 86_400, "valid_to": F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("updated_at") + 1_000_000)})
    return own.where(access.in_status() & access.valid_at(NOW - 2_000_000)).select("id")


def live_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir)
    relations = own.select(F.col("id").alias("rid"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") + 1).alias("source_claim_id"), F.lit(0).alias("valid_from"), F.when(F.col("id") % 3 == 0, F.col("updated_at")).otherwise(0).alias("valid_to"))
    return access.relations_at(relations.withColumn("source_claim_id", F.col("source_claim_id").cast("string")), own.withColumn("id", F.col("id").cast("string")), NOW - 3_000_000).select("rid")


def unlinked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "doc_id")
    links = rows.select("source_id").distinct().select("source_id", F.when(F.col("source_id").endswith("3"), False).otherwise(True).alias("active"), F.when(F.col("source_id").endswith("7"), "other").otherwise("own").alias("scope_id"))
    return access.connected(rows, links, "own").groupBy("source_id").agg(F.count("*").alias("docs"))


def intact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 9 == 0, "0").otherwise(F.sha2("text", 256)).alias("content_hash"))
    return own.where(access.intact()).select("doc_id")


def shareable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("id")
    own = claims(spark, sf_dir).withColumns({"risk": F.when(d % 6 == 0, "secret"), "secrecy": F.when(d % 4 == 0, "private"), "quarantined": F.when(d % 10 == 0, True), "visibility": F.when(d % 2 == 0, "global").otherwise("chat"), "is_artifact": d % 14 == 0})
    return own.select("id", access.shareable().alias("shareable"), access.foreign_eligible().alias("foreign_eligible"))


def rejected_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = access.accepted(claims(spark, sf_dir), access.claim_rules())
    return good.agg(F.count("*").alias("rows")).withColumn("reason", F.lit("none")).unionByName(bad.groupBy(F.col("rejected_for").alias("reason")).agg(F.count("*").alias("rows")))


def unerased(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("digest"))
    return access.without_erased(own, own.where("doc_id % 8 = 0")).select("doc_id")


#: The secret of the digests that stand for erased phrases; a store has its own.
ERASURE_KEY = b"a key for examples"


def contained_erasures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words of every fiftieth document, and one long word of others, are erased: the texts that hold them, and how many they hold."""
    docs = table(spark, sf_dir, "documents")
    words = F.split(erasure.normal(F.col("text")), " ")
    five = docs.where("doc_id % 50 = 0").select(F.concat_ws(" ", F.slice(words, 3, 5)).alias("phrase"))
    one = docs.where("doc_id % 50 = 25").select(F.get(words, F.lit(1)).alias("phrase")).where(F.char_length("phrase") >= 6)
    known = erasure.markers(five.where("phrase <> ''").unionByName(one), ERASURE_KEY)
    found = erasure.hits(docs, known, ERASURE_KEY, ["doc_id"], "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("phrases"))


def episode_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").where(access.episode_rules()["role"]).withColumn("bot", F.col("conv_id") % 5)
    return L.retained(own, ["bot"], ["conv_id", "turn", "role"], ["text"], 60, 40_000).select("bot", "conv_id", "turn", "role")


def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.retained(ledger(spark, sf_dir), ["owner_bot_id"], ["created_at", "occurred_at", "event_id"], ["event_type", "props"], 2000, 20_000).select("event_id")


def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"))
    return L.newest_versions(own, "key", 3)


def evidence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evidence_sample(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 8)


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return L.latest_operation(own, "user_id", "event_id")


def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("key"), F.when(F.col("event_id") % 2 == 0, "a").otherwise(F.col("event_type")).alias("payload"), "event_id")
    first, clash = L.idempotent(own, "key", "payload", "event_id")
    return first.select("event_id", F.lit("kept").alias("as")).unionByName(clash.select("event_id", F.lit("conflict").alias("as")))


def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coalesced_jobs(table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("job_key"), F.col("event_id").alias("watermark")))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("event_id")
    return ledger(spark, sf_dir).select(
        d.alias("job_id"), F.when(d % 5 == 0, "pending").when(d % 5 == 1, "running").when(d % 5 == 2, "dead").otherwise("done").alias("status"), (d % 7).cast("int").alias("attempts"),
        (F.lit(NOW) - 500 + d % 1000).alias("lease_until"), "created_at",
    )


def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.job_health(_jobs(spark, sf_dir), NOW)


def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("attempts", L.backoff(F.col("attempts")).alias("wait")).agg(F.count("*").alias("jobs"))


def undecided_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ledger(spark, sf_dir)
    retries = own.where("event_id % 6 = 1").select("event_id", (F.lit(NOW) - 100 + F.col("event_id") % 200).alias("due_at"))
    return L.undecided(own, own.where("event_id % 2 = 0"), retries, NOW).select("event_id")


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("outcome", F.when(F.col("event_type") == "error", "error").otherwise("ok")).withColumn("ms", F.col("value") * 300)
    return L.latency_histogram(own, "event_type", "outcome", "ms", "ts")


def latency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latency_snapshot(latency_histogram(spark, sf_dir), NOW // 86_400 - 2, 7)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ledger(spark, sf_dir).select(
        "owner_bot_id", "visibility_scope", "event_id", F.col("event_type").alias("topic"), F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, "the"), "event_type", F.lit("of a"), F.get_json_object("props", "$.k")).alias("content"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("event_id") % 500)).alias("turn_id"), "occurred_at", F.col("occurred_at").alias("observed_at"), "created_at", "expires_at",
    )
    out = observe.consolidated(own, ["owner_bot_id", "visibility_scope"], NOW, ascii_only=True)
    return out.select("owner_bot_id", "visibility_scope", "topic", "cluster_key", "support", "independent", "content", "first_seen", "last_seen", "expires_at", F.round("confidence", 4).alias("confidence"))


def changed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = observations(spark, sf_dir).withColumn("observation_id", F.concat_ws(":", "owner_bot_id", "visibility_scope", "cluster_key"))
    digest = F.sha2(F.to_json(F.struct("content", "support", "independent", "confidence", "first_seen", "last_seen")), 256)
    before = own.where("support % 2 = 0").select("observation_id", F.lit(3).alias("version"), F.when(F.col("support") % 4 == 0, "old").otherwise(digest).alias("digest"))
    return observe.versioned(own, before).groupBy("version").agg(F.count("*").alias("observations"))


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("changed_at"))
    return observe.history(own, "id", "changed_at").select("id", "valid_from", "valid_to", "version")


def decay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decay_scan(claims(spark, sf_dir), NOW, 0.6).select("id", "topic", F.round("decay", 3).alias("decay"))


def decay_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decay_archive(claims(spark, sf_dir), NOW, 0.5).groupBy("action").agg(F.count("*").alias("claims"))


def decay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.decay_stats(claims(spark, sf_dir))
    return s.select("active", *[F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_salience", "avg_accesses")], "newest", "oldest")


def garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collectable(claims(spark, sf_dir), NOW, 0.3, 30).select("id")


def superseded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir).withColumn("slot", F.col("id") % 60)
    return C.superseded(own, ["slot"], ["project"]).select("id", "status")


def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir).withColumn("slot", F.col("id") % 100)
    pairs = C.contradictions(own, ["slot"], "project").withColumn("status", F.lit("open"))
    decided = pairs.where("claim_b % 3 = 0").select("claim_a", "claim_b", F.col("claim_b").alias("decided_at"), F.lit("resolved").alias("status"))
    return C.resolved(pairs, decided).select("claim_a", "claim_b", "status")


def policy_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of one topic in two languages, decided by confidence and then by age."""
    own = claims(spark, sf_dir).withColumn("confidence", F.floor(F.col("confidence") * 3) / 3)
    pairs = C.contradictions(claims(spark, sf_dir), ["topic"], "project").withColumn("status", F.when((F.col("claim_a") + F.col("claim_b")) % 4 == 0, "resolved").otherwise("open"))
    return C.resolved_by_policy(pairs, own.where("id % 13 <> 6"), "confident").select("claim_a", "claim_b", "kept", "status")


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metadata, symbols, outcomes): claims on symbols by document, the symbols as they are now, and orders as patches."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    symbol = F.concat(F.lit("s"), d % 40)
    content = lambda n: F.md5(F.concat(F.lit("c"), n))
    metadata = docs.select(d.alias("claim_id"), F.col("source").alias("repository_id"), F.concat_ws("/", "lang", F.concat(F.lit("f"), d % 8)).alias("file_path"), symbol.alias("symbol_id"), F.concat(F.lit("r"), d % 3).alias("symbol_revision"), content(d % 6).alias("content_hash"))
    symbols = metadata.where(F.substring("symbol_id", 2, 9).cast("int") % 5 != 0).groupBy("repository_id", "symbol_id").agg(F.max("content_hash").alias("content_hash"))
    o = F.col("o_orderkey")
    files = F.to_json(F.array(F.concat(F.lit("en/f"), o % 8), F.concat(F.lit("de/f"), o % 5)))
    changed = F.when(o % 3 != 0, F.to_json(F.array(F.concat(F.lit("s"), o % 40), F.concat(F.lit("s"), o % 40))))
    outcomes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("repository_id"), (o % 700).alias("patch_id"), o.alias("claim_id"), F.when(F.col("o_orderstatus") == "F", " Applied").when(F.col("o_orderstatus") == "O", "rolled_back").otherwise("odd").alias("outcome"),
        content(o % 6).alias("old_content_hash"), content((o + 1) % 6).alias("new_content_hash"), files.alias("changed_files"), changed.alias("changed_symbols"), o.alias("created_at"), o.alias("updated_at"),
    )
    return metadata, symbols, codeclaims.recorded_outcomes(outcomes.where(F.col("created_at") % 2 == 0), outcomes.where(F.col("created_at") % 2 == 1))


def repository_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each repository."""
    return codeclaims.repository_context(claims(spark, sf_dir), *_code(spark, sf_dir))


def patched_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patches did to claims."""
    metadata, _, outcomes = _code(spark, sf_dir)
    return codeclaims.patched(outcomes, metadata).groupBy("repository_id", "effect").agg(F.count("*").alias("claims"), F.count_distinct("patch_id").alias("patches"))


def symbol_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeclaims.symbol_revisions(_code(spark, sf_dir)[0]).select("repository_id", "symbol_id", "symbol_revision", "claims", "place", "before", "changed")


def recall_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("event_id")
    marks = table(spark, sf_dir, "events").select((d % 800).alias("answer_id"), (d % 40).alias("claim_id"), F.when(d % 5 == 0, "used").when(d % 5 == 1, "helpful").when(d % 5 == 2, "irrelevant").when(d % 5 == 3, "harmful").otherwise("seen").alias("outcome"))
    return C.feedback(marks)


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return C.latest_state(C.undone(log)).select("id", "revision", "value")


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of ten stores: transactions of two users' events of 300 ids, some begun anew, aborted or left open, with undo and redo."""
    e, u = F.col("event_id"), F.col("user_id")
    op = F.when(e % 19 == 0, "begin").when(e % 13 == 0, "commit").when(e % 17 == 0, "undo").when(e % 23 == 0, "redo").when(e % 29 == 0, "abort").when(F.col("event_type") == "error", "delete").otherwise("upsert")
    tx = F.when(e % 5 != 0, F.concat_ws("-", u % 20, F.floor(e / 300)))
    return table(spark, sf_dir, "events").select((u % 10).alias("scope"), e.alias("revision"), tx.alias("tx"), op.alias("op"), (u * 3 + e % 3).alias("key"), "value")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every key holds after committed transactions, undo and redo."""
    return journal.state(_mutations(spark, sf_dir), "key").select("scope", "key", "revision", "value")


def transaction_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since when and until when each mutation in effect held, and by which transaction."""
    return journal.lineage(_mutations(spark, sf_dir), "key").select("scope", "key", "revision", F.coalesce("tx", F.lit("")).alias("tx"), "since", "until", "place")


def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent(table(spark, sf_dir, "orders"), "o_orderkey", 25).select("o_orderkey", "o_orderstatus")


def merged_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return C.merged(own.where("doc_id % 2 = 0"), own.where("doc_id % 2 = 1").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest"), "digest", "other").select("doc_id", "profile")


def topic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.topics(claims(spark, sf_dir), {"src0": "main", "src1": "main"}, 5)
    return out.select("topic", "claims", F.concat_ws(",", F.transform("best", lambda x: x.cast("string"))).alias("best"))


def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over the newest 20,000 claims, and the scores that follow; a topic's claims in two languages contradict each other, and some of these pairs are open."""
    own = claims(spark, sf_dir).withColumn("status", F.when(F.col("id") % 1009 == 0, "lost").otherwise(F.col("status")))
    own = own.withColumn("topic", F.when(F.col("id") % 997 == 0, F.upper("topic")).otherwise(F.col("topic")))
    pairs = C.contradictions(claims(spark, sf_dir), ["topic"], "project")
    found = C.health_findings(own, pairs.select(F.when((F.col("claim_a") + F.col("claim_b")) % 7 == 0, "open").otherwise("resolved").alias("status")))
    counts = ["anomalies", "secrets", "low_quality", "bad_topics", "raw_blobs", "artifacts", "open_contradictions"]
    scores = C.health(found).select(*[F.round(c, 6).alias(c) for c in ("database", "secrecy", "semantic", "pollution", "contradiction")])
    return found.select(*counts).crossJoin(scores)  # one row each


def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "documents").select("source", F.array(F.col("lang")).alias("required"), F.array(F.lit("xx"), F.when(F.col("doc_id") % 9 == 0, "en")).alias("forbidden"), F.array("lang", F.lit("zz")).alias("found"))
    return C.evaluated(cases.withColumn("forbidden", F.array_compact("forbidden"))).select("cases", "passed", F.round("score", 6).alias("score"))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    results = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"))
    gold = lines.where("l_linenumber % 3 = 0 or l_quantity > 30").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).distinct()
    per = C.retrieval_metrics(results.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), gold, 5)
    out = C.summary(per, ["any_at_k", "all_at_k", "recall_at_k", "reciprocal_rank"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


def ingestion_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 3 == 0, "keep").otherwise("drop").alias("gold"), "role", F.when(F.length("text") > 300, "keep").otherwise("drop").alias("action"))
    return C.confusion(own)


def session_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.session_scores(table(spark, sf_dir, "conversations")).select("conv_id", F.round("score", 6).alias("score"))


def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("event_id")
    family = F.when(d % 11 < 2, "block").when(d % 11 < 6, "grant").otherwise("attachment")
    op = F.when(family == "block", F.when(d % 2 == 0, "create").otherwise("retire")).when(family == "grant", F.when(d % 4 == 0, "revoke").otherwise("grant")).otherwise(F.when(d % 7 == 0, "detach").otherwise("attach"))
    log = table(spark, sf_dir, "events").select((d % 30).alias("block_id"), F.when(family == "block", "").otherwise(F.concat(F.lit("u"), F.col("user_id") % 10)).alias("principal"), family.alias("family"), op.alias("op"), d.alias("at"))
    return C.block_events(log)[1].select("block_id", "principal")


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.concat_ws("/", F.lower("p_brand"), "p_partkey").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return C.registry_search(entries, "brand#13 1", 20)


def shared_block_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 8 blocks of each principal that fit 2,400 characters; one that doesn't fit is skipped."""
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("principal"), (-F.col("doc_id")).alias("newest"), F.col("n_chars").alias("chars"))
    best = fusion.capped_per_group(own, "principal", [F.col("newest")], 8)
    return fusion.greedy_budget(best, "principal", "chars", ["newest"], 2400, 8)


def embedding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").withColumn("embedded", F.col("doc_id") % 3 == 0)
    return own.groupBy("lang").agg(F.count_if("embedded").alias("embedded"), F.count_if(~F.col("embedded")).alias("pending"), F.max("doc_id").alias("newest"))


def fresh_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user since the last error: a running state as a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    own = table(spark, sf_dir, "events").withColumn("errors", F.sum((F.col("event_type") == "error").cast("int")).over(w))
    last = own.withColumn("_m", F.max("errors").over(Window.partitionBy("user_id"))).where("errors = _m and event_type <> 'error'")
    return last.groupBy("user_id").agg(F.count("*").alias("since_error"))


QUERIES = {f.__name__: f for f in (
    owner_usage, partition_usage, visible_events, valid_claims, live_relations, unlinked_sources, intact_documents, shareable_claims, rejected_claims, unerased, contained_erasures, episode_retention, event_retention,
    version_retention, evidence_samples, outbox, idempotent_events, coalesced, job_health, job_backoff, undecided_events, latency_histogram, latency_snapshot, observations, changed_observations,
    order_history, decay_scan, decay_archive, decay_stats, garbage, superseded_claims, claim_contradictions, policy_resolutions, repository_contexts, patched_claims, symbol_revisions, recall_feedback, journal_replay, transactions, transaction_lineage, recent_changes, merged_stores, topic_summaries,
    health_scores, retrieval_evaluation, quality_metrics, ingestion_confusion, session_worth, shared_blocks, registry_search, shared_block_render,
    embedding_status, fresh_prefixes,
)}

_DECAY = f"""greatest(0.0, 1.0 - 0.015 / greatest(0.3, confidence * salience) * greatest(0.0, ({NOW} - case when freshness_at > 0 then freshness_at else updated_at end) / 86400.0) + 0.05 * ln(1 + access_count))"""
_BUCKET = "list_min(list_filter([5, 10, 25, 50, 100, 250, 500, 1000, 2000, 5000, 10000, 30000, 60000, 300000], lambda b: b >= ms))"
_HIST = f"""h as (select day_utc, operation, outcome, {_BUCKET} as latency_bucket_ms, count(*) as sample_count, cast(sum(ms) as bigint) as duration_sum_ms, max(ms) as duration_max_ms
    from (select cast(floor(epoch(ts) / 86400) as bigint) as day_utc, event_type as operation, case when event_type = 'error' then 'error' else 'ok' end as outcome,
    greatest(0, least(300000, cast(round_even(value * 300, 0) as bigint))) as ms from events) group by all)"""
_OBS = LEDGER + f""", e as (select *, case when event_id % 2 = 0 then 'the ' else '' end || event_type || ' of a ' || json_extract_string(props, '$.k') as content, case when event_id % 4 = 0 then '' else 't' || (event_id % 500) end as turn_id,
    event_type || ' of ' || json_extract_string(props, '$.k') as cluster_key from ledger),
    o as (select owner_bot_id, visibility_scope, event_type as topic, cluster_key, count(*) as support, count(distinct nullif(turn_id, '')) + max((turn_id = '')::int) as independent,
    arg_max(content, (occurred_at, created_at, event_id)) as content, min(occurred_at) as first_seen, max(occurred_at) as last_seen,
    least(coalesce(min(case when expires_at > 0 then expires_at end), 9e17::bigint), {NOW} + 365 * 86400) as expires_at from e group by all),
    obs as (select *, round_even(least(0.85, 0.35 + 0.15 * log2(independent)), 4) as confidence from o)"""

#: The patterns of statements worth keeping as DuckDB takes them, which has no look-behind: an end of sentence is read instead of looked back at.
_KEPT = [p.replace(r"(?:(?<=[.!?])\s|$)", r"(?:[.!?]\s|$)").replace("'", "''") for p in KEPT.values()]

ORACLES = {
    "owner_usage": "with " + LEDGER + " select owner_bot_id, count(*) as row_count, cast(sum(octet_length(encode(props))) as bigint) as byte_count from ledger group by 1",
    "partition_usage": "with " + LEDGER + """ select owner_bot_id, visibility_scope, case when visibility_scope = 'chat' then owner_chat_hash else '' end as chat_key,
        case when visibility_scope = 'chat' then owner_session_hash else '' end as session_key, case when visibility_scope = 'project' then project_id else '' end as project_key,
        count(*) as row_count, cast(sum(octet_length(encode(event_type)) + octet_length(encode(props))) as bigint) as byte_count from ledger group by all""",
    "visible_events": "with " + LEDGER + f""" select event_id, event_type, visibility_scope from ledger where owner_bot_id = 'bot1' and (expires_at = 0 or expires_at > {NOW}) and event_type in ('click', 'error')
        and (visibility_scope = 'bot' or visibility_scope = 'project' and project_id = 'p2' or visibility_scope = 'chat' and owner_chat_hash = 'chat4' and owner_session_hash = 's4')""",
    "valid_claims": "with " + CLAIMS + f" select id from claims where status = 'active' and updated_at - 86400 <= {NOW - 2_000_000} and (id % 4 = 0 or updated_at + 1000000 > {NOW - 2_000_000})",
    "live_relations": "with " + CLAIMS + f""" select r.id as rid from claims r where (r.id % 3 <> 0 or r.updated_at > {NOW - 3_000_000}) and (r.id % 5 = 0 or exists (select 1 from claims c where c.id = r.id + 1 and c.status = 'active'))""",
    "unlinked_sources": "select source as source_id, count(*) as docs from documents where source not like '%3' and source not like '%7' group by 1",
    "intact_documents": "select doc_id from documents where doc_id % 9 <> 0",
    "shareable_claims": "with " + CLAIMS + """ select id, status = 'active' and id % 6 <> 0 and id % 4 <> 0 and id % 10 <> 0 as shareable, id % 2 = 0 and status = 'active' and id % 6 <> 0 and id % 14 <> 0 as foreign_eligible from claims""",
    "rejected_claims": "select case when length(text) between 10 and 8000 then 'none' else 'claim length' end as reason, count(*) as rows from documents group by 1",
    "unerased": "select doc_id from documents d where not exists (select 1 from documents e where e.doc_id % 8 = 0 and lower(trim(e.text)) = lower(trim(d.text)))",
    "contained_erasures": """with n as (select doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as t from documents),
        p as (select distinct phrase from (select array_to_string(string_split(t, ' ')[3:7], ' ') as phrase from n where doc_id % 50 = 0
            union all select string_split(t, ' ')[2] from n where doc_id % 50 = 25 and length(string_split(t, ' ')[2]) >= 6) where phrase <> ''),
        c as materialized (select doc_id, t, phrase from n join p on contains(t, phrase))
        select doc_id, count(*) as phrases from c where regexp_matches(t, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(phrase) || '($|[^\\p{L}\\p{N}_])') group by doc_id""",
    "episode_retention": """select bot, conv_id, turn, role from (select conv_id % 5 as bot, *, row_number() over w as n, sum(octet_length(encode(text))) over w as b from conversations where role in ('user', 'assistant')
        window w as (partition by conv_id % 5 order by conv_id desc, turn desc, role desc rows between unbounded preceding and current row)) where n <= 60 and b <= 40000""",
    "event_retention": "with " + LEDGER + """ select event_id from (select *, row_number() over w as n, sum(octet_length(encode(event_type)) + octet_length(encode(props))) over w as b from ledger
        window w as (partition by owner_bot_id order by created_at desc, occurred_at desc, event_id desc rows between unbounded preceding and current row)) where n <= 2000 and b <= 20000""",
    "version_retention": "select o_custkey as key, o_orderkey as version from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) <= 3",
    "evidence_samples": "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id) <= 2 or row_number() over (partition by user_id order by event_id desc) <= 6",
    "outbox": "select user_id, event_id, case when event_type = 'error' then 'delete' else 'upsert' end as op from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "idempotent_events": """with e as (select event_id % 3000 as key, case when event_id % 2 = 0 then 'a' else event_type end as p, event_id from events),
        m as (select *, row_number() over w as n, first_value(p) over w as f from e window w as (partition by key order by event_id))
        select event_id, case when n = 1 then 'kept' else 'conflict' end as "as" from m where n = 1 or p <> f""",
    "coalesced": "select event_type || ':' || user_id as job_key, max(event_id) as watermark, count(*) as requests from events group by 1",
    "job_health": "with " + LEDGER + f""", j as (select *, event_id % 5 as s, event_id % 7 as attempts, {NOW} - 500 + event_id % 1000 as lease_until from ledger)
        select count(*) filter (s = 0) as pending, count(*) filter (s = 1) as running, count(*) filter (s > 2) as done, count(*) filter (s = 2 or attempts >= 5) as dead,
        count(*) filter (s = 1 and lease_until < {NOW}) as expired_leases, {NOW} - min(case when s = 0 then created_at end) as oldest_pending_age from j""",
    "job_backoff": "select cast(event_id % 7 as integer) as attempts, cast(least(3600, 30 * pow(2, greatest(event_id % 7, 1) - 1)) as bigint) as wait, count(*) as jobs from events group by all",
    "undecided_events": f"select event_id from events where event_id % 2 = 1 and (event_id % 6 <> 1 or {NOW} - 100 + event_id % 200 <= {NOW})",
    "latency_histogram": "with " + _HIST + " select * from h",
    "latency_snapshot": "with " + _HIST + f""", b as (select operation, latency_bucket_ms, sum(sample_count) as n, sum(duration_sum_ms) as s from h where day_utc between {NOW // 86_400 - 8} and {NOW // 86_400 - 2} group by all),
        r as (select *, sum(n) over (partition by operation order by latency_bucket_ms) as seen, sum(n) over (partition by operation) as total from b)
        select operation, cast(sum(n) as bigint) as samples, min(case when seen >= greatest(1, ceil(total * 0.5)) then latency_bucket_ms end) as latency_p50_upper_ms,
        min(case when seen >= greatest(1, ceil(total * 0.95)) then latency_bucket_ms end) as latency_p95_upper_ms, round_even(sum(s) / sum(n), 1) as latency_mean_ms from r group by 1""",
    "observations": "with " + _OBS + " select * from obs",
    "changed_observations": "with " + _OBS + " select case when support % 2 = 0 then 4 else 1 end as version, count(*) as observations from obs where support % 2 = 1 or support % 4 = 0 group by 1",
    "order_history": "select o_custkey as id, o_orderkey as valid_from, lead(o_orderkey) over w as valid_to, cast(row_number() over w as integer) as version from orders window w as (partition by o_custkey order by o_orderkey)",
    "decay_scan": "with " + CLAIMS + f" select id, topic, round(round_even({_DECAY}, 4), 3) as decay from claims where status = 'active' and {_DECAY} < 0.6",
    "decay_archive": "with " + CLAIMS + f" select case when pinned or confidence >= 0.7 then 'protected' else 'archived' end as action, count(*) as claims from claims where status = 'active' and {_DECAY} < 0.5 group by 1",
    "decay_stats": "with " + CLAIMS + " select count(*) as active, round(avg(confidence), 6) as avg_confidence, round(avg(salience), 6) as avg_salience, round(avg(access_count), 6) as avg_accesses, max(updated_at) as newest, min(updated_at) as oldest from claims where status = 'active'",
    "garbage": "with " + CLAIMS + f" select id from claims where not pinned and salience < 0.3 and {NOW} - updated_at > 30 * 86400",
    "superseded_claims": "with " + CLAIMS + " select id, case when status = 'active' and row_number() over (partition by project, id % 60 order by updated_at desc, id desc) > 1 then 'superseded' else status end as status from claims",
    "claim_contradictions": "with " + CLAIMS + """, r as (select id % 100 as slot, project, min(id) as id from claims where status = 'active' group by all)
        select a.id as claim_a, b.id as claim_b, case when b.id % 3 = 0 then 'resolved' else 'open' end as status from r a join r b on a.slot = b.slot and a.id < b.id""",
    "recall_feedback": """with m as (select distinct event_id % 800 as a, event_id % 40 as c, event_id % 5 as o from events where event_id % 5 < 4)
        select c as claim_id, count(*) filter (o = 0) as used, count(*) filter (o = 1) as helpful, count(*) filter (o = 2) as irrelevant, cast(0 as bigint) as contradicted, count(*) filter (o = 3) as harmful from m group by c""",
    "journal_replay": """with l as (select * from events where event_id < (select max(event_id) from events) qualify row_number() over (partition by user_id order by event_id desc) = 1)
        select user_id as id, event_id as revision, value from l where event_type <> 'error'""",
    "recent_changes": "select o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 25",
    "merged_stores": """select doc_id, 'local' as profile from documents where doc_id % 2 = 0
        union all select min(doc_id), 'other' from documents where doc_id % 2 = 1 and md5(text) not in (select md5(text) from documents where doc_id % 2 = 0) group by md5(text)""",
    "topic_summaries": "with " + CLAIMS + """, t as (select id, case when topic in ('src0', 'src1') then 'main' else topic end as topic, salience from claims), r as (select *, row_number() over (partition by topic order by salience desc, id) as n from t)
        select topic, count(*) as claims, string_agg(id::varchar, ',' order by n) filter (n <= 5) as best from r group by topic""",
    "health_scores": "with " + CLAIMS + """, m as (select id, claim, confidence, salience, updated_at, case when id % 1009 = 0 then 'lost' else status end as status, case when id % 997 = 0 then upper(topic) else topic end as topic from claims),
        w as (select * from m order by updated_at desc, id limit 20000), t as (select * from w order by salience desc, confidence desc, id limit 80), p as (select topic, project, min(id) as id from claims where status = 'active' group by all),
        f as (select (select count(*) from w where status not in ('active', 'archived', 'superseded') or trim(coalesce(topic, '')) = '') as anomalies, (select count(*) from t where confidence < 0.3) as low_quality,
            (select count(distinct trim(topic)) from w where not regexp_full_match(trim(coalesce(topic, '')), '[a-z0-9_-]*')) as bad_topics, (select count(*) from w where length(claim) > 8000) as raw_blobs,
            (select count(*) from w where length(claim) < 10) as artifacts, (select count(*) from (select claim as text from w) where """ + _SECRET + """) as secrets,
            (select count(*) from p a join p b on a.topic = b.topic and a.id < b.id where (a.id + b.id) % 7 = 0) as open_contradictions)
        select *, round(greatest(0, 1 - 0.1::double * anomalies), 6) as database, round(greatest(0, 1 - 0.1::double * secrets), 6) as secrecy, round(greatest(0, 1 - (0.03::double * low_quality + 0.02::double * bad_topics + 0.04::double * raw_blobs)), 6) as semantic,
            round(greatest(0, 1 - 0.06::double * artifacts), 6) as pollution, round(greatest(0, 1 - 0.015::double * open_contradictions), 6) as contradiction from f""",
    "retrieval_evaluation": "select count(*) as cases, count(*) filter (not (doc_id % 9 = 0 and lang = 'en')) as passed, round(count(*) filter (not (doc_id % 9 = 0 and lang = 'en')) / count(*), 6) as score from documents",
    "quality_metrics": """with r as (select l_orderkey as q, l_partkey as i, min(l_linenumber) as rank from lineitem group by all), g as (select distinct l_orderkey as q, l_partkey as i from lineitem where l_linenumber % 3 = 0 or l_quantity > 30),
        p as (select g.q, count(*) as gold, count(r.rank) as found, min(r.rank) as f from g left join (select * from r where rank <= 5) r using (q, i) group by g.q),
        m as (select unnest(['any_at_k', 'all_at_k', 'recall_at_k', 'reciprocal_rank']) as metric, unnest([(found > 0)::int::double, (found = gold)::int::double, found / gold, coalesce(1 / f, 0)]) as v from p)
        select metric, round(avg(v), 6) as mean, round(median(v), 6) as median, round(quantile_disc(v, 0.95), 6) as p95 from m group by metric""",
    "ingestion_confusion": "select case when conv_id % 3 = 0 then 'keep' else 'drop' end as gold, role, case when length(text) > 300 then 'keep' else 'drop' end as action, count(*) as n from conversations group by all",
    "shared_blocks": """with l as (select event_id % 30 as block_id, case when event_id % 11 < 2 then 'block' when event_id % 11 < 6 then 'grant' else 'attachment' end as family, 'u' || (user_id % 10) as u, event_id as d from events),
        m as (select *, case family when 'block' then '' else u end as principal, case family when 'block' then d % 2 = 0 when 'grant' then d % 4 <> 0 else d % 7 <> 0 end as live from l),
        s as (select * from m qualify row_number() over (partition by block_id, principal, family order by d desc) = 1)
        select a.block_id, a.principal from s a join s g on a.block_id = g.block_id and a.principal = g.principal and g.family = 'grant' and g.live
        join s b on b.block_id = a.block_id and b.family = 'block' and b.live where a.family = 'attachment' and a.live""",
    "shared_block_render": """with recursive t as (select source as principal, -doc_id as newest, n_chars as chars, row_number() over (partition by source order by doc_id desc) as i from documents),
        w as (select principal, i, newest, chars, chars <= 2400 as taken, case when chars <= 2400 then chars else 0 end as used from t where i = 1
        union all select t.principal, t.i, t.newest, t.chars, w.used + t.chars <= 2400, case when w.used + t.chars <= 2400 then w.used + t.chars else w.used end
            from w join t on t.principal = w.principal and t.i = w.i + 1 where t.i <= 8)
        select principal, newest, cast(chars as integer) as chars from w where taken""",
    "embedding_status": "select lang, count(*) filter (doc_id % 3 = 0) as embedded, count(*) filter (doc_id % 3 <> 0) as pending, max(doc_id) as newest from documents group by lang",
    "session_worth": "with k as (select conv_id, sum(length(text)) as chars, " + ", ".join(f"max(regexp_matches(coalesce(text, ''), '(?i){p}')::int) as k{i}" for i, p in enumerate(_KEPT)) + """ from conversations group by 1)
        select conv_id, round(least(1.0, 0.25 * (k0 + k1 + k2 + k3) + least(0.3, chars / 20000)), 6) as score from k""",
    "fresh_prefixes": """with e as (select *, sum((event_type = 'error')::int) over (partition by user_id order by event_id) as k from events), m as (select *, max(k) over (partition by user_id) as m from e)
        select user_id, count(*) as since_error from m where k = m and event_type <> 'error' group by 1""",
    "registry_search": """with e as (select lower(p_brand) || '/' || p_partkey as key, p_name || ' ' || p_type as text from part),
        s as (select *, case when key = 'brand#13' then 5 when contains(key, 'brand#13') then 3 when contains(lower(text), 'brand#13') then 1 else 0 end
        + case when key = '1' then 5 when contains(key, '1') then 3 when contains(lower(text), '1') then 1 else 0 end as score from e)
        select key, text, score from s where score > 0 order by score desc, key limit 20""",
}

#: Control records are folded one after another; a level's last commit counts up to the last level.
_LOG = """l as (select user_id % 10 as scope, event_id as revision, case when event_id % 5 <> 0 then (user_id % 20) || '-' || (event_id // 300) end as tx, user_id * 3 + event_id % 3 as key, value,
        case when event_id % 19 = 0 then 'begin' when event_id % 13 = 0 then 'commit' when event_id % 17 = 0 then 'undo' when event_id % 23 = 0 then 'redo' when event_id % 29 = 0 then 'abort'
            when event_type = 'error' then 'delete' else 'upsert' end as op from events),
    g as (select *, count(*) filter (op = 'begin') over w + coalesce(count(*) filter (op in ('commit', 'abort')) over (partition by scope, tx order by revision rows between unbounded preceding and 1 preceding), 0) as grp
        from l where tx is not null and op not in ('undo', 'redo') window w as (partition by scope, tx order by revision rows between unbounded preceding and current row)),
    c as (select scope, tx, grp, revision as eff from g where op = 'commit' union all select scope, null, null, revision from l where tx is null and op in ('upsert', 'delete')),
    k as (select *, row_number() over (partition by scope order by eff) as i from (select scope, eff, 'commit' as kind from c union all select scope, revision, op from l where op in ('undo', 'redo'))),
    f as (select scope, 0::bigint as i, 0 as level, 0 as undone, null::bigint as eff from (select distinct scope from k)
        union all select f.scope, k.i, case when kind = 'commit' then level + 1 when kind = 'undo' and level > 0 then level - 1 when kind = 'redo' and undone > 0 then level + 1 else level end,
            case when kind = 'commit' then 0 when kind = 'undo' and level > 0 then undone + 1 when kind = 'redo' and undone > 0 then undone - 1 else undone end, case when kind = 'commit' then k.eff end
        from f join k on k.scope = f.scope and k.i = f.i + 1),
    t as (select scope, max_by(level, i) as top from f group by scope), s as (select scope, level, max(eff) as eff from f where eff is not null group by all),
    x as (select s.scope, s.eff, c.tx, c.grp from s join t using (scope) join c on c.scope = s.scope and c.eff = s.eff where level <= top),
    m as (select g.scope, g.revision, g.tx, g.op, g.key, g.value, x.eff from g join x on g.scope = x.scope and g.tx = x.tx and g.grp = x.grp where g.op in ('upsert', 'delete')
        union all select l.scope, l.revision, l.tx, l.op, l.key, l.value, x.eff from l join x on l.scope = x.scope and l.revision = x.eff where l.tx is null and l.op in ('upsert', 'delete'))"""
ORACLES["transactions"] = "with recursive " + _LOG + " select scope, key, revision, value from (select *, row_number() over (partition by scope, key order by eff desc, revision desc) as n from m) where n = 1 and op = 'upsert'"
ORACLES["transaction_lineage"] = "with recursive " + _LOG + """ select scope, key, revision, coalesce(tx, '') as tx, eff as since, lead(eff) over w as until, row_number() over w as place from m window w as (partition by scope, key order by eff, revision)"""

ORACLES["policy_resolutions"] = "with " + CLAIMS + """, p as (select topic, project, min(id) as id from claims where status = 'active' group by all),
    o as (select a.id as claim_a, b.id as claim_b from p a join p b on a.topic = b.topic and a.id < b.id where (a.id + b.id) % 4 <> 0),
    w as (select id, {'p': pinned, 'x': floor(confidence * 3) / 3, 'y': updated_at} as w from claims where status = 'active' and id % 13 <> 6)
    select claim_a, claim_b, case when a.w is not null and (b.w is null or a.w > b.w) then claim_a when b.w is not null and (a.w is null or b.w > a.w) then claim_b end as kept,
        case when a.w is not null and b.w is not null and a.w = b.w then 'open' else 'resolved' end as status from o left join w a on a.id = claim_a left join w b on b.id = claim_b"""
_CODE = """m as (select doc_id as claim_id, source as repository_id, lang || '/f' || (doc_id % 8) as file_path, 's' || (doc_id % 40) as symbol_id, 'r' || (doc_id % 3) as symbol_revision, md5('c' || (doc_id % 6)) as content_hash from documents),
    s as (select repository_id, symbol_id, max(content_hash) as now from m where cast(substr(symbol_id, 2) as integer) % 5 <> 0 group by all),
    u as (select 'src' || (o_custkey % 20) as repository_id, o_orderkey % 700 as patch_id, case o_orderstatus when 'F' then 'applied' when 'O' then 'rolled_back' else 'pending' end as outcome, md5('c' || (o_orderkey % 6)) as old, md5('c' || ((o_orderkey + 1) % 6)) as new, o_orderkey as o from orders),
    r as (select * from u qualify row_number() over (partition by repository_id, patch_id order by o desc) = 1)"""
ORACLES["repository_contexts"] = "with " + CLAIMS + ", " + _CODE + """, c as (select m.*, case when now is null then 'orphaned' when now = content_hash then 'current' else 'stale' end as standing from m join claims on claim_id = id and status = 'active' left join s using (repository_id, symbol_id)),
    k as (select repository_id, count(*) as claims, count(*) filter (standing = 'current') as current, count(*) filter (standing = 'stale') as stale, count(*) filter (standing = 'orphaned') as orphaned, count(distinct file_path) as files, count(distinct symbol_id) as symbols from c group by 1),
    p as (select repository_id, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'rolled_back') as rolled_back, count(*) filter (outcome = 'pending') as pending from r group by 1)
    select repository_id, coalesce(claims, 0) as claims, coalesce(current, 0) as current, coalesce(stale, 0) as stale, coalesce(orphaned, 0) as orphaned, coalesce(files, 0) as files, coalesce(symbols, 0) as symbols,
        coalesce(applied, 0) as applied, coalesce(failed, 0) as failed, coalesce(rolled_back, 0) as rolled_back, coalesce(pending, 0) as pending from k full join p using (repository_id)"""
ORACLES["patched_claims"] = "with " + _CODE + """, d as (select repository_id, patch_id, o, case outcome when 'applied' then old else new end as b, case outcome when 'applied' then new else old end as a from r where outcome in ('applied', 'rolled_back')),
    h as (select d.repository_id, patch_id, content_hash, a, b from d join m on m.repository_id = d.repository_id and m.symbol_id = 's' || (o % 40) where o % 3 <> 0
        union all select d.repository_id, patch_id, content_hash, a, b from d join m on m.repository_id = d.repository_id and m.file_path in ('en/f' || (o % 8), 'de/f' || (o % 5)) where o % 3 = 0)
    select repository_id, case when content_hash = b then 'invalidated' when content_hash = a then 'confirmed' else 'unclear' end as effect, count(*) as claims, count(distinct patch_id) as patches from h group by all"""
ORACLES["symbol_revisions"] = "with " + _CODE + """, e as (select repository_id, symbol_id, symbol_revision, count(*) as claims, min(content_hash) as h from m group by all)
    select repository_id, symbol_id, symbol_revision, claims, row_number() over w as place, lag(symbol_revision) over w as before, lag(h) over w is distinct from h as changed from e window w as (partition by repository_id, symbol_id order by symbol_revision)"""
