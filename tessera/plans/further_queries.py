"""Queries of single operators: searches, windows, graphs, telemetry, spreadsheets, records and text scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import access
from tessera.functions import patterns as P
from tessera.functions import spreadsheet, statements
from tessera.functions import text as T
from tessera.operators import fusion, graph, lifecycle, migration, observe, recall, search, vector
from tessera.operators import ledger as L
from tessera.plans.retrieval_queries import _RANKS, TERMS, _asked_sql, _bm25_sql, _claim_ranks, questions
from tessera.plans.staging import shared_dir
from tessera.plans.tables import CLAIMS, NOW, claims, table, text_index, texts
from tessera.sources import connectors
from tessera.sources import documents as D


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn", "role"))


def observation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turns as observations; every fifth conversation's stored version is another."""
    d = F.col("conv_id")
    own = _turns(spark, sf_dir).select(F.col("key").alias("observation_id"), F.col("text").alias("content"), (d % 3).alias("version"), F.md5("text").alias("digest"), d.alias("last_seen"), F.when(d % 7 == 0, "superseded").otherwise("active").alias("status"))
    stored = own.select("observation_id", "version", F.when(F.col("last_seen") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return search.observation_query(own, stored, "of from", 20).select("observation_id", "pass_no", "position")


def common_term_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("content"))
    return search.common_term_window(own, "click", "event_id", 15, frequent=50, window=2_000, most=300).select("event_id")


def reranked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best claims and events; a reranker turns the order of most of the claims."""
    best = fusion.ranked(_claim_ranks(spark, sf_dir), [F.desc("score"), F.col("id")]).where("rank <= 40")
    fused = best.select(F.col("rank").alias("position"), F.when(F.col("id") % 3 == 0, "event").otherwise("claim").alias("kind"), "id")
    return fusion.keep_rerank_order(fused, fused.where("id % 4 <> 1").select("id", (-F.col("id")).alias("rank"))).select("position", "kind", "id")


def recall_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = text_index(spark, sf_dir, "documents").best([TERMS], 20)
    items = hits.select(F.when(F.col("id") % 2 == 0, "claim").otherwise("event").alias("kind"), F.col("id").cast("string").alias("id"), F.round("score", 6).alias("rrf"), F.col("rank").alias("position"))
    return lifecycle.recall_recorded(items, claims(spark, sf_dir).where("id % 10 <> 4"), NOW).select("recall_event_id", "claim_id", "position", "injected")


def prefetched_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that the best events give, as it would be handed on."""
    hits = text_index(spark, sf_dir, "events").best([["error", "k", "17"]], 20)
    rows, key, text = texts(spark, sf_dir, "events")
    own = search.fetched(rows, key, hits.withColumnRenamed("id", key), ["score"])
    own = own.select(F.concat(F.lit("v"), key).alias("id"), F.lit("event").alias("kind"), F.col(text).alias("text"), F.round("score", 5).alias("score"))
    return search.prefetched(own, "## Context", 6, 24_000)


def added_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer")
    known = own.where("c_custkey % 3 <> 0").select(F.concat(F.lit("e"), F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.array(F.lit("client")).alias("aliases"), F.lit(0).alias("updated_at"))
    new = own.where("c_custkey % 2 = 0").select(F.concat(F.lit(" "), F.upper("c_name")).alias("name"), F.array("c_mktsegment").alias("aliases"))
    out = graph.added_entities(known, new, NOW)
    return out.groupBy(F.col("id").startswith("ent_").alias("appended"), F.array_join("aliases", ",").alias("aliases"), (F.col("updated_at") == NOW).alias("touched")).agg(F.count("*").alias("entities"))


def added_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir).select("id", "status", F.concat(F.lit("o"), F.col("id") % 4).alias("owner"), F.when(F.col("id") % 2 == 0, "chat").otherwise("project").alias("visibility"))
    made = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, "contains").otherwise("likes").alias("predicate"), F.concat(F.lit("o"), F.col("o_orderkey") % 50).alias("object"), (F.col("o_orderkey") % 300).alias("source_claim_id")
    )
    known = made.where("source_claim_id % 5 = 0").distinct().withColumns({"owner": F.lit("o0"), "visibility": F.lit("chat"), "valid_from": F.lit(1).cast("long"), "valid_to": F.lit(None).cast("long")})
    known = known.withColumn("predicate", graph.known_predicate(F.col("predicate")))
    out = graph.added_relations(known, made, own, NOW)
    return out.groupBy("owner", "visibility", "predicate", (F.col("valid_from") == NOW).alias("added")).agg(F.count("*").alias("relations"))


def store_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.dashboard(claims(spark, sf_dir))
    return out.select("topic", "status", "claims", F.round("confidence", 6).alias("confidence"), F.round("salience", 6).alias("salience"), "newest")


def observation_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("owner"), F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("last_seen"), F.col("o_custkey").alias("updated_at"), F.col("o_orderpriority").alias("content"))
    return L.retained(own, ["owner"], ["last_seen", "updated_at", "id"], ["content"], 150, 1_200).select("owner", "id")


def formula_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each part: two numbers, and formulas over them."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.create_map(
        F.lit("A1"), F.col("p_size").cast("string"), F.lit("A2"), (F.col("p_partkey") % 7).cast("string"), F.lit("A3"), F.lit("=SUM(A1:A2)*2"), F.lit("A4"), F.lit("=-A1^2+ABS(A2-10)"), F.lit("A5"), F.lit("=A1/A2"), F.lit("A6"), F.lit("=MAX(A1:A3)-50%"),
    ).alias("cells"))
    return spreadsheet.evaluated_rows(own, ["p_partkey"]).select("p_partkey", "cell", F.round(F.col("value").cast("double"), 6).alias("value"))


def formula_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("B1"), F.lit("=A1+$A$2"), F.lit("B2"), F.concat(F.lit("=SUM(A1:A"), (F.col("p_partkey") % 9 + 2).cast("string"), F.lit(")"))).alias("cells"))
    edges = spreadsheet.evaluated_rows(own, ["p_partkey"]).select("p_partkey", F.col("cell").alias("a"), F.explode("refers").alias("b"))
    return edges.groupBy("a", "b").agg(F.count("*").alias("sheets"))


def sanitized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows with a secret header, and a secret label beside a value."""
    own = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_name", F.concat(F.lit("v"), "c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "token").otherwise("note"), F.col("c_mktsegment")).alias("cells"))
    headers = F.array(F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, "Password").otherwise("value"), F.lit("kind"), F.lit("what"))
    return own.select("c_custkey", F.array_join(T.sanitized_cells(F.col("cells"), headers), "|").alias("cells"))


def sanitized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with a token inside some and one level more than is shown."""
    raw = F.concat(F.lit('{"id":'), "event_id", F.lit(',"note":"'), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("AKIA"), F.lpad("event_id", 16, "X"))).otherwise(F.col("event_type")), F.lit('","deep":[[[1]],2,3,4]}'))
    return table(spark, sf_dir, "events").select("event_id", T.json_sanitized(raw, depth=3, items=3).alias("clean"))


def comparable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 6 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vec"), F.size("embedding").alias("dims"), F.when(F.col("vec_id") % 4 == 0, "m1").otherwise("m2").alias("manifest_hash"))
    dims = own.agg(F.max("dims")).first()[0]
    return vector.same_manifest(own, dims, "m2").select("vec_id")


def filtered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows by cosine among those whose payload fits."""
    rows = table(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 11").select("embedding").first()[0]
    return vector.top_k(rows, "vec_id", "embedding", query, 15, (F.col("label") % 2 == 0) & (F.col("vec_id") > 20)).select("vec_id", F.round("score", 6).alias("score"))


def erasure_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    intents = rows.where("doc_id % 9 = 0").select(F.col("doc_id").alias("sequence"), "digest")
    left, new = connectors.erased(rows, intents, intents.where("sequence % 2 = 0").select("sequence"))
    return left.select("doc_id", F.lit("row").alias("what")).unionByName(new.select(F.col("sequence").alias("doc_id"), F.lit("intent").alias("what")))


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_partkey").alias("key"), F.array("p_type", "p_brand").alias("aliases"))
    return lifecycle.registry_lookup(own, "brand#13").select("key")


def still_disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("mark"))
    after = before.where("doc_id % 6 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "new").otherwise(F.col("mark")).alias("mark"))
    return access.unchanged(before, after, "doc_id", "mark").select("doc_id")


def foreign_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("id")
    own = claims(spark, sf_dir).withColumns({"visibility": F.when(d % 2 == 0, "global").otherwise("chat"), "risk": F.when(d % 6 == 0, "secret"), "is_artifact": d % 14 == 0, "_raw": F.lit("x")})
    return access.visible_columns(own.where(access.foreign_eligible()).select("id", "project", "_raw"))


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines below a path of the two repositories that a reader is bound to, within a range."""
    own = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("repository_id"), F.col("o_orderkey").alias("line"),
        F.concat(F.when(F.col("o_custkey") % 3 == 0, "srcs").otherwise("src"), F.lit("/f"), F.col("o_custkey") % 11).alias("path"),
    )
    return own.where(access.bound_to(["r3", "r4"], "src", 100, 900)).select("repository_id", "path", "line")


def grounded_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements beside their sources: one with all its words, one with a number that isn't there, one turned round."""
    d = F.col("event_id")
    source = F.concat(F.lit("the server number "), d % 7, F.lit(" runs on port "), d % 5, F.lit(" every day"))
    claim = F.when(d % 3 == 0, F.concat(F.lit("server number "), d % 7, F.lit(" runs on port "), d % 5)).when(d % 3 == 1, F.concat(F.lit("server runs on port "), d % 5 + 100)).otherwise(F.concat(F.lit("server number "), d % 7, F.lit(" never runs on port "), d % 5))
    own = table(spark, sf_dir, "events").select("event_id", source.alias("old"), claim.alias("new"))
    return statements.with_verdict(own).select("event_id", "supported")


def grounded_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("c_custkey")
    text = F.when(d % 3 == 0, F.concat("c_name", F.lit(" works on the "), "c_mktsegment", F.lit(" project."))).when(d % 3 == 1, F.concat("c_name", F.lit(" never works on the "), "c_mktsegment", F.lit(" project."))).otherwise(F.concat("c_mktsegment", F.lit(" is here. "), "c_name", F.lit(" works on it.")))
    own = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), "c_name", "c_mktsegment")
    check = F.udf(lambda t, a, b: statements.grounded_relation(t, a, "works_on", b), "boolean", useArrow=True)
    return own.select("c_custkey", check("text", "c_name", "c_mktsegment").alias("grounded"))


def distinct_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a session: a better one, its copy, one that it contains, and one of its own."""
    d = F.col("event_id")
    text = F.when(d % 4 == 0, "the user prefers green tea in the morning").when(d % 4 == 1, "user prefers green tea in the morning").when(d % 4 == 2, "the user prefers green tea in the morning").otherwise(F.concat(F.lit("note number "), d))
    own = table(spark, sf_dir, "events").select("user_id", text.alias("text"), (100 - d % 4).alias("score"))
    return statements.deduplicated(own.distinct(), "user_id", "text", "score").groupBy("user_id").agg(F.count("*").alias("statements"))


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, one file a user."""
    line = F.concat(F.lit('{"n":'), "event_id", F.lit("}"))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("raw")).withColumn("name", F.lit("a.jsonl"))
    return D.units_of(own, ["user_id"], "name", "raw").select("user_id", "kind", "text")


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a secret column for each nation."""
    raw = F.concat(F.lit("name,token,region\n"), "n_name", F.lit(",abc,"), F.col("n_regionkey").cast("string"), F.lit('\n"a, b",,'), F.col("n_nationkey").cast("string"))
    own = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("a.csv").alias("name"), raw.alias("raw"))
    return D.units_of(own, ["n_nationkey"], "name", "raw").select("n_nationkey", "kind", "text")


def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("source_key"), (F.col("s_suppkey") % 4 != 0).alias("active"))
    gone = own.orderBy("s_name").where("active").first()["source_key"]
    return connectors.source_list(connectors.source_deleted(own, gone), 50).select("source_key")


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("digest"), "doc_id")
    known = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return connectors.observed(docs.where("doc_id % 4 <> 0"), known).groupBy("status").agg(F.count("*").alias("files"))


def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    index = docs.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    todo, drop = connectors.reindexed(docs, index, "doc_id", "digest")
    return todo.select("doc_id", F.lit("index").alias("what")).unionByName(drop.select("doc_id", F.lit("drop").alias("what")))


def reconciled_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that lacks documents, has old ones and some too many is reconciled by buckets and switched to: its buckets before and after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang")
    root = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    old = docs.where("doc_id % 97 <> 5").withColumn("digest", F.when(F.col("doc_id") % 89 == 3, "old").otherwise(F.col("digest")))
    extra = docs.where("doc_id % 101 = 7").withColumn("doc_id", -F.col("doc_id") - 1)
    migration.reconcile(old.unionByName(extra), root, "next", "doc_id", "digest")
    changed = migration.reconcile(docs, root, "next", "doc_id", "digest")
    migration.switch(spark, root, "next")
    rows = migration.stored(spark, root, migration.current(spark, root), docs.schema)
    return rows.groupBy("bucket", "lang").agg(F.count("*").alias("rows")).withColumn("copied", F.col("bucket").isin(changed))


def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.fingerprint("n_regionkey", "n_name").alias("mark"))


def attributed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("c_custkey")
    kind = F.when(d % 4 == 0, "preference").when(d % 4 == 1, "decision").when(d % 4 == 2, "fact").otherwise("remember")
    said = T.attributed(kind, F.col("c_name"), d % 2 == 0)
    evidence = F.when(d % 5 == 0, "").when(d % 5 == 1, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.rendered_claim(said, evidence).alias("claim"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.contains_phrase(F.col("text"), "Of the")).select("doc_id")


def event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("event_id"), F.unix_timestamp("ts")
    raw = F.when(d % 4 == 0, n.cast("string")).when(d % 4 == 1, (n * 1000).cast("string")).when(d % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd '(Mon)' HH:mm"))
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", F.unix_timestamp(T.event_moment(raw)).alias("moment"))


def chosen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text beside native text: longer and clean, too short, or full of broken characters."""
    d = F.col("p_partkey")
    ocr = F.when(d % 3 == 0, F.concat("p_name", F.lit(" and some more of it"))).when(d % 3 == 1, "short").otherwise(F.concat("p_name", F.repeat(F.lit("�"), 30)))
    return table(spark, sf_dir, "part").select("p_partkey", T.choose_ocr(F.col("p_name"), ocr).alias("text"))


def social_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("thanks!", "ok", "what now?", "Sounds good...", "see you", "good night, friend"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(said.alias("said")).agg(F.max(T.is_social_close(said)).alias("closes"), F.count("*").alias("turns"))


def answer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every user turn, all words of it: whether the replies that are found are near enough to answer from."""
    asked = questions(spark, sf_dir)
    found = text_index(spark, sf_dir, "replies").answers(asked.select("query_id", "query"), 5, most_terms=None)
    return recall.answer_policy(found.where("score >= 14"), asked)


def secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.has_secret(F.col("text")).alias("secret"))


def observation_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry of observations: the earliest of their events', a year from now at most."""
    d = F.col("event_id")
    own = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("owner"), "event_id", F.col("event_type").alias("topic"), F.concat(F.lit("user "), F.col("user_id") % 50, F.lit(" did it")).alias("content"), F.lit("").alias("turn_id"),
        F.unix_timestamp("ts").alias("occurred_at"), F.unix_timestamp("ts").alias("observed_at"), F.unix_timestamp("ts").alias("created_at"), F.when(d % 3 == 0, F.lit(NOW) + d % 1000 * 86_400).otherwise(0).alias("expires_at"),
    )
    return observe.consolidated(own, ["owner"], NOW, True).select("owner", "topic", "expires_at", "support")


QUERIES = {f.__name__: f for f in (
    observation_search, common_term_window, reranked_claims, recall_telemetry, prefetched_context, added_entities, added_relations, store_dashboard, observation_retention, formula_values, formula_edges,
    sanitized_rows, sanitized_json, comparable_vectors, filtered_vectors, erasure_replay, registry_entries, still_disclosed, foreign_claims, repository_files, grounded_statements, grounded_relations,
    distinct_statements, line_records, table_records, source_registry, file_states, reindex_plan, reconciled_buckets, row_fingerprints, attributed_statements, phrase_hits, event_moments, chosen_texts, social_closes,
    answer_policies, secret_flags, observation_expiry,
)}

_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))))"


def _re2(pattern: str) -> str:
    """A pattern as DuckDB takes it: look-behinds and look-aheads for single characters become those characters or the text's ends."""
    import re

    out = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    out = re.sub(r"\(\?<!(\[[^\]]*\])\)", lambda m: "(?:^|[^" + m[1][1:-1] + "])", out)
    out = re.sub(r"\(\?!(\[[^\]]*\])\)", lambda m: "(?:$|[^" + m[1][1:-1] + "])", out)
    out = out.replace(r"(?:([\"'])[^\"']{4,}\2|", r"(?:\"[^\"']{4,}\"|'[^\"']{4,}'|")
    return out.replace("'", "''")


_SECRET = " or ".join(f"regexp_matches(coalesce(text, ''), '{_re2(p)}')" for p in (P.PRIVATE_KEY, P.URL_CREDENTIALS, P.SECRET_ASSIGNED, *P.PROVIDER_SECRETS.values(), r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48}"))

ORACLES: dict[str, str] = {
    "observation_search": "with t as (select conv_id || '-' || turn || '-' || role as k, text from conversations), " + _bm25_sql("s", "t", "k", "text", ["of", "from"]) + """,
        v as (select s.*, c.conv_id as seen from s join conversations c on s.id = c.conv_id || '-' || c.turn || '-' || c.role where matched > 0 and c.conv_id % 7 <> 0),
        b as (select * from (select *, 1 as pass_no from v where matched = 2 order by score desc, seen desc, id limit 160) union all select * from (select *, 2 as pass_no from v order by score desc, seen desc, id limit 160)),
        o as (select * from b qualify row_number() over (partition by id order by pass_no) = 1), p as (select *, row_number() over (order by pass_no, score desc, seen desc, id) as position from o)
        select id as observation_id, pass_no, position from p where position <= 160 and seen % 5 <> 0 order by position limit 20""",
    "common_term_window": """with w as (select * from events where event_id >= greatest(1, (select max(event_id) from events) - 2000) order by event_id desc limit 300)
        select event_id from w where event_type = 'click' order by event_id desc limit 15""",
    "reranked_claims": "with " + _RANKS + """, f as (select rank as position, case when id % 3 = 0 then 'event' else 'claim' end as kind, id from best where rank <= 40),
        c as (select position, id, row_number() over (order by case when id % 4 <> 1 then -id end nulls last, position) as slot from f where kind = 'claim'), s as (select position, row_number() over (order by position) as slot from f where kind = 'claim')
        select cast(position as integer) as position, kind, id from f where kind <> 'claim' union all select cast(s.position as integer), 'claim', c.id from c join s using (slot)""",
    "recall_telemetry": "with " + _bm25_sql("s", "documents", "doc_id", "text", TERMS) + f""", h as (select id, row_number() over (order by score desc, id) as position from s where matched > 0 qualify position <= 20)
        select 'recall_' || substr(sha256('unified_recall' || chr(0) || id || chr(0) || position || chr(0) || '{NOW}'), 1, 24) as recall_event_id, id::varchar as claim_id, position, true as injected from h where id % 2 = 0 and id % 10 <> 4""",
    "prefetched_context": "with t as (select event_id, event_type || ' ' || props as text from events), " + _bm25_sql("s", "t", "event_id", "text", ["error", "k", "17"]) + """,
        h as (select id, text, round(score, 5) as score from s where matched > 0 order by s.score desc, id limit 20), b as (select * from h order by score desc, 'v' || id limit 6)
        select '## Context' || chr(10) || string_agg('- [event] v' || id || ' score=' || printf('%.5f', score) || chr(10) || '  ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 900), chr(10) order by score desc, 'v' || id) as context from b""",
    "added_entities": """with k as (select c_custkey as c from customer where c_custkey % 3 <> 0), n as (select c_custkey as c, c_mktsegment as a from customer where c_custkey % 2 = 0)
        select k.c is null as appended, array_to_string(list_sort(list_distinct(case when k.c is null then [a] when a is null then ['client'] else ['client', a] end)), ',') as aliases, n.c is not null as touched, count(*) as entities from k full join n on k.c = n.c group by all""",
    "added_relations": """with m as (select 'c' || o_custkey as s, case when o_orderkey % 2 = 0 then 'contains' else 'references' end as predicate, 'o' || (o_orderkey % 50) as o, o_orderkey % 300 as c from orders), k as (select distinct * from m where c % 5 = 0),
        a as (select distinct m.s, m.predicate, m.o, m.c from m join documents d on d.doc_id = m.c where d.doc_id % 11 <> 0 and m.c % 5 <> 0)
        select 'o0' as owner, 'chat' as visibility, predicate, false as added, count(*) as relations from k group by all
        union all select 'o' || (c % 4), case when c % 2 = 0 then 'chat' else 'project' end, predicate, true, count(*) from a group by all""",
    "store_dashboard": "with " + CLAIMS + " select topic, status, count(*) as claims, round(avg(confidence), 6) as confidence, round(avg(salience), 6) as salience, max(updated_at) as newest from claims group by all",
    "observation_retention": """with r as (select o_custkey % 7 as owner, o_orderkey as id, row_number() over w as n, sum(octet_length(encode(o_orderpriority))) over w as b from orders
        window w as (partition by o_custkey % 7 order by o_orderdate desc, o_custkey desc, o_orderkey desc)) select owner, id from r where n <= 150 and b <= 1200""",
    "formula_values": """with p as (select p_partkey, p_size::double as a, (p_partkey % 7)::double as b from part)
        select p_partkey, 'A3' as cell, round((a + b) * 2, 6) as value from p union all select p_partkey, 'A4', round(a * a + abs(b - 10), 6) from p
        union all select p_partkey, 'A5', case when b = 0 then null else round(a / b, 6) end from p union all select p_partkey, 'A6', round(greatest(a, b, (a + b) * 2) - 0.5, 6) from p""",
    "formula_edges": """select 'B1' as a, 'A1' as b, count(*) as sheets from part union all select 'B1', 'A2', count(*) from part union all select 'B2', 'A1:A' || (p_partkey % 9 + 2), count(*) from part group by all""",
    "sanitized_rows": """select c_custkey, concat_ws('|', c_name, case when c_custkey % 3 = 0 then '<REDACTED>' else 'v' || c_custkey end, case when c_custkey % 2 = 0 then 'token' else 'note' end,
        case when c_custkey % 2 = 0 then '<REDACTED>' else c_mktsegment end) as cells from customer""",
    "sanitized_json": """select event_id, '{"id":' || event_id || ',"note":"' || case when event_id % 4 = 0 then '<REDACTED>' else event_type end || '","deep":[["<MAX_DEPTH>"],2,3,"<TRUNCATED:1>"]}' as clean from events""",
    "comparable_vectors": "select vec_id from embeddings where vec_id % 4 <> 0 and vec_id % 6 <> 0 and len(embedding) = (select max(len(embedding)) from embeddings)",
    "filtered_vectors": f"select e.vec_id, round({_COS}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 11) q where e.label % 2 = 0 and e.vec_id > 20 order by {_COS} desc, e.vec_id limit 15",
    "erasure_replay": """with i as (select doc_id, md5(text) as g from documents where doc_id % 9 = 0 and doc_id % 2 <> 0)
        select doc_id, 'row' as what from documents where md5(text) not in (select g from i) union all select doc_id, 'intent' from i""",
    "registry_entries": "select p_brand || '/' || p_partkey as key from part where lower(p_brand) = 'brand#13' or lower(p_type) = 'brand#13'",
    "still_disclosed": "select doc_id from documents where doc_id % 6 <> 0 and doc_id % 4 <> 0",
    "foreign_claims": "select doc_id as id, lang as project from documents where doc_id % 2 = 0 and doc_id % 11 <> 0 and doc_id % 6 <> 0 and doc_id % 14 <> 0",
    "repository_files": "select 'r' || (o_custkey % 5) as repository_id, 'src/f' || (o_custkey % 11) as path, o_orderkey as line from orders where o_custkey % 5 in (3, 4) and o_custkey % 3 <> 0 and o_orderkey between 100 and 900",
    "grounded_statements": "select event_id, event_id % 3 = 0 as supported from events",
    "grounded_relations": "select c_custkey, c_custkey % 3 = 0 as grounded from customer",
    "distinct_statements": """with s as (select distinct user_id, case when event_id % 4 in (0, 2) then 'a' when event_id % 4 = 1 then 'b' else 'n' || event_id end as s from events)
        select user_id, count(*) filter (s like 'n%') + least(1, count(*) filter (s in ('a', 'b'))) as statements from s group by user_id""",
    "line_records": """select user_id, 'record' as kind, '{"n":' || event_id || '}' as text from events""",
    "table_records": """select n_nationkey, 'header' as kind, 'name | token | region' as text from nation union all select n_nationkey, 'row', 'name=' || n_name || ' | token=<REDACTED> | region=' || n_regionkey from nation
        union all select n_nationkey, 'row', 'name=a, b | region=' || n_nationkey from nation""",
    "source_registry": "select s_name as source_key from supplier where s_suppkey % 4 <> 0 and s_name <> (select min(s_name) from supplier where s_suppkey % 4 <> 0) order by s_name limit 50",
    "file_states": """with d as (select doc_id from documents where doc_id % 4 <> 0), k as (select doc_id from documents where doc_id % 5 <> 0)
        select case when k.doc_id is null then 'new' when d.doc_id is null then 'missing' when k.doc_id % 3 = 0 then 'changed' else 'current' end as status, count(*) as files from d full join k on d.doc_id = k.doc_id group by 1""",
    "reindex_plan": "select doc_id, 'index' as what from documents where doc_id % 4 = 0 or doc_id % 3 = 0 union all select doc_id, 'drop' from documents where doc_id % 4 <> 0 and doc_id % 3 = 0",
    "reconciled_buckets": """with c as (select distinct substr(md5(cast(id as varchar)), 1, 2) as b from (select doc_id as id from documents where doc_id % 97 = 5 or doc_id % 89 = 3 union all select -doc_id - 1 from documents where doc_id % 101 = 7))
        select substr(md5(cast(doc_id as varchar)), 1, 2) as bucket, lang, count(*) as rows, substr(md5(cast(doc_id as varchar)), 1, 2) in (select b from c) as copied from documents group by all""",
    "row_fingerprints": """select n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') as mark from nation""",
    "attributed_statements": """with a as (select c_custkey, c_custkey % 4 as k, case when c_custkey % 5 = 0 then '' when c_custkey % 5 = 1 then c_name else c_mktsegment end as e, c_name, c_custkey % 2 = 0 as ru from customer),
        s as (select *, case when ru then ['Пользователь предпочитает: ', 'Пользователь решил: ', 'Пользователь сообщает: ', 'Пользователь просил запомнить: '][k + 1]
            else ['User prefers: ', 'User decided: ', 'User states: ', 'User asked to remember: '][k + 1] end || c_name as s from a)
        select c_custkey, case when e = '' or contains(s, e) then s else s || chr(10) || '> ' || e end as claim from s""",
    "phrase_hits": "select doc_id from documents where regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{M}\\p{N}_])of the(?:$|[^\\p{L}\\p{M}\\p{N}_])')",
    "event_moments": "select event_id, cast(floor(epoch(case when event_id % 4 = 3 then date_trunc('minute', ts) else ts end)) as bigint) as moment from events",
    "chosen_texts": "select p_partkey, case when p_partkey % 3 = 0 then p_name || ' and some more of it' else p_name end as text from part",
    "social_closes": """select ['thanks!', 'ok', 'what now?', 'Sounds good...', 'see you', 'good night, friend'][event_id % 6 + 1] as said, event_id % 6 in (0, 1, 3, 4) as closes, count(*) as turns from events group by all""",
    "answer_policies": "with " + _asked_sql() + """ select q.query_id, count(r.id) as items, case when count(r.id) > 0 then 'answer_with_citations' else 'abstain' end as policy
        from q left join r on r.query_id = q.query_id and r.score >= 14 group by q.query_id""",
    "secret_flags": f"select doc_id, {_SECRET} as secret from documents",
    "observation_expiry": f"""select user_id % 50 as owner, event_type as topic, least(coalesce(min(case when event_id % 3 = 0 then {NOW} + event_id % 1000 * 86400 end), 4611686018427387904), {NOW} + 365 * 86400) as expires_at, count(*) as support from events group by all""",
}
