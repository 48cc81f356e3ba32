"""Operations by name, for callers that dispatch on names: ``call("decay_scan", claims, now)``."""

from __future__ import annotations

from collections.abc import Callable

from tessera import access
from tessera.functions import spreadsheet, statements, text
from tessera.operators import codeclaims, erasure, fusion, graph, index, journal, ledger, lexical, lifecycle, migration, observe, recall, search, vector
from tessera.sources import bundles, connectors, documents
from tessera.streaming import identity, inbox

#: Name to function. Mutating operations are appends to a log whose present rows are ``lifecycle.latest_state``.
OPERATIONS: dict[str, Callable] = {
    "query": lexical.bm25, "query_two_pass": lexical.two_pass, "query_fallback": lexical.literal_fallback, "global_search": fusion.reciprocal_rank_fusion, "query_episodes": recall.turn_pairs,
    "query_mode": recall.query_mode, "recall": recall.unified, "recall_plan": recall.expanded, "recall_intent": recall.intent, "pack_context": fusion.char_budget, "explain_recall": fusion.compare_lists,
    "compare_search": fusion.compare_lists, "debug_search": fusion.compare_lists, "rerank": fusion.rerank_fusion, "diversify": fusion.capped_per_group, "collapse": recall.collapse, "coverage": recall.coverage,
    "query_secrets": lifecycle.registry_search, "memory_diff": statements.with_verdict, "extract": statements.extracted, "graph_extract_claim": statements.grounded_relation,
    "graph_query": graph.entity_query, "code_graph_neighbors": graph.neighbours, "document_neighbors": graph.neighbours, "code_line_context": graph.line_context, "document_unit_context": graph.unit_context,
    "code_graph_status": graph.totals, "code_graph_ingest": graph.applied_snapshot, "invalidate_revision": graph.invalidated, "symbol_history": codeclaims.symbol_revisions, "code_claim_query": codeclaims.code_claims, "repository_context": codeclaims.repository_context, "patch_outcome_add": codeclaims.recorded_outcomes, "patched_claims": codeclaims.patched, "claim_history": observe.history,
    "document_ingest": documents.units_of, "document_chunks": documents.chunked, "document_scan": documents.scan, "document_status": documents.scan_actions, "source_record_upsert": documents.latest_records,
    "source_file_sync": connectors.observed, "source_list": connectors.source_list, "source_delete": connectors.source_deleted, "document_delete": connectors.source_deleted, "reindex": connectors.reindexed,
    "embed_pending": vector.pending, "semantic_search": vector.top_k, "embed": vector.hashed_ngrams, "near_duplicates": vector.simhash_neighbours,
    "decay_scan": lifecycle.decay_scan, "decay_stats": lifecycle.decay_stats, "decay_archive": lifecycle.decay_archive, "gc": lifecycle.collectable, "supersede": lifecycle.superseded,
    "contradict": lifecycle.contradictions, "resolve_contradiction": lifecycle.resolved, "resolve_by_policy": lifecycle.resolved_by_policy, "mark_used": lifecycle.feedback, "normalize_topics": lifecycle.topics, "summarize_topic": lifecycle.topics,
    "recent_changes": lifecycle.recent, "audit_log": lifecycle.recent, "mutation_log": lifecycle.recent, "undo_last": lifecycle.undone, "transaction": journal.state, "why_believe": journal.lineage, "rebuild_from_journal": lifecycle.latest_state, "federate_merge": lifecycle.merged,
    "health": lifecycle.health, "evaluate_retrieval": lifecycle.evaluated, "retrieval_metrics": lifecycle.retrieval_metrics, "shared_block_list": lifecycle.block_events,
    "secrecy_report": text.secret_findings, "immune_scan": text.has_secret, "context_sanitize": text.sanitized, "write_firewall": text.redacted, "is_social_close": text.is_social_close, "lint_claim": access.accepted,
    "backup": bundles.backup, "restore": bundles.restore, "scoped_backup": bundles.backup, "restore_scoped_backup": bundles.restore, "export_bundle": bundles.export_bundle, "import_bundle": bundles.import_bundle,
    "query_events": search.event_query, "query_observations": search.observation_query, "query_episodes_hybrid": search.episode_query, "query_code": search.code_query, "query_documents": search.document_query,
    "recent_common_term": search.common_term_window, "prefetch_context": search.prefetched, "build_index": index.build, "dashboard": lifecycle.dashboard, "health_findings": lifecycle.health_findings, "record_recall": lifecycle.recall_recorded,
    "add_entity": graph.added_entities, "add_relation": graph.added_relations, "label_agreement": vector.label_agreement, "nearest": vector.nearest_by_cosine, "evaluate_formulas": spreadsheet.evaluated_rows,
    "sanitize_json": text.json_sanitized, "registry_lookup": lifecycle.registry_lookup, "erasure_replay": connectors.erased, "publish_index": connectors.publish, "published_index": connectors.published,
    "job_health": ledger.job_health, "online_metrics": ledger.latency_snapshot, "consolidate": observe.consolidated,
    "erase": erasure.markers, "erased_hits": erasure.hits, "unerased": erasure.without_contained, "event_ids": identity.run_identified, "ingest_inbox": inbox.take_in, "compact_inbox": inbox.compact,
    "reconcile": migration.reconcile, "switch_version": migration.switch, "current_version": migration.current, "benchmark_report": lifecycle.benchmark_report, "repository_binding": access.bound_to,
}


def call(name: str, *args, **kwargs):
    """The result of an operation; an unknown name is an error that lists the known ones."""
    if name not in OPERATIONS:
        raise KeyError(f"{name} is none of {', '.join(sorted(OPERATIONS))}")
    return OPERATIONS[name](*args, **kwargs)
