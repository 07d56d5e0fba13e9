"""All queries of the library but those of the training-data subpackage.

QUERIES read the given tables. FIXTURES are operators on the small literal inputs of their tests, with SQL where it can say them; they are
tested like queries and are not registered.
"""

from tessera.plans import checked, code, diffs, graphs, indexing, more, planning, retrieval, review, scan, searching, sql, streams, upkeep

_MODULES = [retrieval, scan, code, review, planning, upkeep, more, diffs, indexing, streams, graphs, searching, checked]
_LITERAL = """
symbol_extract symbol_search import_extract import_edges graph_stats dependents related_files call_site_counts symbol_usage code_metrics code_health complexity_of nesting_of definition_chunks hierarchical_chunks
glob_exclude noise_gate pr_comment complex_functions secret_report context_hints memory_hits plan_gantt approval_requests plan_find plan_delete
plan_edges plan_analysis plan_mermaid ready_steps plan_progress plan_progress_stateless plan_select_steps affected_files version_range version_rollback plan_list plan_tag_overlap plan_upsert plan_insert approvals_latest
plan_summary plan_coerce step_state_machine circuit_breaker review_file_assignment worker_utilisation
rerank_scores dedupe_overlap overlap_pairs retrieve_pipeline context_bundle_files expand_query query_tokens code_type_case file_summary_case smart_snippet
diff_lines diff_stats change_classification preflight_risk preflight_findings invariants_eval review_context_plan review_context_sections finding_union_dedupe finding_filter_limit failure_policy changed_line_range_join
changed_lines_only sarif_results sarif_rules finding_hashes range_merge adaptive_timeout tsc_output semgrep_output model_findings
security_scan secret_scrub marker_scan markers_by_tag validation_findings validation_by_severity path_parts language_of_extension human_bytes repo_url_parse index_stale plan_names
git_log_parse blame_lines blame_ownership contributors git_status_counts memory_counts memory_entries ignore_match workspace_crawl
""".split()
_ALL = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
_SQL = {k: v for m in [*_MODULES, sql] for k, v in m.ORACLES.items()}
FIXTURES = {k: _ALL[k] for k in _LITERAL}
FIXTURE_ORACLES = {k: _SQL[k] for k in _LITERAL if k in _SQL}
QUERIES = {k: v for k, v in _ALL.items() if k not in FIXTURES}
ORACLES = {k: v for k, v in _SQL.items() if k not in FIXTURES}
