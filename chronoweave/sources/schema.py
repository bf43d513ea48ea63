"""Explicit schemas of the knowledge tables; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

_PERIOD = "valid_from timestamp_ntz, valid_to timestamp_ntz"
_FACT = _PERIOD + ", ingested_at timestamp_ntz, confidence double, evidence_refs array<string>"

#: Columns of each table. Open ends are null; vectors, references and read sets are arrays.
COLUMNS = {
    "repositories": "id string, path string, name string, ingested_at timestamp_ntz",
    "adr_documents": "id string, repo_id string, adr_id string, title string, status string, date string, context string, decision string, consequences string, supersedes array<string>, superseded_by string, "
    "source_uri string, effective_from timestamp_ntz, effective_to timestamp_ntz, source_time timestamp_ntz, " + _PERIOD + ", ingested_at timestamp_ntz, confidence double",
    "decisions": "id string, title string, adr_id string, episode_id string, text string, source_uri string, source_time timestamp_ntz, embedding array<float>, " + _FACT,
    "constraints": "id string, decision_id string, text string, source_uri string, embedding array<float>, " + _FACT,
    "files": "id string, repo_id string, path string, content_hash string, ingested_at timestamp_ntz, " + _PERIOD,
    "symbols": "id string, file_id string, name string, kind string, line int, end_line int, signature string, return_type string, visibility string, is_async boolean, complexity int, decorators array<string>, "
    "embedding array<float>, ingested_at timestamp_ntz, " + _PERIOD,
    "symbol_edges": "id string, repo_id string, from_id string, to_id string, to_name string, edge_type string, confidence double, resolution string, " + _PERIOD,
    "file_imports": "id string, file_id string, name string, spec string, target_file_id string, target_symbol_id string, " + _PERIOD,
    "routes": "id string, repo_id string, method string, path string, framework string, handler_id string, file_path string, line int, confidence double, " + _PERIOD,
    "communities": "id string, repo_id string, label string, size int, " + _PERIOD,
    "community_members": "community_id string, symbol_id string",
    "commits": "id string, repo_id string, sha string, author string, message string, embedding array<float>, source_time timestamp_ntz, ingested_at timestamp_ntz, confidence double, evidence_refs array<string>",
    "commit_files": "id string, commit_id string, file_path string, ingested_at timestamp_ntz",
    "pull_requests": "id string, repo_id string, pr_ref string, title string, body string, author string, state string, enriched boolean, embedding array<float>, source_time timestamp_ntz, ingested_at timestamp_ntz, confidence double",
    "episodes": "id string, repo_id string, source string, source_uri string, content string, embedding array<float>, occurred_at timestamp_ntz, ingested_at timestamp_ntz, confidence double",
    "decision_code_links": "id string, decision_id string, file_path string, symbol string, link_type string, link_source string, " + _FACT,
    "decision_git_links": "id string, decision_id string, ref_type string, ref_id string, link_source string, " + _FACT,
    "supersession_edges": "id string, superseder_id string, superseded_id string, valid_from timestamp_ntz, ingested_at timestamp_ntz, confidence double",
    "temporal_edges": "id string, edge_type string, source_id string, source_type string, target_id string, target_type string, " + _FACT,
    "entity_nodes": "id string, repo_id string, canonical_name string, entity_type string, embedding array<float>, " + _FACT,
    "claims": "id string, repo_id string, kind string, subject_type string, subject_id string, text string, polarity string, evidence_grade string, read_set array<struct<kind:string,uri:string,subpath:string>>, "
    + _PERIOD + ", ingested_at timestamp_ntz, confidence double",
    "evidence_anchors": "id string, repo_id string, claim_id string, source_kind string, source_uri string, subpath string, anchored_text string, content_hash string, start_line int, end_line int, ingested_at timestamp_ntz",
    "evidence_verifications": "id string, anchor_id string, checked_at timestamp_ntz, commit_sha string, edit_class string, freshness string, relocated boolean, similarity double",
    "index_lanes": "repo_id string, lane string, indexed_commit string, status string, updated_at timestamp_ntz, detail string",
    "freshness_manifests": "id string, repo_id string, tool string, view_hash string, repo_commit string, payload string, evaluated_at timestamp_ntz",
}
#: Tables whose rows may carry a vector, and the text it is made from.
EMBEDDED = {"decisions": "text", "constraints": "text", "episodes": "content", "commits": "message", "pull_requests": "title", "symbols": "name", "entity_nodes": "canonical_name"}


def fields(name: str) -> list[tuple[str, str]]:
    """(column, type) of a table, without a session."""
    return [tuple(c.split(" ", 1)) for c in re.split(r", (?=\w+ )", COLUMNS[name])]


def schema(name: str) -> StructType:
    return StructType.fromDDL(COLUMNS[name])
