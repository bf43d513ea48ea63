"""A small knowledge graph written out row by row, for the operators whose tables the test data lack.

The same rows are given to Spark as frames and to SQL as constants; the logic on both sides is
written separately.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from chronoweave.plans.store import Store
from chronoweave.sources.schema import fields, schema

T = {i: f"2024-01-{i:02d} 00:00:00" for i in range(1, 29)}


def _rows(columns: str, *rows: tuple) -> list[dict]:
    names = columns.split()
    return [dict(zip(names, r)) for r in rows]


ROWS: dict[str, list[dict]] = {
    "repositories": _rows("id path name ingested_at", ("r1", "/a", "one", T[1]), ("r2", "/b", "two", T[2])),
    "adr_documents": _rows(
        "id repo_id adr_id title status supersedes source_uri effective_from valid_from valid_to ingested_at confidence",
        ("a1", "r1", "ADR-0001", "Ledger order", "Accepted", [], "u1", T[1], T[2], None, T[2], 1.0),
        ("a1o", "r1", "ADR-0001", "Ledger", "Proposed", [], "u1", None, T[1], T[2], T[1], 1.0),
        ("a2", "r1", "ADR-0002", "Cache reads", "Superseded", [], "u2", None, T[3], T[9], T[3], 0.9),
        ("a3", "r1", "ADR-0003", "No cache", "Accepted", ["ADR-0002"], "u3", T[9], T[9], None, T[9], 1.0),
        ("a4", "r2", "ADR-0001", "Queue", "Accepted", [], "u4", None, T[4], None, T[4], 1.0),
        ("a5", "r1", "ADR-0005", "Queue first", "Accepted", [], "u5", None, T[4], None, T[5], 1.0),
        ("a6", "r1", "ADR-0006", "Queue last", "Accepted", [], "u6", None, T[4], None, T[5], 1.0),
    ),
    "episodes": _rows("id repo_id source source_uri content occurred_at ingested_at confidence embedding", ("e1", "r1", "incident", None, "The cache lied", T[6], T[7], 1.0, [0.1, 0.2]), ("e2", "r2", "review", None, "", T[6], T[7], 1.0, None)),
    "decisions": _rows(
        "id title adr_id episode_id text source_uri embedding valid_from valid_to ingested_at confidence",
        ("d1", None, "a1", None, "Ledger entries stay in order. The ledger is the record.", "u1", [1.0, 0.0], T[2], None, T[2], 0.9),
        ("d2", None, "a2", None, "Reads go through the cache", "u2", [0.0, 1.0], T[3], T[9], T[3], 0.8),
        ("d3", None, "a3", None, "Reads skip the cache and ask the ledger", "u3", [0.6, 0.8], T[9], None, T[9], 0.9),
        ("d4", "Cache lied", None, "e1", "Warm the cache first", "e1", None, T[6], None, T[7], 0.5),
        ("d5", None, "a4", None, "Queue every ledger write", "u4", [1.0], T[4], None, T[4], 0.7),
        ("d6", None, "a5", None, "The queue orders writes", "u5", [0.8, 0.6], T[4], None, T[5], 0.6),
        ("d7", None, "a6", None, "Writes leave the queue in order", "u6", None, T[4], None, T[5], 0.6),
    ),
    "constraints": _rows(
        "id decision_id text source_uri valid_from valid_to ingested_at confidence",
        ("c1", "d1", "Ledger entries must stay in partition order", "u1", T[2], None, T[2], 0.9), ("c2", "d3", "Ledger entries must never wait for partition order", "u3", T[9], None, T[9], 0.8),
        ("c3", "d2", "Reads must use the cache", "u2", T[3], T[9], T[3], 0.7), ("c4", "d4", "Nobody shall warm the ledger partition", "e1", T[6], None, T[7], 0.6),
        ("c5", "d6", "Ledger partition order may not change", "u5", T[4], None, T[5], 0.6), ("c6", "d7", "Ledger entries must stay in partition  order", "u6", T[4], None, T[5], 0.6),
    ),
    "files": _rows(
        "id repo_id path content_hash ingested_at valid_from valid_to",
        ("f1", "r1", "src/ledger.py", "h1", T[2], T[2], None), ("f2", "r1", "src/cache.py", None, T[2], T[2], T[8]), ("f3", "r1", "src/queue/api.ts", "h3", T[3], T[3], None),
        ("f4", "r1", "src/queue/index.ts", "h4", T[3], T[3], None), ("f5", "r1", "docs/readme.md", "h5", T[3], T[3], None), ("f6", "r2", "src/ledger.py", "h6", T[3], T[3], None),
    ),
    "symbols": _rows(
        "id file_id name kind line end_line is_async signature ingested_at valid_from valid_to embedding",
        ("s1", "f1", "post", "function", 10, 20, False, "post(entry)", T[2], T[2], None, [0.5]), ("s2", "f1", "Ledger", "class", 5, 60, False, None, T[2], T[2], None, None),
        ("s3", "f2", "get", "function", 1, 9, False, None, T[2], T[2], T[8], None), ("s4", "f3", "push", "function", 3, 8, True, "push(x)", T[3], T[3], None, None),
        ("s5", "f4", "push", "function", 1, 2, False, None, T[3], T[3], None, None), ("s6", "f4", "Queue", "class", 4, 30, False, None, T[3], T[3], None, None),
        ("s7", "f4", "size", "method", 6, 9, False, None, T[3], T[3], None, None), ("s8", "f5", "readme", "document", 1, 40, False, None, T[3], T[3], T[5], None),
    ),
    "symbol_edges": _rows(
        "id repo_id from_id to_id to_name edge_type confidence resolution valid_from valid_to",
        ("x1", "r1", "s4", "s1", "post", "calls", 0.9, "import", T[3], None), ("x2", "r1", "s1", "s3", "get", "calls", 0.6, "unique-name", T[3], None), ("x3", "r1", "s6", "s7", "size", "contains", 1.0, "same-file", T[3], None),
        ("x4", "r1", "s5", None, "flush", "calls", 0.3, "unresolved", T[3], None), ("x5", "r1", "s3", "s1", "post", "calls", 0.6, "unique-name", T[3], None), ("x6", "r1", "s7", "s1", "post", "calls", 0.4, "unique-name", T[3], T[6]),
    ),
    "file_imports": _rows("id file_id name spec target_file_id target_symbol_id valid_from valid_to", ("i1", "f3", "post", "../ledger", "f1", "s1", T[3], None), ("i2", "f3", "Queue", ".", "f4", None, T[3], None), ("i3", "f1", "get", "./cache", "f2", "s3", T[3], None)),
    "routes": _rows("id repo_id method path framework handler_id file_path line confidence valid_from valid_to", ("q1", "r1", "POST", "/push", "express", "s4", "src/queue/api.ts", 12, 0.8, T[3], None), ("q2", "r1", "GET", "/cache", None, None, "src/cache.py", 2, 0.6, T[3], T[8]), ("q3", "r1", "GET", "/ledger", None, None, "src/ledger.py", 2, 0.6, T[3], None)),
    "commits": _rows(
        "id repo_id sha author message source_time ingested_at confidence embedding",
        ("k1", "r1", "aaa", "x", "Apply ADR-1 to the ledger", T[3], T[4], 1.0, [0.3]), ("k2", "r1", "bbb", "y", "Queue first writes, then reads", T[5], T[6], 1.0, None), ("k3", "r1", "ccc", None, None, T[7], T[8], 1.0, None), ("k4", "r2", "aaa", "z", "Start", T[2], T[3], 1.0, None),
    ),
    "commit_files": _rows(
        "id commit_id file_path ingested_at",
        ("m1", "k1", "src/ledger.py", T[4]), ("m2", "k1", "src/cache.py", T[4]), ("m3", "k2", "src/ledger.py", T[4]), ("m4", "k2", "src/cache.py", T[4]), ("m5", "k2", "src/queue/api.ts", T[4]), ("m6", "k3", "src/ledger.py", T[4]), ("m7", "k3", "src/ledger.py", T[4]),
    ),
    "pull_requests": _rows("id repo_id pr_ref title body state enriched source_time ingested_at confidence", ("p1", "r1", "12", "Ledger order", None, None, False, T[4], T[4], 1.0), ("p2", "r1", "x/3", None, "Text", "open", True, T[5], T[5], 1.0)),
    "decision_code_links": _rows(
        "id decision_id file_path symbol link_type link_source confidence valid_from valid_to ingested_at",
        ("l1", "d1", "src/ledger.py", "post", "governs", "adr_text", 0.9, T[2], None, T[2]), ("l2", "d2", "src/cache.py", None, "governs", "adr_text", 0.8, T[3], T[9], T[3]), ("l3", "d3", "src/cache.py", "get", "governs", "adr_text", 0.8, T[9], None, T[9]),
        ("l4", "d3", "src/ledger.py", None, "governs", "manual", 0.7, T[9], None, T[9]), ("l5", "d5", "src/queue/api.ts", None, "governs", "manual", 0.7, T[4], None, T[4]), ("l6", "d6", "docs/readme.md", None, "governs", "manual", 0.7, T[4], None, T[5]),
    ),
    "decision_git_links": _rows(
        "id decision_id ref_type ref_id link_source confidence valid_from valid_to ingested_at",
        ("g1", "d1", "commit", "k1", "git_history", 0.95, T[3], None, T[4]), ("g2", "d6", "commit", "k2", "git_history", 0.6, T[5], None, T[6]), ("g3", "d7", "commit", "k2", "git_history", 0.6, T[5], None, T[6]), ("g4", "d1", "pr", "p1", "git_history", 0.9, T[4], None, T[4]), ("g5", "d7", "commit", "k3", "git_history", 0.6, T[7], None, T[8]),
    ),
    "supersession_edges": _rows("id superseder_id superseded_id valid_from ingested_at confidence", ("v1", "a3", "a2", T[9], T[9], 1.0), ("v2", "a5", "a6", T[5], T[5], 0.9), ("v3", "a6", "a5", T[5], T[5], 0.9)),
    "temporal_edges": _rows(
        "id edge_type source_id source_type target_id target_type valid_from valid_to ingested_at confidence evidence_refs",
        ("t1", "defines", "a1", "adr", "d1", "decision", T[2], None, T[2], 0.9, ["k1"]), ("t2", "imposes", "d1", "decision", "c1", "constraint", T[2], None, T[2], 0.9, []), ("t3", "conflicts_with", "d1", "decision", "d3", "decision", T[9], None, T[9], 0.7, ["e1"]),
        ("t4", "supports", "d3", "decision", "d6", "decision", T[9], None, T[9], 0.7, []), ("t5", "evidences", "k2", "commit", "d6", "decision", T[5], None, T[6], 0.6, []), ("t6", "evidences", "k2", "commit", "d7", "decision", T[5], None, T[6], 0.6, []),
        ("t7", "mentions", "d3", "decision", "n1", "entity", T[9], None, T[9], 0.7, []), ("t8", "depends_on", "d7", "decision", "d2", "decision", T[4], T[9], T[5], 0.6, []), ("t9", "imposes", "d7", "decision", "c6", "constraint", T[4], None, T[5], 0.6, []),
        ("t10", "imposes", "d3", "decision", "c2", "constraint", T[9], None, T[9], 0.8, []),
    ),
    "entity_nodes": _rows("id repo_id canonical_name entity_type embedding valid_from valid_to ingested_at confidence", ("n1", "r1", "Ledger Service", "service", None, T[2], None, T[2], 0.7), ("n2", "r1", "queue", None, [0.1], T[2], None, T[2], 0.7), ("n3", "r1", "Cache", "service", None, T[2], T[8], T[2], 0.7)),
    "claims": _rows(
        "id repo_id kind subject_type subject_id text polarity evidence_grade read_set valid_from valid_to ingested_at confidence",
        ("y1", "r1", "decision", "decision", "d1", "Ledger order", None, "full", [{"kind": "source_file", "uri": "src/ledger.py", "subpath": "post"}], T[2], None, T[2], 0.9),
        ("y2", "r1", "constraint", "constraint", "c1", "Ledger entries must stay", "must", "partial", [{"kind": "source_file", "uri": "src/ledger.py", "subpath": ""}, {"kind": "commit", "uri": "aaa", "subpath": ""}], T[2], None, T[2], 0.9),
        ("y3", "r1", "constraint", "constraint", "c2", "never wait", "must_not", "partial", [], T[9], None, T[9], 0.9), ("y4", "r1", "decision", "decision", "d3", "No cache", None, "none", [], T[9], None, T[9], 0.8),
        ("y5", "r1", "adr", "adr", "a1", "Ledger order", None, "full", [], T[2], None, T[2], 0.9), ("y6", "r1", "decision", "decision", "d2", "Cache", None, "full", [], T[3], T[9], T[3], 0.9),
    ),
    "evidence_anchors": _rows(
        "id repo_id claim_id source_kind source_uri subpath anchored_text content_hash start_line end_line ingested_at",
        ("w1", "r1", "y1", "source_file", "src/ledger.py", "", "post the entry\nin order", "1", 2, 3, T[3]), ("w2", "r1", "y2", "source_file", "src/ledger.py", "post", "check the  partition", "2", 4, 4, T[3]), ("w3", "r1", "y2", "commit", "zzz", "", "", "3", None, None, T[3]),
        ("w4", "r1", "y3", "episode", "e1", "", "The cache lied", "4", None, None, T[3]), ("w5", "r1", "y5", "source_file", "src/ledger.py", "", "gone for good now", "5", 1, 1, T[3]), ("w6", "r1", "y1", "source_file", "src/ledger.py", "", "close the day book at night", "6", 6, 6, T[3]),
    ),
    "evidence_verifications": _rows(
        "id anchor_id checked_at commit_sha edit_class freshness relocated similarity",
        ("z1", "w1", T[5], "aaa", "deleted", "stale", False, 0.1), ("z2", "w1", T[7], "bbb", "unchanged", "fresh", False, None), ("z3", "w2", T[7], "bbb", "affected", "stale", True, 0.7), ("z4", "w3", T[7], "bbb", "deleted", "stale", False, 0.0), ("z5", "w3", T[7], "bbb", "affected", "stale", True, 0.6),
    ),
    "communities": _rows("id repo_id label size valid_from valid_to", ("o1", "r1", "src (Ledger, post)", 3, T[3], None), ("o2", "r1", "old", 1, T[1], T[3])),
    "community_members": _rows("community_id symbol_id", ("o1", "s1"), ("o1", "s2"), ("o1", "s4"), ("o2", "s1")),
    "index_lanes": _rows("repo_id lane indexed_commit status updated_at", ("r1", "symbols", "aaa", "ok", T[4]), ("r1", "adrs", "ccc", "ok", T[8]), ("r2", "symbols", "nope", "failed", T[4])),
    "freshness_manifests": _rows("id repo_id tool view_hash repo_commit payload evaluated_at", ("b1", "r1", "query", "v", "aaa", "{1}", T[4]), ("b2", "r1", "query", "v", "aaa", "{2}", T[5])),
}
#: The present texts the anchors are checked against.
TEXTS = [("src/ledger.py", "head\nnew line\npost the entry\nin order\ncheck the\npartition of the day\nclose the day book late at night\n")]
REACHABLE = ["aaa", "bbb"]


def _value(kind: str, v):
    if v is None:
        return None
    return datetime.fromisoformat(v) if kind == "timestamp_ntz" else v


def store(spark: SparkSession) -> Store:
    tables = {}
    for name, rows in ROWS.items():
        tables[name] = spark.createDataFrame([tuple(_value(kind, r.get(c)) for c, kind in fields(name)) for r in rows], schema(name))
    return Store(spark, tables)


_SQL = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]", "array<struct<kind:string,uri:string,subpath:string>>": "STRUCT(kind VARCHAR, uri VARCHAR, subpath VARCHAR)[]"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {_literal(x)}" for k, x in v.items()) + "}"
    return "'" + str(v).replace("'", "''") + "'"


def constants(*names: str) -> str:
    """``name AS (rows), ...`` for the WITH of a query, with a ``t_`` before each name."""
    out = []
    for name in names:
        rows = [", ".join(f"CAST({_literal(r.get(c))} AS {_SQL[kind]}) AS {c}" for c, kind in fields(name)) for r in ROWS[name]]
        out.append(f"t_{name} AS (" + " UNION ALL ".join(f"SELECT {r}" for r in rows) + ")")
    return ", ".join(out)


