"""Queries of the knowledge tables: reads, write algebra and evidence, each with SQL written from the definitions.

Names ``kg_...`` run over the rows of ``fixtures``; ``repo_...`` over the project's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import ingest, verification
from chronoweave.operators.temporal import in_force, instant
from chronoweave.plans import changes, fixtures
from chronoweave.plans.store import Store
from chronoweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(sql: str, *names: str):
    """Registers a query; ``names`` are the tables of the fixtures its SQL reads as ``t_name``."""

    def add(f):
        QUERIES[f.__name__] = f
        body = sql.strip()
        if names:
            head = "WITH RECURSIVE " if body.startswith("RECURSIVE ") else "WITH "
            body = body.removeprefix("RECURSIVE ").removeprefix("WITH ")
            body = head + fixtures.constants(*names) + (" " if body.startswith("SELECT") else ", ") + body
        SQL[f.__name__] = body
        return f

    return add


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


VIEW = """view AS (SELECT d.id, coalesce(a.id, 'episode:' || e.id) AS parent, coalesce(d.title, a.title, e.source) AS title, coalesce(a.status, 'episode') AS status, coalesce(a.repo_id, e.repo_id) AS repo_id,
d.text, d.confidence, d.valid_from, d.valid_to, coalesce(a.effective_from, e.occurred_at, d.valid_from) AS ef, coalesce(a.effective_to, d.valid_to) AS et FROM t_decisions d LEFT JOIN t_adr_documents a ON a.id = d.adr_id LEFT JOIN t_episodes e ON e.id = d.episode_id)"""
DOCS = ("decisions", "adr_documents", "episodes")


@query(f"""WITH {VIEW} SELECT l.file_path AS path, v.id, v.title FROM (SELECT DISTINCT decision_id, file_path FROM t_decision_code_links) l JOIN view v ON v.id = l.decision_id
WHERE l.file_path = 'src/cache.py' AND v.ef <= TIMESTAMP '2024-01-08' AND (v.et IS NULL OR v.et > TIMESTAMP '2024-01-08')""", *DOCS, "decision_code_links")
def kg_decisions_for_file(spark: SparkSession, d: str) -> DataFrame:
    found = fixtures.store(spark).find_decisions_for_file("src/cache.py", "2024-01-08 00:00:00")
    return found.select(F.lit("src/cache.py").alias("path"), "id", "title")


@query(f"""WITH {VIEW} SELECT v.id, v.title FROM view v WHERE v.valid_from <= TIMESTAMP '2024-01-10' AND (v.valid_to IS NULL OR v.valid_to > TIMESTAMP '2024-01-10') AND EXISTS
(SELECT 1 FROM t_decision_code_links l WHERE l.decision_id = v.id AND l.file_path = 'src/cache.py' AND l.valid_from <= TIMESTAMP '2024-01-10' AND (l.valid_to IS NULL OR l.valid_to > TIMESTAMP '2024-01-10'))""", *DOCS, "decision_code_links")
def kg_decisions_for_file_recorded(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).find_decisions_for_file("src/cache.py", "2024-01-10 00:00:00", event_time=False).select("id", "title")


@query(f"""WITH {VIEW} SELECT f.repo_id, f.path FROM t_files f WHERE f.valid_to IS NULL AND NOT EXISTS (SELECT 1 FROM t_decision_code_links l JOIN view v ON v.id = l.decision_id WHERE l.valid_to IS NULL AND v.repo_id = f.repo_id AND l.file_path = f.path)""", *DOCS, "files", "decision_code_links")
def kg_orphaned_files(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).find_orphaned_files()


@query("SELECT s.id, s.name, f.path AS file_path FROM t_symbols s JOIN t_files f ON f.id = s.file_id WHERE s.valid_to IS NULL AND s.name NOT IN (SELECT symbol FROM t_decision_code_links WHERE symbol IS NOT NULL AND valid_to IS NULL)", "symbols", "files", "decision_code_links")
def kg_orphaned_symbols(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).find_orphaned_symbols()


@query("""SELECT id FROM t_claims WHERE valid_to IS NULL AND ((subject_type = 'decision' AND subject_id IN ('d1', 'd3')) OR (subject_type = 'constraint' AND subject_id IN (SELECT id FROM t_constraints WHERE decision_id IN ('d1', 'd3'))))""", "claims", "constraints")
def kg_claims_of_decisions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).claim_ids_for_decisions(ids(spark, "d1", "d3"))


@query("""SELECT c.id AS claim_id, CASE c.subject_type WHEN 'decision' THEN c.subject_id WHEN 'constraint' THEN k.decision_id END AS decision_id, CASE WHEN c.subject_type = 'adr' THEN c.subject_id ELSE d.adr_id END AS document_id
FROM t_claims c LEFT JOIN t_constraints k ON c.subject_type = 'constraint' AND k.id = c.subject_id LEFT JOIN t_decisions d ON d.id = CASE c.subject_type WHEN 'decision' THEN c.subject_id ELSE k.decision_id END""", "claims", "constraints", "decisions")
def kg_subjects_of_claims(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return s.decision_and_adr_for_subject(s.table("claims"))


@query("""WITH newest AS (SELECT v.* FROM t_evidence_verifications v WHERE checked_at = (SELECT max(checked_at) FROM t_evidence_verifications w WHERE w.anchor_id = v.anchor_id)),
own AS (SELECT c.id AS claim, CASE c.subject_type WHEN 'decision' THEN c.subject_id ELSE k.decision_id END AS decision_id FROM t_claims c LEFT JOIN t_constraints k ON c.subject_type = 'constraint' AND k.id = c.subject_id WHERE c.valid_to IS NULL)
SELECT o.decision_id, count(*) FILTER (n.freshness = 'stale') AS stale, count(*) FILTER (n.freshness = 'stale' AND NOT n.relocated) AS lost FROM own o JOIN t_evidence_anchors a ON a.claim_id = o.claim JOIN newest n ON n.anchor_id = a.id
WHERE o.decision_id IS NOT NULL GROUP BY 1 HAVING stale > 0""", "claims", "constraints", "evidence_anchors", "evidence_verifications")
def kg_drifted_decisions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).drifted_evidence_decisions()


STALE = """open_d AS (SELECT id, adr_id, valid_from FROM t_decisions WHERE valid_to IS NULL), link AS (SELECT DISTINCT decision_id, file_path FROM t_decision_code_links WHERE valid_to IS NULL),
gone AS (SELECT path FROM t_files GROUP BY path HAVING count(*) FILTER (valid_to IS NULL) = 0), bare AS (SELECT f.path FROM t_files f JOIN t_symbols s ON s.file_id = f.id WHERE f.valid_to IS NULL GROUP BY f.path HAVING count(*) FILTER (s.valid_to IS NULL) = 0),
active AS (SELECT g.decision_id, max(k.source_time) AS last FROM t_decision_git_links g JOIN t_commits k ON k.id = g.ref_id WHERE g.ref_type = 'commit' GROUP BY 1),
newest AS (SELECT v.* FROM t_evidence_verifications v WHERE checked_at = (SELECT max(checked_at) FROM t_evidence_verifications w WHERE w.anchor_id = v.anchor_id)),
drift AS (SELECT CASE c.subject_type WHEN 'decision' THEN c.subject_id ELSE k.decision_id END AS decision_id, bool_or(n.freshness = 'stale' AND NOT n.relocated) AS lost FROM t_claims c LEFT JOIN t_constraints k ON c.subject_type = 'constraint' AND k.id = c.subject_id
JOIN t_evidence_anchors a ON a.claim_id = c.id JOIN newest n ON n.anchor_id = a.id WHERE c.valid_to IS NULL AND n.freshness = 'stale' GROUP BY 1),
signal AS (SELECT decision_id, 'deleted_file' AS s, 0.85 AS c FROM link WHERE file_path IN (SELECT path FROM gone) AND decision_id IN (SELECT id FROM open_d)
UNION SELECT decision_id, 'missing_symbols', 0.7 FROM link WHERE file_path IN (SELECT path FROM bare) AND decision_id IN (SELECT id FROM open_d)
UNION SELECT decision_id, 'inactive', 0.45 FROM active WHERE last < TIMESTAMP '2024-01-06' AND decision_id IN (SELECT id FROM open_d)
UNION SELECT id, 'aged', 0.35 FROM open_d WHERE valid_from < TIMESTAMP '2024-01-06' AND adr_id IN (SELECT id FROM t_adr_documents WHERE valid_to IS NULL AND lower(status) = 'accepted' AND superseded_by IS NULL AND id NOT IN (SELECT superseded_id FROM t_supersession_edges))
UNION SELECT decision_id, 'drifted_evidence', CASE WHEN lost THEN 0.8 ELSE 0.6 END FROM drift WHERE decision_id IS NOT NULL)"""


@query(f"WITH {STALE} SELECT decision_id, CAST(max(c) AS DOUBLE) AS confidence, string_agg(s, ',' ORDER BY s) AS signals FROM signal GROUP BY 1",
       "decisions", "decision_code_links", "files", "symbols", "decision_git_links", "commits", "evidence_verifications", "claims", "constraints", "evidence_anchors", "adr_documents", "supersession_edges")
def kg_stale_decisions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).find_stale_decisions("2024-01-06 00:00:00")


@query(f"""WITH {VIEW}, own AS (SELECT v.id FROM view v WHERE v.repo_id = 'r1' AND v.valid_to IS NULL),
rule AS (SELECT c.id, c.decision_id, coalesce((SELECT max(polarity) FROM t_claims p WHERE p.subject_type = 'constraint' AND p.subject_id = c.id AND p.valid_to IS NULL) = 'must_not',
regexp_matches(lower(c.text), 'must not|shall not|should not|may not|do not|don''t|never|prohibit|forbid|avoid')) AS no,
list_filter(list_distinct(list_filter(regexp_split_to_array(lower(c.text), '[^a-z0-9]+'), lambda w: length(w) > 3)), lambda w: w NOT IN ('must', 'shall', 'never', 'should', 'with', 'that')) AS t
FROM t_constraints c JOIN own o ON o.id = c.decision_id),
pair AS (SELECT a.id AS a, b.id AS b, CASE WHEN EXISTS (SELECT 1 FROM t_decision_code_links x JOIN t_decision_code_links y ON x.file_path = y.file_path WHERE x.decision_id = a.decision_id AND y.decision_id = b.decision_id AND x.valid_to IS NULL AND y.valid_to IS NULL) THEN 0.75 ELSE 0.5 END AS confidence
FROM rule a JOIN rule b ON a.decision_id <> b.decision_id AND NOT a.no AND b.no WHERE len(list_intersect(a.t, b.t)) >= 2 AND 2 * len(list_intersect(a.t, b.t)) >= least(len(a.t), len(b.t))),
sup AS (SELECT n.adr_id AS newer, o.adr_id AS older, o.valid_to FROM t_supersession_edges s JOIN t_adr_documents n ON n.id = s.superseder_id JOIN t_adr_documents o ON o.id = s.superseded_id)
SELECT 'explicit_edge' AS kind, source_id AS a, target_id AS b, confidence FROM t_temporal_edges WHERE edge_type = 'conflicts_with' AND valid_to IS NULL AND (source_id IN (SELECT id FROM own) OR target_id IN (SELECT id FROM own))
UNION ALL SELECT 'contradictory_constraints', a, b, CAST(confidence AS DOUBLE) FROM pair UNION ALL SELECT 'superseded_but_active', newer, older, CAST(0.8 AS DOUBLE) FROM sup WHERE valid_to IS NULL
UNION ALL SELECT 'supersession_cycle', x.newer, x.older, CAST(0.9 AS DOUBLE) FROM sup x JOIN sup y ON x.newer = y.older AND x.older = y.newer WHERE x.newer < x.older""", *DOCS, "constraints", "claims", "decision_code_links", "supersession_edges", "temporal_edges")
def kg_check_consistency(spark: SparkSession, d: str) -> DataFrame:
    from chronoweave.plans.checks import check_consistency

    return check_consistency(fixtures.store(spark), "r1")


@query("""WITH w AS (SELECT DISTINCT file_id, name, min(id) OVER (PARTITION BY file_id, name) AS id FROM t_symbols WHERE valid_to IS NULL), f AS (SELECT * FROM t_files WHERE valid_to IS NULL),
e(edge_id, file_id, to_name, spec) AS (VALUES ('1', 'f1', 'Ledger', NULL), ('2', 'f3', 'post', NULL), ('3', 'f3', 'Queue', NULL), ('4', 'f3', 'size', './index'), ('5', 'f5', 'Ledger', NULL), ('6', 'f5', 'nothing', '../src/queue'), ('7', 'f5', 'push', NULL), ('8', 'f5', 'size', '../src/./queue')),
r AS (SELECT e.*, s.id AS same, CASE e.edge_id WHEN '2' THEN 's1' WHEN '3' THEN 's6' END AS imp, CASE e.edge_id WHEN '4' THEN 's7' WHEN '8' THEN 's7' END AS mod,
(SELECT min(x.id) FROM t_symbols x JOIN f ON f.id = x.file_id WHERE x.valid_to IS NULL AND f.repo_id = 'r1' AND x.name = e.to_name HAVING count(*) = 1) AS uniq FROM e LEFT JOIN w s ON s.file_id = e.file_id AND s.name = e.to_name)
SELECT edge_id, coalesce(same, imp, mod, uniq) AS to_id, CAST(CASE WHEN same IS NOT NULL THEN 0.95 WHEN imp IS NOT NULL THEN 0.9 WHEN mod IS NOT NULL THEN 0.8 WHEN uniq IS NOT NULL THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence,
CASE WHEN same IS NOT NULL THEN 'same-file' WHEN imp IS NOT NULL THEN 'import' WHEN mod IS NOT NULL THEN 'module-path' WHEN uniq IS NOT NULL THEN 'unique-name' ELSE 'unresolved' END AS resolution FROM r""", "symbols", "files")
def kg_resolution_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    rows = [("1", "f1", "Ledger", None), ("2", "f3", "post", None), ("3", "f3", "Queue", None), ("4", "f3", "size", "./index"), ("5", "f5", "Ledger", None), ("6", "f5", "nothing", "../src/queue"), ("7", "f5", "push", None), ("8", "f5", "size", "../src/./queue")]
    edges = spark.createDataFrame([(e, "r1", f, "x", n, "calls", None, p) for e, f, n, p in rows], "edge_id string, repo_id string, file_id string, from_name string, to_name string, edge_type string, recv string, spec string")
    files = s.open("files").select(F.col("id").alias("file_id"), "repo_id", "path")
    symbols = s.live_symbols().select("id", "repo_id", "file_id", "name")
    return ingest.resolve_edges(edges, symbols, files, imports=s.open("file_imports"))


@query("SELECT a.file_id, a.id AS outer_id, b.id AS inner_id FROM t_symbols a JOIN t_symbols b ON a.file_id = b.file_id AND a.line < b.line AND a.end_line >= b.end_line WHERE a.valid_to IS NULL AND b.valid_to IS NULL", "symbols")
def kg_containment(spark: SparkSession, d: str) -> DataFrame:
    return ingest.nested_spans(fixtures.store(spark).open("symbols"))


@query("SELECT 'src (Ledger, post, push)' AS label, 3::BIGINT AS size, 'o1' AS community")
def kg_community_labels(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    members = s.open("communities").select(F.col("id").alias("community")).join(s.table("community_members").withColumnRenamed("community_id", "community"), "community")
    return ingest.community_labels(members.join(s.live_symbols().select(F.col("id").alias("symbol_id"), "name", F.col("file_path").alias("path")), "symbol_id"))


@query("""WITH u AS (SELECT m.community_id, s.name, f.path FROM t_community_members m JOIN t_symbols s ON s.id = m.symbol_id JOIN t_files f ON f.id = s.file_id WHERE s.valid_to IS NULL)
SELECT c.id, c.label, list_sort(list(DISTINCT u.path)) AS files, list_sort(list(DISTINCT u.name)) AS symbols FROM t_communities c JOIN u ON u.community_id = c.id WHERE c.valid_to IS NULL AND c.repo_id = 'r1' GROUP BY 1, 2""", "communities", "community_members", "symbols", "files")
def kg_communities(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).get_communities_for_repo("r1")


@query("""WITH c AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(message, '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 4)) AS t FROM t_commits WHERE message IS NOT NULL AND NOT regexp_matches(upper(message), 'ADR[- ]*[0-9]')),
d AS (SELECT d.id, list_distinct(list_filter(regexp_split_to_array(coalesce(d.title, a.title), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 4)) AS t FROM t_decisions d LEFT JOIN t_adr_documents a ON a.id = d.adr_id)
SELECT c.id AS commit_id, d.id AS decision_id, CAST(0.6 AS DOUBLE) AS confidence FROM c JOIN d ON len(list_intersect(c.t, d.t)) >= 2""", "commits", "decisions", "adr_documents")
def kg_keyword_links(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return ingest.keyword_links(s.table("commits"), s.decision_view())


FACTS = "SELECT fact FROM (SELECT {} AS fact FROM {})"


@query("""WITH latest AS (SELECT * FROM t_adr_documents WHERE repo_id = 'r1' QUALIFY row_number() OVER (PARTITION BY adr_id ORDER BY ingested_at DESC, valid_from DESC, id DESC) = 1),
own AS (SELECT d.id, a.adr_id FROM t_decisions d JOIN t_adr_documents a ON a.id = d.adr_id WHERE a.repo_id = 'r1')
SELECT 'adr|' || adr_id || '|' || status || '|' || CASE WHEN valid_to IS NULL THEN 'open' ELSE 'closed' END || '|' || title AS fact FROM latest
UNION ALL SELECT 'supersedes|' || n.adr_id || '|' || o.adr_id FROM t_supersession_edges s JOIN latest n ON n.id = s.superseder_id JOIN latest o ON o.id = s.superseded_id
UNION ALL SELECT 'link|' || o.adr_id || '|' || l.file_path || '|' || coalesce(l.symbol, '') || '|' || l.link_type || '|' || printf('%.2f', l.confidence) FROM t_decision_code_links l JOIN own o ON o.id = l.decision_id WHERE l.valid_to IS NULL AND l.link_source = 'adr_text'
UNION ALL SELECT 'defines|' || o.adr_id || '|' || printf('%.2f', e.confidence) FROM t_temporal_edges e JOIN own o ON o.id = e.target_id WHERE e.edge_type = 'defines' AND e.valid_to IS NULL
UNION ALL SELECT 'imposes|' || o.adr_id || '|' || c.text || '|' || printf('%.2f', e.confidence) FROM t_temporal_edges e JOIN own o ON o.id = e.source_id JOIN t_constraints c ON c.id = e.target_id WHERE e.edge_type = 'imposes' AND e.valid_to IS NULL""",
       "adr_documents", "decisions", "supersession_edges", "decision_code_links", "temporal_edges", "constraints")
def kg_document_facts(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).adr_declared_facts("r1")


@query("""WITH s AS (SELECT s.*, f.path FROM t_symbols s JOIN t_files f ON f.id = s.file_id WHERE f.repo_id = 'r1')
SELECT concat_ws('|', 'symbol', path, kind, name, line, end_line, coalesce(signature, ''), coalesce(return_type, ''), coalesce(visibility, ''), CAST(is_async AS INT), coalesce(CAST(complexity AS VARCHAR), ''), '') AS fact FROM s WHERE valid_to IS NULL
UNION ALL SELECT concat_ws('|', 'edge', a.path, a.name, e.edge_type, coalesce(b.path, ''), coalesce(b.name, e.to_name, ''), e.resolution, printf('%.2f', e.confidence)) FROM t_symbol_edges e JOIN s a ON a.id = e.from_id LEFT JOIN s b ON b.id = e.to_id WHERE e.valid_to IS NULL
UNION ALL SELECT concat_ws('|', 'import', f.path, i.name, coalesce(i.spec, ''), coalesce(g.path, ''), coalesce(x.name, '')) FROM t_file_imports i JOIN t_files f ON f.id = i.file_id LEFT JOIN t_files g ON g.id = i.target_file_id LEFT JOIN t_symbols x ON x.id = i.target_symbol_id WHERE i.valid_to IS NULL
UNION ALL SELECT concat_ws('|', 'route', r.method, r.path, coalesce(r.framework, ''), r.file_path || ':' || r.line, coalesce(x.name, ''), printf('%.2f', r.confidence)) FROM t_routes r LEFT JOIN t_symbols x ON x.id = r.handler_id WHERE r.valid_to IS NULL""",
       "symbols", "files", "symbol_edges", "file_imports", "routes")
def kg_symbol_facts(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).symbol_declared_facts("r1")


@query("""RECURSIVE e AS (SELECT source_id AS a, target_id AS b FROM t_temporal_edges WHERE edge_type IN ('applies_to', 'conflicts_with', 'supports', 'depends_on') AND source_type = 'decision' AND target_type = 'decision' AND valid_to IS NULL
UNION SELECT x.target_id, y.target_id FROM t_temporal_edges x JOIN t_temporal_edges y ON x.source_id = y.source_id AND x.target_id <> y.target_id WHERE x.edge_type = 'evidences' AND y.edge_type = 'evidences' AND x.valid_to IS NULL AND y.valid_to IS NULL),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT 'd1' AS id, 0 AS depth UNION SELECT l.b, r.depth + 1 FROM r JOIN l ON l.a = r.id WHERE r.depth < 3)
SELECT id, CAST(min(depth) AS INT) AS depth FROM r WHERE id <> 'd1' GROUP BY id""", "temporal_edges")
def kg_neighbor_decisions(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).graph_neighbor_decisions(ids(spark, "d1"), 3)


@query("""RECURSIVE r AS (SELECT 'a1' AS node, 0 AS depth UNION SELECT e.target_id, r.depth + 1 FROM r JOIN t_temporal_edges e ON e.source_id = r.node WHERE r.depth < 3 AND e.valid_to IS NULL AND e.edge_type IN ('applies_to', 'depends_on', 'conflicts_with', 'defines', 'imposes'))
SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""", "temporal_edges")
def kg_impact(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).impact_of("a1")


def _tf(c: str) -> str:
    return f"(length({c}) - length(replace({c}, 'ledger', ''))) // 6 + (length({c}) - length(replace({c}, 'queue', ''))) // 5"


@query(f"""RECURSIVE {VIEW}, v AS (SELECT view.*, d.embedding FROM view JOIN t_decisions d USING (id) WHERE view.repo_id = 'r1' AND view.valid_to IS NULL),
k AS (SELECT id, row_number() OVER (ORDER BY {_tf("lower(title || ' ' || text)")} DESC, confidence DESC, title, id) AS rank FROM v WHERE {_tf("lower(title || ' ' || text)")} > 0),
c AS (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), [1.0::DOUBLE, 0.0::DOUBLE]) AS cosine FROM v WHERE len(embedding) = 2), s AS (SELECT id, row_number() OVER (ORDER BY cosine DESC, confidence DESC, title, id) AS rank FROM c WHERE cosine >= 0.3),
seed AS (SELECT id FROM (SELECT 0 AS l, rank, id FROM k WHERE rank <= 5 UNION ALL SELECT 1, rank, id FROM s WHERE rank <= 5 ORDER BY l, rank LIMIT 5)),
e AS (SELECT source_id AS a, target_id AS b FROM t_temporal_edges WHERE edge_type IN ('applies_to', 'conflicts_with', 'supports', 'depends_on') AND source_type = 'decision' AND target_type = 'decision' AND valid_to IS NULL
UNION SELECT x.target_id, y.target_id FROM t_temporal_edges x JOIN t_temporal_edges y ON x.source_id = y.source_id AND x.target_id <> y.target_id WHERE x.edge_type = 'evidences' AND y.edge_type = 'evidences'),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), g AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM (SELECT DISTINCT l.b AS id FROM seed JOIN l ON l.a = seed.id WHERE l.b NOT IN (SELECT id FROM seed)) JOIN v USING (id)),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(list, ',' ORDER BY list) AS found_by FROM (SELECT 'keyword' AS list, * FROM k UNION ALL SELECT 'semantic', * FROM s UNION ALL SELECT 'graph', * FROM g) GROUP BY id)
SELECT f.id, f.score, f.found_by, v.title, v.status FROM f JOIN v USING (id) ORDER BY f.score DESC, v.confidence DESC, v.title, f.id LIMIT 10""", *DOCS, "temporal_edges")
def kg_hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).query(["ledger", "queue"], "r1", [1.0, 0.0]).select("id", "score", "found_by", "title", "status")


@query("""SELECT f.file_path, row_number() OVER (PARTITION BY f.file_path ORDER BY k.source_time DESC, k.sha) AS rank, k.sha FROM (SELECT DISTINCT file_path, commit_id FROM t_commit_files) f JOIN t_commits k ON k.id = f.commit_id QUALIFY rank <= 2""", "commit_files", "commits")
def kg_recent_commits(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return s.fetch_recent_commits_for_file(s.table("commit_files").select("file_path"), 2).select("file_path", F.col("rank").cast("long").alias("rank"), "sha")


@query("""WITH f AS (SELECT DISTINCT commit_id, file_path FROM t_commit_files) SELECT b.file_path AS peer, count(*) AS n FROM f a JOIN f b ON a.commit_id = b.commit_id AND a.file_path = 'src/ledger.py' AND b.file_path <> a.file_path GROUP BY 1 HAVING n >= 2""", "commit_files")
def kg_cochanged(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).fetch_cochanged_files("src/ledger.py")


@query("""WITH s AS (SELECT s.id, s.name, f.path FROM t_symbols s JOIN t_files f ON f.id = s.file_id WHERE s.valid_to IS NULL)
SELECT a.name AS caller, a.path AS caller_file, b.name AS callee, e.edge_type, e.confidence FROM t_symbol_edges e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE e.valid_to IS NULL AND b.path = 'src/ledger.py' AND a.path <> b.path""", "symbols", "files", "symbol_edges")
def kg_file_callers(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).fetch_file_callers_brief("src/ledger.py")


@query("SELECT canonical_name, share FROM (SELECT 'Ledger Service' AS canonical_name, CAST(0.5 AS DOUBLE) AS share)")
def kg_similar_names(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).similar_entity_names("r1", "LedgerModules book")


@query("""SELECT f.family, f.total, f.embedded, f.last_ingested, round(CASE WHEN f.total = 0 THEN 1.0 ELSE f.embedded / f.total END, 6) AS coverage FROM (
SELECT 'decisions' AS family, count(*) AS total, count(embedding) AS embedded, max(ingested_at) AS last_ingested FROM t_decisions UNION ALL SELECT 'constraints', count(*), count(embedding), max(ingested_at) FROM t_constraints
UNION ALL SELECT 'episodes', count(*), count(embedding), max(ingested_at) FROM t_episodes UNION ALL SELECT 'commits', count(*), count(embedding), max(ingested_at) FROM t_commits UNION ALL SELECT 'pull_requests', count(*), count(embedding), max(ingested_at) FROM t_pull_requests
UNION ALL SELECT 'symbols', count(*), count(embedding), max(ingested_at) FROM t_symbols UNION ALL SELECT 'entity_nodes', count(*), count(embedding), max(ingested_at) FROM t_entity_nodes) f""", "decisions", "constraints", "episodes", "commits", "pull_requests", "symbols", "entity_nodes")
def kg_index_status(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).index_status_counts()


@query("""SELECT 'decisions' AS family, id, text FROM t_decisions WHERE embedding IS NULL UNION ALL SELECT 'constraints', id, text FROM t_constraints WHERE embedding IS NULL UNION ALL SELECT 'episodes', id, content FROM t_episodes WHERE embedding IS NULL AND content <> ''
UNION ALL SELECT 'commits', id, message FROM t_commits WHERE embedding IS NULL AND message IS NOT NULL UNION ALL SELECT 'pull_requests', id, concat_ws(chr(10), title, body) FROM t_pull_requests UNION ALL SELECT 'symbols', id, name FROM t_symbols WHERE embedding IS NULL
UNION ALL SELECT 'entity_nodes', id, canonical_name FROM t_entity_nodes WHERE embedding IS NULL""", "decisions", "constraints", "episodes", "commits", "pull_requests", "symbols", "entity_nodes")
def kg_without_embeddings(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    out = None
    for name in ("decisions", "constraints", "episodes", "commits", "pull_requests", "symbols", "entity_nodes"):
        one = s.without_embeddings(name).select(F.lit(name).alias("family"), "id", "text")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT id AS claim_id, unnest(read_set) AS x FROM t_claims) SELECT r.claim_id, r.x.kind AS kind, r.x.uri AS uri, r.x.subpath AS subpath FROM r WHERE NOT EXISTS
(SELECT 1 FROM t_evidence_anchors a WHERE a.claim_id = r.claim_id AND a.source_kind = r.x.kind AND a.source_uri = r.x.uri AND (a.subpath = '' OR a.subpath = r.x.subpath))""", "claims", "evidence_anchors")
def kg_read_set_gaps(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return verification.incomplete_claims(s.table("claims"), s.table("evidence_anchors"))


def _verified(spark: SparkSession) -> tuple[Store, DataFrame]:
    s = fixtures.store(spark)
    texts = spark.createDataFrame(fixtures.TEXTS, "source_uri string, text string")
    there = spark.createDataFrame([(x,) for x in fixtures.REACHABLE], "sha string")
    return s, verification.verify_anchors(s.table("evidence_anchors"), texts, None, there)


@query("""SELECT * FROM (VALUES ('w1', 'shifted', 'fresh', 1, 4), ('w2', 'shifted', 'fresh', 1, 6), ('w3', 'deleted', 'stale', NULL, NULL), ('w4', 'unchanged', 'fresh', NULL, NULL), ('w5', 'deleted', 'stale', 1, 1), ('w6', 'deleted', 'stale', 6, 6)) t(anchor_id, edit_class, freshness, "first", "last")""")
def kg_verify_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark)[1].select("anchor_id", "edit_class", "freshness", "first", "last")


@query("""SELECT CAST(2 AS BIGINT) AS unprovable, CAST(0 AS BIGINT) AS affected, CAST(2 AS BIGINT) AS drifted, 'sync_incremental,sync_commits' AS syncs""")
def kg_obligation(spark: SparkSession, d: str) -> DataFrame:
    s, verified = _verified(spark)
    claims = s.open("claims").where(F.col("id").isin("y1", "y2", "y3"))
    own = verified.join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    return verification.obligation(verification.claim_dispositions(claims, own), s.table("evidence_anchors"), own)


@query("""SELECT l.repo_id, l.lane, l.status, CASE WHEN k.id IS NOT NULL THEN (SELECT count(*) FROM t_commits n WHERE n.repo_id = l.repo_id AND n.source_time > k.source_time) END AS lag FROM t_index_lanes l LEFT JOIN t_commits k ON k.repo_id = l.repo_id AND k.sha = l.indexed_commit""", "index_lanes", "commits")
def kg_lane_lag(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return verification.lane_lag(s.table("index_lanes"), s.table("commits"))


@query("""WITH n AS (SELECT id FROM t_symbols WHERE file_id = 'f4' AND valid_to IS NULL)
SELECT 'symbols' AS kind, count(*) AS closed FROM n UNION ALL SELECT 'symbol_edges', count(*) FROM t_symbol_edges WHERE valid_to IS NULL AND from_id IN (SELECT id FROM n)
UNION ALL SELECT 'file_imports', count(*) FROM t_file_imports WHERE valid_to IS NULL AND file_id = 'f4' UNION ALL SELECT 'routes', count(*) FROM t_routes WHERE valid_to IS NULL AND file_path = 'src/queue/index.ts' UNION ALL SELECT 'files', 1""", "symbols", "symbol_edges", "file_imports", "routes")
def kg_retire_files(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    after = changes.retire_files_where(s, spark.createDataFrame([("r1", "src/queue/index.ts")], "repo_id string, path string"), NOW)
    return changes.closed(s, after, ["symbols", "symbol_edges", "file_imports", "routes", "files"])


@query("""WITH gone AS (SELECT id FROM t_symbols GROUP BY id HAVING count(*) FILTER (valid_to IS NULL) = 0)
SELECT id, CASE WHEN lost THEN NULL ELSE to_id END AS to_id, CASE WHEN lost THEN 0.3 ELSE confidence END AS confidence, CASE WHEN lost THEN 'unresolved' ELSE resolution END AS resolution,
CASE WHEN valid_to IS NULL AND from_id IN (SELECT id FROM gone) THEN TIMESTAMP '2024-01-20' ELSE valid_to END AS valid_to FROM (SELECT *, coalesce(to_id IN (SELECT id FROM gone) AND valid_to IS NULL, false) AS lost FROM t_symbol_edges)""", "symbols", "symbol_edges")
def kg_retired_symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    s = changes.close_edges_from_retired_symbols(changes.unresolve_edges_to_retired_symbols(fixtures.store(spark)), NOW)
    return s.table("symbol_edges").select("id", "to_id", "confidence", "resolution", "valid_to")


@query("""WITH own AS (SELECT id FROM t_decisions WHERE adr_id = 'a1'), c AS (SELECT id FROM t_constraints WHERE decision_id IN (SELECT id FROM own))
SELECT 'decisions' AS kind, count(*) AS closed FROM own UNION ALL SELECT 'constraints', count(*) FROM c UNION ALL SELECT 'claims', count(*) FROM t_claims WHERE valid_to IS NULL AND ((subject_type = 'decision' AND subject_id IN (SELECT id FROM own)) OR (subject_type = 'constraint' AND subject_id IN (SELECT id FROM c)))
UNION ALL SELECT 'decision_code_links', count(*) FROM t_decision_code_links WHERE valid_to IS NULL AND decision_id IN (SELECT id FROM own) UNION ALL SELECT 'temporal_edges', count(*) FROM t_temporal_edges WHERE valid_to IS NULL
AND ((edge_type IN ('imposes', 'mentions') AND source_id IN (SELECT id FROM own)) OR (edge_type = 'defines' AND target_id IN (SELECT id FROM own)))""", "decisions", "constraints", "claims", "decision_code_links", "temporal_edges")
def kg_close_document(spark: SparkSession, d: str) -> DataFrame:
    s = fixtures.store(spark)
    return changes.closed(s, changes.close_decisions_for_adr(s, ids(spark, "a1"), NOW), ["decisions", "constraints", "claims", "decision_code_links", "temporal_edges"])


@query("""SELECT * FROM (VALUES ('decisions', 'd6', true), ('decisions', 'd7', true), ('decisions', 'd1', false), ('constraints', 'c6', true), ('constraints', 'c5', false), ('links', 'd1|docs/readme.md', false), ('links', 'd1|src/ledger.py', false),
('git', 'd1|commit|k1', false), ('git', 'd1|commit|k2', false), ('git', 'd7|commit|k2', true), ('git', 'd1|commit|k3', false), ('git', 'd1|pr|p1', false)) t(kind, what, closed)""")
def kg_merge_decisions(spark: SparkSession, d: str) -> DataFrame:
    """d7 goes into d6 and d6 into d1: what moves along the chain, and what is closed."""
    m = spark.createDataFrame([("d7", "d6", "e1", 0.9), ("d6", "d1", "e1", 0.8)], "loser_id string, survivor_id string, episode_id string, similarity double")
    s = changes.merge_decision_into(fixtures.store(spark), m, NOW)
    own = F.col("decision_id").isin("d1", "d6", "d7")
    shut = F.col("valid_to").isNotNull().alias("closed")
    part = lambda df, kind, what: df.select(F.lit(kind).alias("kind"), what.alias("what"), shut)
    return (
        part(s.table("decisions").where(F.col("id").isin("d1", "d6", "d7")), "decisions", F.col("id"))
        .unionByName(part(s.table("constraints").where(F.col("id").isin("c5", "c6")), "constraints", F.col("id")))
        .unionByName(part(s.table("decision_code_links").where(own), "links", F.concat_ws("|", "decision_id", "file_path")))
        .unionByName(part(s.table("decision_git_links").where(own), "git", F.concat_ws("|", "decision_id", "ref_type", "ref_id")))
    )


@query("""SELECT * FROM (VALUES ('files', CAST(7 AS BIGINT), CAST(1 AS BIGINT)), ('symbols', 9, 2), ('commits', 5, 0), ('index_lanes', 3, 0), ('entity_nodes', 4, 1), ('temporal_edges', 11, 1), ('evidence_anchors', 7, 0)) t(kind, "rows", closed)""")
def kg_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Each insert with one row that is there already and one that isn't: rows and closed rows after it."""
    s = fixtures.store(spark)
    at = lambda df, *c: df.withColumns({x: instant(NOW) for x in c})
    s = changes.upsert_file(s, spark.createDataFrame([("r1", "src/ledger.py"), ("r1", "src/new.py"), ("r1", "src/new.py")], "repo_id string, path string"), NOW)
    s = changes.insert_symbol(s, spark.createDataFrame([("f1", "post", "function", 11, 22), ("f1", "void", "function", 70, 71)], "file_id string, name string, kind string, line int, end_line int"), NOW)
    s = changes.insert_commit(s, at(spark.createDataFrame([("n1", "r1", "aaa"), ("n2", "r2", "bbb")], "id string, repo_id string, sha string"), "source_time", "ingested_at"))
    s = changes.upsert_index_lane(s, at(spark.createDataFrame([("r1", "symbols", "ccc", "ok")], "repo_id string, lane string, indexed_commit string, status string"), "updated_at"))
    s = changes.upsert_entity_node(s, at(spark.createDataFrame([("r1", "queue"), ("r1", "Cache")], "repo_id string, canonical_name string"), "valid_from", "ingested_at"))
    s = changes.insert_temporal_edge_if_absent(s, at(spark.createDataFrame([("u1", "supports", "d3", "decision", "d6", "decision"), ("u2", "depends_on", "d7", "decision", "d2", "decision")], "id string, edge_type string, source_id string, source_type string, target_id string, target_type string"), "valid_from"))
    s = changes.insert_evidence_anchor(s, spark.createDataFrame([("u1", "y1", "source_file", "src/ledger.py", "", "1"), ("u2", "y1", "source_file", "src/ledger.py", "", "9")], "id string, claim_id string, source_kind string, source_uri string, subpath string, content_hash string"))
    out = None
    for name in ("files", "symbols", "commits", "index_lanes", "entity_nodes", "temporal_edges", "evidence_anchors"):
        df = s.table(name)
        end = F.col("valid_to").isNotNull() if "valid_to" in df.columns else F.lit(False)
        one = df.agg(F.count("*").alias("rows"), F.count_if(end).alias("closed")).select(F.lit(name).alias("kind"), "rows", "closed")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {VIEW} SELECT r.id AS repo_id, (SELECT count(*) FROM t_adr_documents WHERE repo_id = r.id) AS documents, (SELECT count(*) FROM view WHERE repo_id = r.id) AS decisions, (SELECT count(*) FROM t_constraints c JOIN view v ON v.id = c.decision_id WHERE v.repo_id = r.id) AS constraints,
(SELECT count(*) FROM t_files WHERE repo_id = r.id) AS files, (SELECT count(*) FROM t_symbols s JOIN t_files f ON f.id = s.file_id WHERE f.repo_id = r.id) AS symbols, (SELECT count(*) FROM t_commits WHERE repo_id = r.id) AS commits,
(SELECT count(*) FROM t_pull_requests WHERE repo_id = r.id) AS pull_requests, (SELECT count(*) FROM t_episodes WHERE repo_id = r.id) AS episodes, (SELECT count(*) FROM t_temporal_edges) AS temporal_edges FROM t_repositories r""", *DOCS, "constraints", "files", "symbols", "commits", "pull_requests", "temporal_edges", "repositories")
def kg_repository_counts(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.store(spark).repository_counts()


@query("SELECT n, left_over FROM (SELECT 'repositories' AS n, CAST(1 AS BIGINT) AS left_over UNION ALL SELECT 'decisions', 1 UNION ALL SELECT 'files', 1 UNION ALL SELECT 'symbols', 0 UNION ALL SELECT 'commits', 1 UNION ALL SELECT 'temporal_edges', 0 UNION ALL SELECT 'decision_code_links', 1 UNION ALL SELECT 'evidence_verifications', 0 UNION ALL SELECT 'community_members', 0 UNION ALL SELECT 'supersession_edges', 0)")
def kg_delete_repository(spark: SparkSession, d: str) -> DataFrame:
    s = changes.delete_repository(fixtures.store(spark), "r1")
    out = None
    for name in ("repositories", "decisions", "files", "symbols", "commits", "temporal_edges", "decision_code_links", "evidence_verifications", "community_members", "supersession_edges"):
        one = s.table(name).agg(F.count("*").alias("left_over")).select(F.lit(name).alias("n"), "left_over")
        out = one if out is None else out.unionByName(one)
    return out


# over the project's tables
def project_store(spark: SparkSession, d: str) -> Store:
    """The knowledge tables the project's tables give: repositories, documents, decisions, files, symbols, edges, references."""
    span = table(spark, d, "symbol_span").distinct()
    open_end = F.when(F.max(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to"))
    file_id = F.concat_ws("|", "repo_id", "file_path")
    files = span.groupBy("repo_id", "file_path").agg(F.min("valid_from").alias("valid_from"), open_end.alias("valid_to"), F.max("ingested_at").alias("ingested_at")).select(file_id.alias("id"), "repo_id", F.col("file_path").alias("path"), "ingested_at", "valid_from", "valid_to")
    symbols = span.select("id", file_id.alias("file_id"), "name", "kind", "valid_from", "valid_to", "ingested_at").distinct()
    return Store(spark, {
        "repositories": table(spark, d, "repository"), "adr_documents": table(spark, d, "adr_document").distinct(), "decisions": table(spark, d, "decision").distinct(), "episodes": table(spark, d, "episode").distinct(),
        "files": files, "symbols": symbols, "symbol_edges": table(spark, d, "symbol_edge").distinct(),
    })


_F = """f AS (SELECT repo_id, file_path, bool_or(valid_to IS NULL) AS live FROM symbol_span GROUP BY 1, 2), s AS (SELECT DISTINCT id, repo_id, name, file_path FROM symbol_span WHERE valid_to IS NULL)"""


@query(f"WITH {_F}, n AS (SELECT DISTINCT repo_id, name, id, file_path FROM s) SELECT repo_id, name, min(id) AS id FROM (SELECT DISTINCT id, repo_id, name, file_path, kind, valid_from, ingested_at FROM symbol_span WHERE valid_to IS NULL) GROUP BY 1, 2 HAVING count(*) = 1")
def repo_unique_names(spark: SparkSession, d: str) -> DataFrame:
    return project_store(spark, d).find_unique_symbol_id_in_repo()


@query("""WITH s AS (SELECT DISTINCT id, repo_id, file_path FROM symbol_span WHERE valid_to IS NULL), e AS (SELECT DISTINCT from_id, to_id FROM symbol_edge WHERE valid_to IS NULL AND to_id IS NOT NULL)
SELECT DISTINCT b.file_path AS callee_file, a.file_path AS caller_file FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE a.file_path <> b.file_path""")
def repo_caller_files(spark: SparkSession, d: str) -> DataFrame:
    s = project_store(spark, d)
    return s.find_one_hop_caller_files(s.table("files").select("path"))


@query("""WITH gone AS (SELECT id FROM symbol_span GROUP BY id HAVING count(*) FILTER (valid_to IS NULL) = 0), e AS (SELECT DISTINCT * FROM symbol_edge), x AS (SELECT *, coalesce(valid_to IS NULL AND to_id IN (SELECT id FROM gone), false) AS lost, valid_to IS NULL AND from_id IN (SELECT id FROM gone) AS ended FROM e)
SELECT edge_type, count(*) AS edges, count(*) FILTER (lost) AS unresolved, count(*) FILTER (ended) AS closed FROM x GROUP BY 1""")
def repo_retired_symbols(spark: SparkSession, d: str) -> DataFrame:
    """What an index run does to the edges of symbols that are gone."""
    s = project_store(spark, d)
    after = changes.close_edges_from_retired_symbols(changes.unresolve_edges_to_retired_symbols(s), "2026-01-01 00:00:00")
    was = s.table("symbol_edges").select("id", "from_id", "to_id", "to_name", "edge_type", "valid_from", F.col("valid_to").alias("_v"), F.col("confidence").alias("_c"))
    now = after.table("symbol_edges")
    return now.groupBy("edge_type").agg(F.count("*").alias("edges")).join(
        was.where("_v IS NULL").join(now.select(F.col("id"), F.col("to_id").alias("_to"), F.col("valid_to").alias("_now")).distinct(), "id").select("id", "edge_type", (F.col("to_id").isNotNull() & F.col("_to").isNull()).alias("lost"), F.col("_now").isNotNull().alias("ended")).distinct()
        .groupBy("edge_type").agg(F.count_if("lost").alias("unresolved"), F.count_if("ended").alias("closed")), "edge_type", "left"
    ).fillna(0, ["unresolved", "closed"])


@query("""WITH a AS (SELECT DISTINCT repo_id, name, id FROM symbol_span WHERE valid_from <= TIMESTAMP '2022-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2022-06-01')), b AS (SELECT DISTINCT repo_id, name, id FROM symbol_span WHERE valid_from <= TIMESTAMP '2023-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2023-06-01')),
x AS (SELECT name, count(*) AS n FROM a GROUP BY 1), y AS (SELECT name, count(*) AS n FROM b GROUP BY 1) SELECT name FROM x FULL JOIN y USING (name) WHERE x.n IS DISTINCT FROM y.n""")
def repo_changed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names whose live count differs between two instants: the ones whose edges must be resolved anew."""
    span = table(spark, d, "symbol_span", "repo_id", "name", "id", "valid_from", "valid_to")
    at = lambda t: span.where(in_force(instant(t))).select("repo_id", "name", "id").distinct()
    return ingest.changed_names(at("2022-06-01 00:00:00"), at("2023-06-01 00:00:00"))


@query("""WITH a AS (SELECT DISTINCT file_path AS path, name, kind FROM symbol_span WHERE valid_from <= TIMESTAMP '2022-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2022-06-01')), b AS (SELECT DISTINCT file_path AS path, name, kind FROM symbol_span WHERE valid_from <= TIMESTAMP '2023-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2023-06-01'))
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def repo_symbol_diff(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "symbol_span", F.col("file_path").alias("path"), "name", "kind", "valid_from", "valid_to")
    return ingest.symbol_diff(*[span.where(in_force(instant(t))).select("path", "name", "kind") for t in ("2022-06-01 00:00:00", "2023-06-01 00:00:00")])
