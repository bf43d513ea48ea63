"""Equivalent SQL of the problems' queries."""

NUMBER = r"nullif(regexp_replace(regexp_extract(CASE WHEN regexp_matches({0}, '^\s*\[[^\]]*\]\(') THEN regexp_extract({0}, '^\s*\[([^\]]*)\]', 1) WHEN {0} LIKE '%/%' THEN regexp_extract({0}, '([^/]*)/?\s*$', 1) ELSE {0} END, '[0-9]+'), '^0+([0-9])', '\1'), '')"


def _number(c: str) -> str:
    return NUMBER.replace("{0}", c)


P1 = f"""
WITH RECURSIVE doc AS (SELECT DISTINCT repo_id, adr_id, supersedes, superseded_by FROM adr_document WHERE repo_id IS NOT NULL AND adr_id IS NOT NULL),
node AS (SELECT repo_id, {_number('adr_id')} AS n, min(adr_id) AS name FROM doc GROUP BY 1, 2),
ref AS (
  SELECT repo_id, {_number('r')} AS child, {_number('adr_id')} AS parent FROM (SELECT repo_id, adr_id, unnest(supersedes) AS r FROM doc)
  UNION SELECT repo_id, {_number('adr_id')}, {_number('superseded_by')} FROM doc),
link AS (
  SELECT r.repo_id, r.child, arg_min(r.parent, p.name) AS parent FROM ref r
  JOIN node p ON p.repo_id = r.repo_id AND p.n = r.parent JOIN node c ON c.repo_id = r.repo_id AND c.n = r.child GROUP BY 1, 2),
linked AS (SELECT repo_id, child AS n FROM link UNION SELECT repo_id, parent FROM link),
tree AS (
  SELECT l.repo_id, l.n, e.name AS name, e.name AS root, 0 AS depth, e.name AS path FROM linked l JOIN node e USING (repo_id, n)
  WHERE NOT EXISTS (SELECT 1 FROM link k WHERE k.repo_id = l.repo_id AND k.child = l.n)
  UNION ALL
  SELECT k.repo_id, k.child, e.name, t.root, t.depth + 1, t.path || '/' || e.name FROM tree t
  JOIN link k ON k.repo_id = t.repo_id AND k.parent = t.n JOIN node e ON e.repo_id = k.repo_id AND e.n = k.child),
rest AS (SELECT repo_id, n FROM linked EXCEPT SELECT repo_id, n FROM tree),
walk AS (
  SELECT repo_id, n AS start, n AS at FROM rest
  UNION SELECT w.repo_id, w.start, k.parent FROM walk w JOIN link k ON k.repo_id = w.repo_id AND k.child = w.at),
ring AS (SELECT DISTINCT w.repo_id, w.start AS n FROM walk w JOIN link k ON k.repo_id = w.repo_id AND k.child = w.at AND k.parent = w.start),
low AS (SELECT w.repo_id, w.start AS n, min(e.name) AS root FROM walk w JOIN ring r ON r.repo_id = w.repo_id AND r.n = w.at JOIN node e ON e.repo_id = w.repo_id AND e.n = w.at GROUP BY 1, 2)
SELECT repo_id, name AS adr_id, root AS root_adr_id, CAST(depth AS BIGINT) AS depth, path FROM tree
UNION ALL
SELECT l.repo_id, e.name, l.root, CAST(CASE WHEN r.n IS NULL THEN -2 ELSE -1 END AS BIGINT), '' FROM low l
JOIN node e ON e.repo_id = l.repo_id AND e.n = l.n LEFT JOIN ring r ON r.repo_id = l.repo_id AND r.n = l.n
"""

P2 = """
WITH d AS (SELECT DISTINCT id, source_uri, valid_from, valid_to, ingested_at FROM decision),
l AS (SELECT DISTINCT id, decision_uri, source_time FROM decision_git_link),
known AS (
  SELECT l.id AS link_id, l.source_time, d.* FROM l JOIN d ON d.source_uri = l.decision_uri AND d.ingested_at <= l.source_time
  QUALIFY row_number() OVER (PARTITION BY l.id, d.valid_from ORDER BY d.ingested_at DESC, d.id DESC) = 1)
SELECT link_id, id AS decision_id FROM known
WHERE valid_from <= source_time AND (valid_to IS NULL OR source_time < valid_to)
QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY valid_from DESC) = 1
"""

P6 = """
WITH counted AS (
  SELECT DISTINCT id, name, valid_from, valid_to, ingested_at FROM symbol_span WHERE id IS NOT NULL AND valid_from IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, valid_from ORDER BY ingested_at DESC NULLS LAST, valid_to DESC NULLS FIRST, name DESC NULLS LAST) = 1),
held AS (SELECT id, name, valid_from AS f, least(valid_to, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from)) AS u FROM counted),
kept AS (SELECT * FROM held WHERE u IS NULL OR u > f),
marked AS (SELECT *, CASE WHEN lag(name) OVER w IS NOT DISTINCT FROM name AND lag(u) OVER w = f THEN 0 ELSE 1 END AS starts FROM kept WINDOW w AS (PARTITION BY id ORDER BY f)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY f) AS v FROM marked)
SELECT id, min(name) AS name, epoch_us(min(f)) AS valid_from_us, coalesce(epoch_us(arg_max(u, f)), -1) AS valid_to_us FROM
(SELECT id, v, name, f, coalesce(u, NULL) AS u FROM numbered) GROUP BY id, v
"""
P6 = P6.replace("coalesce(epoch_us(arg_max(u, f)), -1)", "CASE WHEN bool_or(u IS NULL) THEN -1 ELSE epoch_us(max(u)) END").replace("(SELECT id, v, name, f, coalesce(u, NULL) AS u FROM numbered)", "numbered")

P7 = """
WITH ref AS (
  SELECT DISTINCT 'symbol_edge' AS src_table, 'to_id' AS src_field, id AS row_id, to_id AS key, valid_from AS t FROM symbol_edge WHERE to_id IS NOT NULL
  UNION SELECT 'symbol_edge', 'to_name', id, concat_ws('|', repo_id, to_name), valid_from FROM symbol_edge WHERE to_id IS NULL AND to_name <> '' AND repo_id IS NOT NULL
  UNION SELECT 'decision', 'adr_id', id, adr_id, valid_from FROM decision WHERE adr_id IS NOT NULL
  UNION SELECT 'decision', 'episode_id', id, episode_id, valid_from FROM decision WHERE episode_id IS NOT NULL),
target AS (
  SELECT DISTINCT 'to_id' AS src_field, id AS key, valid_from AS f, valid_to AS u FROM symbol_span
  UNION SELECT 'to_name', concat_ws('|', repo_id, name), valid_from, valid_to FROM symbol_span WHERE repo_id IS NOT NULL AND name IS NOT NULL
  UNION SELECT 'adr_id', id, valid_from, valid_to FROM adr_document
  UNION SELECT 'episode_id', id, occurred_at, NULL FROM episode)
SELECT r.src_table, r.src_field, r.row_id, CASE WHEN count(g.key) = 0 THEN 'missing' WHEN count(*) FILTER (g.f <= r.t) = 0 THEN 'late' ELSE 'deleted' END AS kind, strftime(r.t, '%Y-%m') AS period
FROM ref r LEFT JOIN target g ON g.src_field = r.src_field AND g.key = r.key AND g.f IS NOT NULL
WHERE r.t IS NOT NULL
GROUP BY r.src_table, r.src_field, r.row_id, r.key, r.t
HAVING coalesce(count(*) FILTER (g.f <= r.t AND (g.u IS NULL OR r.t < g.u)), 0) = 0
"""

P6_ATTRIBUTES = """
WITH counted AS (
  SELECT DISTINCT id, name, kind, file_path, valid_from, valid_to, ingested_at FROM symbol_span WHERE id IS NOT NULL AND valid_from IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, valid_from ORDER BY ingested_at DESC NULLS LAST, valid_to DESC NULLS FIRST, name DESC NULLS LAST, kind DESC NULLS LAST, file_path DESC NULLS LAST) = 1),
held AS (SELECT *, least(valid_to, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from)) AS u FROM counted),
kept AS (SELECT * FROM held WHERE u IS NULL OR u > valid_from),
marked AS (
  SELECT *, CASE WHEN lag(name) OVER w IS NOT DISTINCT FROM name AND lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(file_path) OVER w IS NOT DISTINCT FROM file_path AND lag(u) OVER w = valid_from THEN 0 ELSE 1 END AS starts
  FROM kept WINDOW w AS (PARTITION BY id ORDER BY valid_from)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY valid_from) AS v FROM marked)
SELECT id, min(name) AS name, min(kind) AS kind, min(file_path) AS file_path, epoch_us(min(valid_from)) AS valid_from_us, CASE WHEN bool_or(u IS NULL) THEN -1 ELSE epoch_us(max(u)) END AS valid_to_us FROM numbered GROUP BY id, v
"""

P7_CURRENT = """
WITH ref AS (
  SELECT DISTINCT 'to_id' AS field, to_id AS key, id, valid_from AS f, valid_to AS u FROM symbol_edge WHERE to_id IS NOT NULL
  UNION SELECT 'to_name', concat_ws('|', repo_id, to_name), id, valid_from, valid_to FROM symbol_edge WHERE to_id IS NULL AND to_name <> '' AND repo_id IS NOT NULL
  UNION SELECT 'adr_id', adr_id, id, valid_from, valid_to FROM decision WHERE adr_id IS NOT NULL
  UNION SELECT 'episode_id', episode_id, id, valid_from, valid_to FROM decision WHERE episode_id IS NOT NULL),
target AS (
  SELECT 'to_id' AS field, id AS key, valid_from AS f, valid_to AS u FROM symbol_span
  UNION ALL SELECT 'to_name', concat_ws('|', repo_id, name), valid_from, valid_to FROM symbol_span WHERE repo_id IS NOT NULL AND name IS NOT NULL
  UNION ALL SELECT 'adr_id', id, valid_from, valid_to FROM adr_document
  UNION ALL SELECT 'episode_id', id, occurred_at, NULL FROM episode),
open_ref AS (SELECT field, key, count(*) AS refs FROM ref WHERE f <= TIMESTAMP '2024-06-01' AND (u IS NULL OR u > TIMESTAMP '2024-06-01') GROUP BY 1, 2),
begun AS (SELECT field, key, bool_or(u IS NULL OR u > TIMESTAMP '2024-06-01') AS alive FROM target WHERE f <= TIMESTAMP '2024-06-01' GROUP BY 1, 2)
SELECT r.field, r.key, r.refs, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'deleted' END AS kind FROM open_ref r LEFT JOIN begun b USING (field, key) WHERE NOT coalesce(b.alive, false)
"""

SQL = {
    "p1_found": P1,
    "p2_found": P2,
    "p6_found": P6,
    "p6_attributes": P6_ATTRIBUTES,
    "p7_found": P7,
    "p7_current": P7_CURRENT,
    "p7_report": f"SELECT src_table, src_field, period, kind, count(*) AS orphans FROM ({P7}) GROUP BY ALL",
}
