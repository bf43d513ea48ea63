"""Queries of text, retrieval, graph, evidence and rule operators over the project's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import evidence, graph, retrieval, rules
from chronoweave.operators.dedup import exact_groups
from chronoweave.operators.temporal import in_force, instant
from chronoweave.plans.temporal import T, view
from chronoweave.runtime import broadcast_if_small
from chronoweave.sources.tables import table

WORDS = ["ledger", "index", "retry", "partition"]
SINCE = "2024-06-01 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{T}", T).replace("{SINCE}", SINCE)
        return f

    return add


def _tf(c: str) -> str:
    return " + ".join(f"CAST((length({c}) - length(replace({c}, '{w}', ''))) / {len(w)} AS BIGINT)" for w in WORDS)


NORMAL = r"trim(regexp_replace({c}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
BODY = "lower(coalesce(title, '') || ' ' || coalesce(text, ''))"
KEYWORDS = f"(SELECT doc_id, {_tf(BODY)} AS score FROM documents WHERE {_tf(BODY)} > 0 ORDER BY score DESC, doc_id LIMIT 50)"


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_rank(table(spark, d, "documents", "doc_id", "title", "text"), "doc_id", "title", "text", WORDS, 50)


@query(f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {KEYWORDS}")
def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    return _keywords(spark, d)


@query(f"SELECT doc_id, {_tf('low')} AS tf, {' + '.join(f'''CAST(contains(low, '{w}') AS BIGINT)''' for w in WORDS)} AS distinct_terms FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.term_frequency(t, WORDS).alias("tf"), tx.distinct_terms(t, WORDS).alias("distinct_terms"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substring(text, 1, 160) || '…' ELSE text END AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.snippet(F.col("text"), 160).alias("snippet"))


@query(r"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 3)) AS term FROM documents) GROUP BY term")
def title_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "title").select(F.explode(tx.terms(F.col("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256({NORMAL.format(c='text')}) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query(f"""WITH h AS (SELECT DISTINCT doc_id, sha256({NORMAL.format(c='text')}) AS h, created_at FROM documents WHERE text IS NOT NULL)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY created_at NULLS FIRST, doc_id) AS survivor_id, count(*) OVER (PARTITION BY h) AS copies FROM h QUALIFY copies > 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return exact_groups(table(spark, d, "documents", "doc_id", "text", "created_at"), "doc_id", "text", "created_at")


# Written out, not built from the constants of the functions, so that a wrong constant shows.
POLARITY = """CASE WHEN regexp_matches(lower({c}), 'must not|must never|shall not|may not|cannot |can not |never |prohibit|forbidden|disallow|not be allowed') THEN 'must_not'
WHEN regexp_matches(lower({c}), 'must |shall |always |required to|is required|are required|has to |have to ') THEN 'must' END"""


@query(f"SELECT doc_id, {POLARITY.replace('{c}', 'text')} AS polarity FROM documents")
def polarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.polarity(F.col("text")).alias("polarity"))


@query(r"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(upper(text), 'ADR[- ]*([0-9]+)', 1), lambda n: CASE WHEN length(ltrim(n, '0')) > 4 THEN ltrim(n, '0') ELSE lpad(ltrim(n, '0'), 4, '0') END))) AS number FROM documents")
def document_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(tx.document_references(F.col("text"))).alias("number"))


@query(r"""WITH r AS (SELECT doc_id, repo_id, unnest(list_distinct(list_transform(regexp_extract_all(upper(text), 'ADR[- ]*([0-9]+)', 1), lambda n: CASE WHEN length(ltrim(n, '0')) > 4 THEN ltrim(n, '0') ELSE lpad(ltrim(n, '0'), 4, '0') END))) AS number FROM documents)
SELECT DISTINCT r.doc_id, a.adr_id, CAST(0.95 AS DOUBLE) AS confidence FROM r JOIN adr_document a ON a.repo_id = r.repo_id AND regexp_extract(a.adr_id, '([0-9]+)$', 1) = r.number""")
def explicit_links(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "documents", "doc_id", "repo_id", "text").select("doc_id", "repo_id", F.explode(tx.document_references(F.col("text"))).alias("number"))
    docs = table(spark, d, "adr_document", "repo_id", "adr_id").distinct().withColumn("number", F.regexp_extract("adr_id", r"([0-9]+)$", 1))
    return refs.join(docs, ["repo_id", "number"]).select("doc_id", "adr_id", F.lit(0.95).alias("confidence")).distinct()


@query(r"""WITH p AS (SELECT DISTINCT name, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS parts FROM symbol_span),
k AS (SELECT name, list_filter(parts, lambda w: w NOT IN ('service', 'services', 'svc', 'module', 'modules')) AS own, parts FROM p)
SELECT array_to_string(list_transform(CASE WHEN len(own) > 0 THEN own ELSE parts END, lambda w: CASE WHEN strlen(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END), ' ') AS key, count(*) AS names FROM k GROUP BY 1""")
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbol_span", "name").distinct().select(tx.entity_key(F.col("name")).alias("key")).groupBy("key").agg(F.count("*").alias("names"))


VERSIONS = """(SELECT repo_id, adr_id, id, title, lag(title) OVER (PARTITION BY repo_id, adr_id ORDER BY valid_from, ingested_at, id) AS before FROM (SELECT DISTINCT repo_id, adr_id, id, title, valid_from, ingested_at FROM adr_document))"""
TOKENS = "list_distinct(list_filter(string_split(" + NORMAL + ", ' '), lambda w: w <> ''))"
_J = "CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END"


@query(f"""WITH v AS (SELECT id, {NORMAL.format(c='before')} AS o, {NORMAL.format(c='title')} AS n, {TOKENS.format(c='before')} AS x, {TOKENS.format(c='title')} AS y FROM {VERSIONS} WHERE before IS NOT NULL)
SELECT id, CASE WHEN o = n THEN 'unchanged' WHEN contains(n, o) AND o <> '' THEN 'shifted' WHEN {_J} >= 0.6 THEN 'affected' ELSE 'deleted' END AS edit, round({_J}, 6) AS overlap FROM v""")
def edit_classes(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d).select("id", "edit", "overlap")


def _edits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "adr_id").orderBy("valid_from", "ingested_at", "id")
    rows = table(spark, d, "adr_document", "repo_id", "adr_id", "id", "title", "valid_from", "ingested_at").distinct().withColumn("before", F.lag("title").over(w)).where("before IS NOT NULL")
    old, new = F.col("before"), F.col("title")
    return rows.withColumn("edit", evidence.edit_class(old, new)).withColumn("overlap", F.round(tx.jaccard(tx.tokens(old), tx.tokens(new)), 6))


@query("""WITH c AS (SELECT DISTINCT id, source_uri FROM decision), a AS (SELECT DISTINCT id, decision_uri, confidence FROM decision_git_link),
k AS (SELECT c.source_uri, count(a.id) AS n, count(*) FILTER (a.confidence < 0.5) AS s, count(*) FILTER (a.confidence < 0.4) AS lost FROM (SELECT DISTINCT source_uri FROM c) c LEFT JOIN a ON a.decision_uri = c.source_uri GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'unprovable' WHEN s = 0 THEN 'unaffected' WHEN lost = 0 THEN 'affected' ELSE 'unprovable' END AS disposition, count(*) AS claims FROM k GROUP BY 1""")
def freshness_manifest(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "decision", "source_uri")
    anchors = table(spark, d, "decision_git_link", "id", "decision_uri", "confidence").distinct().select(F.col("decision_uri").alias("source_uri"), F.coalesce(F.col("confidence") < 0.5, F.lit(False)).alias("stale"), F.coalesce(F.col("confidence") >= 0.4, F.lit(True)).alias("relocated"))
    return evidence.manifest(evidence.dispositions(claims, anchors, "source_uri"))


@query("""WITH l AS (SELECT DISTINCT * FROM decision_git_link), n AS (SELECT decision_uri, ref_type, max(source_time) AS source_time FROM l GROUP BY 1, 2), r AS (SELECT l.* FROM l JOIN n USING (decision_uri, ref_type, source_time))
SELECT decision_uri, count(*) FILTER (confidence < 0.5) AS stale, count(*) FILTER (confidence < 0.4) AS lost FROM r GROUP BY 1 HAVING stale > 0""")
def drifted_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_git_link", "id", "decision_uri", "ref_type", "confidence", "source_time").distinct()
    rows = rows.withColumn("anchor", F.concat_ws("|", "decision_uri", "ref_type")).withColumn("stale", F.coalesce(F.col("confidence") < 0.5, F.lit(False))).withColumn("relocated", F.coalesce(F.col("confidence") >= 0.4, F.lit(True)))
    return evidence.latest_stale(rows, "anchor", "source_time", "decision_uri")


SENTENCES = r"""(SELECT source_uri, adr_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT source_uri, adr_id, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS s
FROM (SELECT source_uri, max(adr_id) AS adr_id, min(text) AS text FROM decision GROUP BY source_uri)))"""


def _constraints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision", "source_uri", "adr_id", "text").groupBy("source_uri").agg(F.max("adr_id").alias("adr_id"), F.min("text").alias("text"))
    return rules.constraints(rows, "source_uri", "text", ["adr_id"])


@query(f"SELECT * FROM (SELECT source_uri, CAST(n AS INT) AS n, {POLARITY.replace('{c}', 'sentence')} AS polarity FROM {SENTENCES}) WHERE polarity IS NOT NULL")
def constraints(spark: SparkSession, d: str) -> DataFrame:
    return _constraints(spark, d).select("source_uri", "n", "polarity")


_TERMS = r"""list_filter(list_distinct(list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+'), lambda w: strlen(w) > 3)), lambda w: w NOT IN ('must', 'shall', 'should', 'will', 'with', 'that', 'this', 'from',
'into', 'have', 'when', 'then', 'than', 'them', 'they', 'each', 'every', 'always', 'never', 'only', 'over', 'under', 'through', 'directly', 'avoid', 'prohibited', 'forbidden', 'their', 'there', 'these', 'those', 'been', 'being', 'would', 'could', 'about'))"""


@query(r"""WITH d AS (SELECT DISTINCT d.source_uri AS r, coalesce(a.repo_id, e.repo_id) AS g, d.text FROM decision d LEFT JOIN (SELECT DISTINCT id, repo_id FROM adr_document) a ON a.id = d.adr_id LEFT JOIN (SELECT DISTINCT id, repo_id FROM episode) e ON e.id = d.episode_id),
p AS (SELECT g, r, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM d WHERE g IS NOT NULL),
"""
+ f"""c AS (SELECT DISTINCT g, r, r || '#' || n AS c, {POLARITY.replace('{c}', 'sentence')} AS p, {_TERMS} AS t FROM (SELECT g, r, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM p)),
e AS (SELECT g, r, c, p, len(t) AS size, unnest(t) AS term FROM c WHERE p IS NOT NULL)
SELECT a.c AS a, b.c AS b, count(*) AS shared, CAST(0.5 AS DOUBLE) AS confidence FROM e a JOIN e b ON a.g = b.g AND a.term = b.term AND a.r <> b.r
WHERE a.p = 'must' AND b.p = 'must_not' GROUP BY a.c, b.c, a.size, b.size HAVING count(*) >= 2 AND 2 * count(*) >= least(a.size, b.size)""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Across the decisions of a repository, whatever their parents."""
    rows = table(spark, d, "decision", "source_uri", "adr_id", "episode_id", "text").distinct()
    docs = table(spark, d, "adr_document", F.col("id").alias("adr_id"), F.col("repo_id").alias("doc_repo")).distinct()
    episodes = table(spark, d, "episode", F.col("id").alias("episode_id"), F.col("repo_id").alias("ep_repo")).distinct()
    rows = rows.join(docs, "adr_id", "left").join(episodes, "episode_id", "left").select("source_uri", F.coalesce("doc_repo", "ep_repo").alias("repo_id"), "text").where("repo_id IS NOT NULL").distinct()
    return rules.contradictions(rules.constraints(rows, "source_uri", "text", ["repo_id"]), "repo_id", "source_uri")


@query(r"""WITH p AS (SELECT DISTINCT repo_id, adr_id, id, status, valid_to FROM adr_document), s AS (SELECT repo_id, adr_id, unnest(supersedes) AS ref FROM (SELECT DISTINCT repo_id, adr_id, supersedes FROM adr_document)),
e AS (SELECT DISTINCT s.repo_id, s.adr_id AS newer, o.adr_id AS older FROM s JOIN (SELECT DISTINCT repo_id, adr_id FROM p) o ON o.repo_id = s.repo_id AND o.adr_id = s.ref AND o.adr_id <> s.adr_id)
SELECT e.repo_id, e.newer, e.older, count(*) FILTER (p.valid_to IS NULL) AS open_versions, max(p.status) AS status FROM e JOIN p ON p.repo_id = e.repo_id AND p.adr_id = e.older GROUP BY 1, 2, 3""")
def supersession_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "adr_document", "repo_id", "adr_id", "id", "status", "valid_to", "supersedes")
    refs = docs.select("repo_id", F.col("adr_id").alias("newer"), F.explode("supersedes").alias("older")).where("newer <> older").distinct()
    old = docs.select("repo_id", F.col("adr_id").alias("older"), "id", "status", "valid_to").distinct()
    return refs.join(old, ["repo_id", "older"]).groupBy("repo_id", "newer", "older").agg(F.count_if(F.col("valid_to").isNull()).alias("open_versions"), F.max("status").alias("status"))


@query("""WITH d AS (SELECT DISTINCT source_uri FROM decision WHERE valid_to IS NULL), l AS (SELECT decision_uri, max(source_time) AS last FROM decision_git_link GROUP BY 1),
f AS (SELECT source_uri, min(valid_from) AS first FROM decision WHERE valid_to IS NULL GROUP BY 1)
SELECT source_uri, max(c) AS confidence, string_agg(signal, ',' ORDER BY signal) AS signals FROM (
SELECT d.source_uri, 'inactive' AS signal, 0.45 AS c FROM d JOIN l ON l.decision_uri = d.source_uri WHERE l.last < TIMESTAMP '{SINCE}'
UNION ALL SELECT source_uri, 'aged', 0.35 FROM f WHERE first < TIMESTAMP '{SINCE}'
UNION ALL SELECT source_uri, 'unlinked', 0.7 FROM d WHERE NOT EXISTS (SELECT 1 FROM decision_git_link g WHERE g.decision_uri = d.source_uri)) GROUP BY 1""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision", "source_uri", "valid_from", "valid_to").where("valid_to IS NULL")
    links = table(spark, d, "decision_git_link", "decision_uri", "source_time").groupBy(F.col("decision_uri").alias("source_uri")).agg(F.max("source_time").alias("last"))
    first = rows.groupBy("source_uri").agg(F.min("valid_from").alias("first")).join(links, "source_uri", "left")
    return rules.fuse_signals(
        {"inactive": (first.where(F.col("last") < instant(SINCE)), 0.45), "aged": (first.where(F.col("first") < instant(SINCE)), 0.35), "unlinked": (first.where("last IS NULL"), 0.7)}, "source_uri"
    ).withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))


@query("SELECT source_uri FROM (SELECT DISTINCT source_uri FROM decision) d WHERE NOT EXISTS (SELECT 1 FROM decision_git_link l WHERE l.decision_uri = d.source_uri)")
def unlinked_decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision", "source_uri").distinct().join(table(spark, d, "decision_git_link", F.col("decision_uri").alias("source_uri")), "source_uri", "left_anti")


@query("SELECT id FROM (SELECT DISTINCT id FROM symbol_span) s WHERE NOT EXISTS (SELECT 1 FROM symbol_edge e WHERE e.to_id = s.id AND e.valid_to IS NULL) AND NOT EXISTS (SELECT 1 FROM symbol_edge e WHERE e.from_id = s.id AND e.valid_to IS NULL)")
def orphaned_symbols(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "symbol_edge", "from_id", "to_id", "valid_to").where("valid_to IS NULL")
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).where("id IS NOT NULL").distinct()
    return table(spark, d, "symbol_span", "id").distinct().join(ends, "id", "left_anti")


@query("""WITH live AS (SELECT DISTINCT repo_id, file_path FROM symbol_span WHERE valid_to IS NULL), was AS (SELECT DISTINCT repo_id, file_path FROM symbol_span WHERE valid_to IS NOT NULL)
SELECT * FROM was EXCEPT SELECT * FROM live""")
def retired_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbol_span", "repo_id", "file_path", "valid_to")
    return rows.groupBy("repo_id", "file_path").agg(F.max(F.col("valid_to").isNull()).alias("live")).where(~F.col("live")).select("repo_id", "file_path")


@query("SELECT repo_id, name, count(DISTINCT id) AS n FROM symbol_span WHERE valid_to IS NULL GROUP BY 1, 2")
def open_symbol_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbol_span", "repo_id", "name", "id", "valid_to").where("valid_to IS NULL").select("repo_id", "name", "id").distinct().groupBy("repo_id", "name").agg(F.count("*").alias("n"))


@query("""WITH live AS (SELECT DISTINCT repo_id, name, id, file_path FROM symbol_span WHERE valid_to IS NULL),
uniq AS (SELECT repo_id, name, min(id) AS id FROM live GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
infile AS (SELECT repo_id, file_path, name, min(id) AS id FROM live GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1),
e AS (SELECT DISTINCT id AS edge_id, repo_id, from_id, to_name FROM symbol_edge WHERE to_id IS NULL AND to_name <> ''),
f AS (SELECT id, max(file_path) AS file_path FROM live GROUP BY 1)
SELECT e.edge_id, coalesce(i.id, u.id) AS target, CAST(CASE WHEN i.id IS NOT NULL THEN 0.95 WHEN u.id IS NOT NULL THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence,
CASE WHEN i.id IS NOT NULL THEN 'same-file' WHEN u.id IS NOT NULL THEN 'unique-name' ELSE 'unresolved' END AS tier
FROM e LEFT JOIN f ON f.id = e.from_id LEFT JOIN infile i ON i.repo_id = e.repo_id AND i.file_path = f.file_path AND i.name = e.to_name LEFT JOIN uniq u ON u.repo_id = e.repo_id AND u.name = e.to_name""")
def resolution_tiers(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "symbol_span", "repo_id", "name", "id", "file_path", "valid_to").where("valid_to IS NULL").drop("valid_to")
    uniq = graph.unique_by(live, ["repo_id", "name"], "id").select("repo_id", F.col("name").alias("to_name"), F.col("id").alias("u"))
    infile = graph.unique_by(live, ["repo_id", "file_path", "name"], "id").select("repo_id", "file_path", F.col("name").alias("to_name"), F.col("id").alias("i"))
    edges = table(spark, d, "symbol_edge", "id", "repo_id", "from_id", "to_id", "to_name").where("to_id IS NULL AND to_name <> ''").select(F.col("id").alias("edge_id"), "repo_id", "from_id", "to_name").distinct()
    home = live.groupBy(F.col("id").alias("from_id")).agg(F.max("file_path").alias("file_path"))
    found = edges.join(home, "from_id", "left").join(infile, ["repo_id", "file_path", "to_name"], "left").join(uniq, ["repo_id", "to_name"], "left")
    by_file, by_name = F.col("i").isNotNull(), F.col("u").isNotNull()
    return found.select("edge_id", F.coalesce("i", "u").alias("target"), F.when(by_file, 0.95).when(by_name, 0.6).otherwise(0.3).alias("confidence"), F.when(by_file, "same-file").when(by_name, "unique-name").otherwise("unresolved").alias("tier"))


CALLS = "(SELECT DISTINCT from_id AS src, to_id AS dst FROM symbol_edge WHERE edge_type = 'calls' AND to_id IS NOT NULL AND confidence >= 0.5)"
HUB = f"(SELECT src FROM {CALLS} GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbol_edge", "from_id", "to_id", "edge_type", "confidence").where("edge_type = 'calls' AND to_id IS NOT NULL AND confidence >= 0.5").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


@query(f"""WITH RECURSIVE e AS {CALLS}, b AS (SELECT src AS node, 0 AS depth FROM {HUB} UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4)
SELECT node, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node""")
def call_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = _calls(spark, d)
    hub = edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))
    return graph.reachable(edges, hub, 4)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT to_id AS src, from_id AS dst FROM symbol_edge WHERE to_id IS NOT NULL),
h AS (SELECT src AS node FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), b AS (SELECT node, 0 AS depth FROM h UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3)
SELECT node, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node""")
def impact_of(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "symbol_edge", "from_id", "to_id").where("to_id IS NOT NULL").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).distinct()
    hub = edges.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("node"))
    return graph.reachable(edges, hub, 3)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS n FROM i a JOIN i b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2""")
def cochange(spark: SparkSession, d: str) -> DataFrame:
    return graph.cochange(table(spark, d, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


_LP = "SELECT src AS node, arg_min(label, (-n, label)) AS label FROM (SELECT l.src, s.label, count(*) AS n FROM l JOIN {p} s ON s.node = l.dst GROUP BY 1, 2) GROUP BY src"


@query(f"""WITH o AS (SELECT DISTINCT from_id AS a, to_id AS b FROM symbol_edge WHERE to_id IS NOT NULL AND edge_type IN ('calls', 'imports') AND from_id <> to_id), l AS (SELECT a AS src, b AS dst FROM o UNION SELECT b, a FROM o),
s0 AS (SELECT DISTINCT src AS node, src AS label FROM l), {', '.join(f"s{i} AS MATERIALIZED ({_LP.format(p=f's{i - 1}')})" for i in range(1, 21))} SELECT node, label FROM s20""")
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Labels after at most 20 rounds."""
    edges = table(spark, d, "symbol_edge", "from_id", "to_id", "edge_type").where(F.col("edge_type").isin("calls", "imports"))
    return graph.label_propagation(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), 20)


@query("""WITH s AS (SELECT DISTINCT id, repo_id, file_path FROM symbol_span WHERE valid_from <= TIMESTAMP '{T}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T}')),
e AS (SELECT DISTINCT from_id, to_id FROM symbol_edge WHERE to_id IS NOT NULL AND valid_from <= TIMESTAMP '{T}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T}'))
SELECT DISTINCT b.repo_id, b.file_path AS callee, a.file_path AS caller FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE a.file_path <> b.file_path""")
def caller_files(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "symbol_span", "id", "repo_id", "file_path", "valid_from", "valid_to").where(in_force(instant(T))).select("id", "repo_id", "file_path").distinct()
    edges = table(spark, d, "symbol_edge", "from_id", "to_id", "valid_from", "valid_to").where(F.col("to_id").isNotNull() & in_force(instant(T))).select("from_id", "to_id").distinct()
    a, b = spans.select(F.col("id").alias("from_id"), F.col("file_path").alias("caller")), spans.select(F.col("id").alias("to_id"), "repo_id", F.col("file_path").alias("callee"))
    return edges.join(a, "from_id").join(b, "to_id").where("caller <> callee").select("repo_id", "callee", "caller").distinct()


@query("""SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'decision' AS kind, source_uri AS node FROM decision UNION ALL SELECT DISTINCT 'document', repo_id || '|' || adr_id FROM adr_document
UNION ALL SELECT DISTINCT 'symbol', id FROM symbol_span UNION ALL SELECT DISTINCT 'ref', ref_id FROM decision_git_link UNION ALL SELECT DISTINCT 'episode', id FROM episode) GROUP BY 1""")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    parts = [
        graph.node_rows(table(spark, d, "decision", "source_uri"), "decision", F.col("source_uri"), none),
        graph.node_rows(table(spark, d, "adr_document", "repo_id", "adr_id"), "document", F.concat_ws("|", "repo_id", "adr_id"), none),
        graph.node_rows(table(spark, d, "symbol_span", "id"), "symbol", F.col("id"), none),
        graph.node_rows(table(spark, d, "decision_git_link", "ref_id"), "ref", F.col("ref_id"), none),
        graph.node_rows(table(spark, d, "episode", "id"), "episode", F.col("id"), none),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT id, repo_id, file_path, valid_from, coalesce(valid_to, TIMESTAMP '9999-12-31') AS u FROM symbol_span)
SELECT count(*) AS pairs, count(DISTINCT o.id) AS outers FROM s o JOIN s i ON o.repo_id = i.repo_id AND o.file_path = i.file_path AND o.valid_from < i.valid_from AND o.u >= i.u""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbol_span", "id", "repo_id", "file_path", "valid_from", "valid_to").distinct().withColumn("u", F.coalesce("valid_to", instant("9999-12-31 00:00:00")))
    return graph.contained(rows, ["repo_id", "file_path"], "valid_from", "u", "id").agg(F.count("*").alias("pairs"), F.countDistinct("outer_id").alias("outers"))


NEAR = "(SELECT q.vec_id AS query, v.vec_id AS hit, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)"


def _search(spark: SparkSession, d: str, threshold: float, best: int | None = None) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return retrieval.cosine_search(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", threshold, best)


@query(f"SELECT query, hit, round(c, 6) AS cosine FROM {NEAR} WHERE c >= 0.3")
def semantic_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 0.3).select("query", "hit", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY c DESC, hit) AS rank FROM {NEAR} QUALIFY rank <= 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(_search(spark, d, -1.0, 10), 10).select("query", "hit", "rank")


_LISTS = f"""SELECT 'keyword' AS list, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {_tf(BODY)} AS score FROM documents) WHERE score > 0
UNION ALL SELECT 'newest', doc_id, row_number() OVER (ORDER BY created_at DESC, doc_id) FROM documents WHERE created_at IS NOT NULL UNION ALL SELECT 'longest', doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents WHERE n_chars IS NOT NULL"""


def _lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Whole ranked lists."""
    docs = table(spark, d, "documents", "doc_id", "created_at", "n_chars")
    whole = lambda df, c: retrieval.ranked_whole(df.where(F.col(c).isNotNull()).select("doc_id", c), [F.desc(c), F.col("doc_id")])
    words = retrieval.keyword_scores(table(spark, d, "documents", "doc_id", "title", "text"), "doc_id", "title", "text", WORDS)
    return {"keyword": whole(words, "score"), "newest": whole(docs, "created_at"), "longest": whole(docs, "n_chars")}


@query(f"SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(list, ',' ORDER BY list) AS found_by FROM ({_LISTS}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_lists(spark, d), "doc_id", 40)


@query(f"SELECT list AS step, doc_id, rank FROM ({_LISTS})")
def explain_steps(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.explain(_lists(spark, d), "doc_id")


@query(f"""WITH RECURSIVE hit AS (SELECT doc_id, repo_id FROM documents WHERE doc_id IN (SELECT doc_id FROM {KEYWORDS} ORDER BY score DESC, doc_id LIMIT 5)) SELECT DISTINCT d.doc_id, d.repo_id FROM documents d JOIN hit h ON h.repo_id = d.repo_id AND d.doc_id <> h.doc_id WHERE d.source = 'adr'""")
def seed_expansion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "repo_id", "source")
    seeds = _keywords(spark, d).where("rank <= 5").select("doc_id").join(docs, "doc_id").select(F.col("doc_id").alias("seed"), "repo_id")
    return docs.where("source = 'adr'").join(F.broadcast(seeds), "repo_id").where("doc_id <> seed").select("doc_id", "repo_id").distinct()  # five rows


@query("""WITH v AS (SELECT * FROM (SELECT DISTINCT id, source_uri, valid_from, valid_to FROM decision))
SELECT source_uri AS entity, 'activated' AS event, min(valid_from) AS t FROM v GROUP BY 1 UNION ALL SELECT source_uri, 'closed', max(valid_to) FROM v WHERE valid_to IS NOT NULL GROUP BY 1
UNION ALL SELECT decision_uri, 'referenced', min(source_time) FROM decision_git_link GROUP BY 1""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision", F.col("source_uri").alias("entity"), "valid_from", "valid_to")
    links = table(spark, d, "decision_git_link", F.col("decision_uri").alias("entity"), "source_time")
    one = lambda df, name, t: df.groupBy("entity").agg(t.alias("t")).select("entity", F.lit(name).alias("event"), "t")
    return one(rows, "activated", F.min("valid_from")).unionByName(one(rows.where("valid_to IS NOT NULL"), "closed", F.max("valid_to"))).unionByName(one(links, "referenced", F.min("source_time")))


@query("""WITH d AS (SELECT DISTINCT id, source_uri, repo_id, status FROM (SELECT d.id, d.source_uri, coalesce(a.repo_id, e.repo_id) AS repo_id, coalesce(a.status, 'episode') AS status FROM (SELECT DISTINCT id, source_uri, adr_id, episode_id FROM decision) d
LEFT JOIN (SELECT DISTINCT id, repo_id, status FROM adr_document) a ON a.id = d.adr_id LEFT JOIN (SELECT DISTINCT id, repo_id FROM episode) e ON e.id = d.episode_id))
SELECT r.name AS repository, d.status, count(DISTINCT d.source_uri) AS decisions FROM d JOIN repository r ON r.id = d.repo_id GROUP BY 1, 2""")
def architecture(spark: SparkSession, d: str) -> DataFrame:
    repos = broadcast_if_small(table(spark, d, "repository", F.col("id").alias("repo_id"), F.col("name").alias("repository")), 64)
    return view(spark, d).join(repos, "repo_id").groupBy("repository", "status").agg(F.countDistinct("source_uri").alias("decisions"))
