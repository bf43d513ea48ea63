"""Queries of the temporal algebra over the project's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.text import content_hash
from chronoweave.operators import temporal as op
from chronoweave.operators.integrity import natural_key, surplus, verdict
from chronoweave.sources.tables import table
from chronoweave.streaming.incremental import upsert_latest

T, T0, T1 = "2023-06-01 00:00:00", "2022-03-01 00:00:00", "2022-09-01 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{T}", T).replace("{T0}", T0).replace("{T1}", T1)
        return f

    return add


@query("SELECT DISTINCT id, source_uri, valid_from FROM decision WHERE valid_from <= TIMESTAMP '{T}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{T}')")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return op.as_of(table(spark, d, "decision", "id", "source_uri", "valid_from", "valid_to"), op.instant(T)).select("id", "source_uri", "valid_from").distinct()


@query("""SELECT DISTINCT id, repo_id, adr_id, status FROM adr_document WHERE coalesce(effective_from, valid_from) <= TIMESTAMP '{T}'
AND (coalesce(effective_to, valid_to) IS NULL OR coalesce(effective_to, valid_to) > TIMESTAMP '{T}')""")
def as_of_event_time(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "adr_document", "id", "repo_id", "adr_id", "status", "effective_from", "effective_to", "valid_from", "valid_to")
    return op.as_of_event(rows, op.instant(T)).select("id", "repo_id", "adr_id", "status").distinct()


@query("SELECT DISTINCT id, name, valid_from, valid_to FROM symbol_span WHERE valid_from <= TIMESTAMP '{T1}' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{T0}')")
def overlap_window(spark: SparkSession, d: str) -> DataFrame:
    return op.overlapping(table(spark, d, "symbol_span", "id", "name", "valid_from", "valid_to"), op.instant(T0), op.instant(T1)).distinct()


DIFF = """SELECT kind, change, count(*) AS n FROM (
{}) GROUP BY kind, change"""
_ONE = """SELECT DISTINCT '{k}' AS kind, id, 'added' AS change FROM {k} WHERE valid_from >= TIMESTAMP '{T0}' AND valid_from < TIMESTAMP '{T1}'
UNION ALL SELECT DISTINCT '{k}', id, 'removed' FROM {k} WHERE valid_to >= TIMESTAMP '{T0}' AND valid_to < TIMESTAMP '{T1}'"""


@query(DIFF.format(" UNION ALL ".join(_ONE.replace("{k}", k) for k in ("decision", "adr_document", "symbol_edge"))))
def diff_in_range(spark: SparkSession, d: str) -> DataFrame:
    parts = [op.diff_in_range(table(spark, d, k, "id", "valid_from", "valid_to"), op.instant(T0), op.instant(T1)).select(F.lit(k).alias("kind"), "id", "change").distinct() for k in ("decision", "adr_document", "symbol_edge")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "change").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, source_uri FROM decision WHERE (valid_from >= TIMESTAMP '{T0}' AND valid_from < TIMESTAMP '{T1}') OR (valid_to >= TIMESTAMP '{T0}' AND valid_to < TIMESTAMP '{T1}')")
def changed_in(spark: SparkSession, d: str) -> DataFrame:
    return op.diff_in_range(table(spark, d, "decision", "id", "source_uri", "valid_from", "valid_to"), op.instant(T0), op.instant(T1)).select("id", "source_uri").distinct()


@query("""SELECT repo_id, adr_id, id, status FROM (SELECT DISTINCT repo_id, adr_id, id, status, valid_from, ingested_at FROM adr_document)
QUALIFY row_number() OVER (PARTITION BY repo_id, adr_id ORDER BY valid_from DESC, ingested_at DESC, id DESC) = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "adr_document", "repo_id", "adr_id", "id", "status", "valid_from", "ingested_at")
    return op.latest(rows, ["repo_id", "adr_id"], [F.col("valid_from"), F.col("ingested_at"), F.col("id")]).select("repo_id", "adr_id", "id", "status")


VIEW = """(SELECT d.id, coalesce(d.adr_id, 'episode:' || d.episode_id) AS parent_id, coalesce(d.title, a.title, e.source) AS title, coalesce(a.status, 'episode') AS status,
coalesce(a.repo_id, e.repo_id) AS repo_id, d.source_uri, d.text, d.confidence, d.valid_from, d.valid_to, d.ingested_at, a.effective_from, a.effective_to, e.occurred_at
FROM (SELECT DISTINCT * FROM decision) d LEFT JOIN (SELECT DISTINCT id, title, status, repo_id, effective_from, effective_to FROM adr_document) a ON a.id = d.adr_id
LEFT JOIN (SELECT DISTINCT id, source, repo_id, occurred_at FROM episode) e ON e.id = d.episode_id)"""


def view(spark: SparkSession, d: str) -> DataFrame:
    return op.decision_view(table(spark, d, "decision"), table(spark, d, "adr_document"), table(spark, d, "episode"))


@query(f"SELECT id, parent_id, title, status, repo_id, confidence FROM {VIEW}")
def decision_view(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).select("id", "parent_id", "title", "status", "repo_id", "confidence")


@query(f"""SELECT l.ref_id, v.id, v.title FROM (SELECT DISTINCT decision_uri, ref_id FROM decision_git_link) l JOIN {VIEW} v ON v.source_uri = l.decision_uri
WHERE coalesce(v.effective_from, v.occurred_at, v.valid_from) <= TIMESTAMP '{{T}}' AND (coalesce(v.effective_to, v.valid_to) IS NULL OR coalesce(v.effective_to, v.valid_to) > TIMESTAMP '{{T}}')""")
def decisions_for_refs(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "decision_git_link", F_URI, "ref_id").distinct()
    rows = op.as_of_event(view(spark, d), op.instant(T), ("effective_from", "occurred_at", "valid_from"), ("effective_to", "valid_to"))
    return links.join(rows, F.col("source_uri") == F.col(F_URI)).select("ref_id", "id", "title")


F_URI = "decision_uri"


@query("""SELECT r.id AS repo_id, (SELECT count(DISTINCT id) FROM adr_document a WHERE a.repo_id = r.id) AS documents, (SELECT count(DISTINCT id) FROM symbol_span s WHERE s.repo_id = r.id) AS symbols,
(SELECT count(DISTINCT id) FROM symbol_edge e WHERE e.repo_id = r.id) AS edges, (SELECT count(DISTINCT id) FROM episode e WHERE e.repo_id = r.id) AS episodes FROM repository r""")
def repository_counts(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "repository", "id").withColumnRenamed("id", "repo_id")
    for name, t in (("documents", "adr_document"), ("symbols", "symbol_span"), ("edges", "symbol_edge"), ("episodes", "episode")):
        n = table(spark, d, t, "repo_id", "id").distinct().groupBy("repo_id").agg(F.count("*").alias(name))
        out = out.join(F.broadcast(n), "repo_id", "left").fillna(0, [name])  # one row per repository
    return out


@query("SELECT repo_id, count(DISTINCT id) AS current FROM adr_document WHERE valid_to IS NULL GROUP BY repo_id")
def list_current_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "adr_document", "repo_id", "id", "valid_to").where("valid_to IS NULL").select("repo_id", "id").distinct().groupBy("repo_id").agg(F.count("*").alias("current"))


@query("SELECT repo_id, coalesce(max(CAST(regexp_extract(adr_id, '-(\\d+)$', 1) AS BIGINT)), 0) + 1 AS next_number FROM adr_document WHERE valid_to IS NULL GROUP BY repo_id")
def next_document_number(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("adr_id", r"-(\d+)$", 1).try_cast("long")
    return table(spark, d, "adr_document", "repo_id", "adr_id", "valid_to").where("valid_to IS NULL").groupBy("repo_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).cast("long").alias("next_number"))


@query("""SELECT DISTINCT repo_id, CAST(regexp_extract(adr_id, '-(\\d+)$', 1) AS BIGINT) AS number, arg_max(id, (valid_from, ingested_at, id)) AS id FROM adr_document GROUP BY 1, 2""")
def find_by_number(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "adr_document", "repo_id", "adr_id", "id", "valid_from", "ingested_at").withColumn("number", F.regexp_extract("adr_id", r"-(\d+)$", 1).try_cast("long"))
    return rows.groupBy("repo_id", "number").agg(F.max_by("id", F.struct("valid_from", "ingested_at", "id")).alias("id"))


_STATUS = [("decision", "confidence"), ("adr_document", "date"), ("episode", "source_uri"), ("symbol_span", "valid_to"), ("decision_git_link", "confidence"), ("parsed_adr", "status")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS family, count(DISTINCT id) AS total, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN id END) AS filled, max(ingested_at) AS last_ingested, round(CASE WHEN count(DISTINCT id) = 0 THEN 1.0 ELSE count(DISTINCT CASE WHEN {c} IS NOT NULL THEN id END) / count(DISTINCT id) END, 6) AS coverage FROM {t}" for t, c in _STATUS))
def index_status(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, c in _STATUS:
        rows = table(spark, d, t, "id", c, "ingested_at").groupBy("id").agg(F.max(F.col(c).isNotNull()).alias("has"), F.max("ingested_at").alias("at"))
        total, filled = F.count("*"), F.count_if("has")
        one = rows.agg(total.alias("total"), filled.alias("filled"), F.max("at").alias("last_ingested")).select(
            F.lit(t).alias("family"), "total", "filled", "last_ingested", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("filled") / F.col("total")), 6).alias("coverage")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT concat_ws('|', repo_id, adr_id, title, coalesce(status, ''), printf('%.2f', confidence)) AS fact FROM adr_document")
def declared_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "adr_document", "repo_id", "adr_id", "title", "status", "confidence")
    return rows.select(natural_key(F.col("repo_id"), F.col("adr_id"), F.col("title"), F.col("status"), F.format_string("%.2f", "confidence")).alias("fact")).distinct()


@query("""WITH s AS (SELECT DISTINCT id, source_uri, valid_from, valid_to FROM decision), k AS (SELECT DISTINCT id AS adr FROM adr_document WHERE status = 'superseded'),
c AS (SELECT DISTINCT d.source_uri FROM decision d JOIN k ON k.adr = d.adr_id)
SELECT s.id, s.source_uri, CASE WHEN c.source_uri IS NOT NULL AND s.valid_to IS NULL THEN TIMESTAMP '{T}' ELSE s.valid_to END AS valid_to FROM s LEFT JOIN c USING (source_uri)""")
def close_superseded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision", "id", "source_uri", "adr_id", "valid_from", "valid_to")
    gone = table(spark, d, "adr_document", "id", "status").where("status = 'superseded'").select(F.col("id").alias("adr_id")).distinct()
    keys = rows.join(gone, "adr_id", "left_semi").select("source_uri")
    return op.close(rows.drop("adr_id").distinct(), keys, ["source_uri"], op.instant(T)).select("id", "source_uri", "valid_to")


@query("""SELECT count(*) AS n, count(*) FILTER (fresh) AS appended FROM (SELECT DISTINCT repo_id, adr_id, false AS fresh FROM adr_document
UNION ALL SELECT DISTINCT p.repo_id, p.adr_id, true FROM parsed_adr p WHERE p.adr_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adr_document a WHERE a.repo_id = p.repo_id AND a.adr_id = p.adr_id))""")
def append_absent(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "adr_document", "repo_id", "adr_id").distinct().withColumn("fresh", F.lit(False))
    rows = table(spark, d, "parsed_adr", "repo_id", "adr_id").where("adr_id IS NOT NULL").withColumn("fresh", F.lit(True))
    return op.append_absent(state, rows, ["repo_id", "adr_id"]).agg(F.count("*").alias("n"), F.count_if("fresh").alias("appended"))


@query("""WITH u AS (SELECT source_uri, arg_max(title, (ingested_at, id)) AS title FROM parsed_adr WHERE title IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT id, source_uri, title FROM adr_document)
SELECT s.id, coalesce(u.title, s.title) AS title FROM s LEFT JOIN u USING (source_uri)""")
def patch_titles(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "adr_document", "id", "source_uri", "title").distinct()
    new = table(spark, d, "parsed_adr", "source_uri", "title", "ingested_at", "id").where("title IS NOT NULL").groupBy("source_uri").agg(F.max_by("title", F.struct("ingested_at", "id")).alias("title"))
    return op.patch(state, new, ["source_uri"], ["title"]).select("id", "title")


@query("""WITH best AS (SELECT loser_id, arg_max(survivor_id, (similarity, survivor_id)) AS survivor_id FROM decision_merge WHERE similarity >= CAST(0.95 AS FLOAT) AND loser_id <> survivor_id GROUP BY 1)
SELECT coalesce(b.survivor_id, d.id) AS id, count(*) AS rows_held FROM (SELECT DISTINCT id FROM decision) d LEFT JOIN best b ON b.loser_id = d.id GROUP BY 1""")
def merge_remap(spark: SparkSession, d: str) -> DataFrame:
    merges = table(spark, d, "decision_merge", "loser_id", "survivor_id", "similarity").where((F.col("similarity") >= F.lit(0.95).cast("float")) & (F.col("loser_id") != F.col("survivor_id")))
    best = merges.groupBy("loser_id").agg(F.max_by("survivor_id", F.struct("similarity", "survivor_id")).alias("survivor_id"))
    return op.remap(table(spark, d, "decision", "id").distinct(), best, "id", "loser_id", "survivor_id").groupBy("id").agg(F.count("*").alias("rows_held"))


@query("""WITH e AS (SELECT DISTINCT id FROM episode WHERE source = 'incident'), d AS (SELECT DISTINCT id, source_uri FROM decision WHERE episode_id IN (SELECT id FROM e) AND valid_to IS NULL),
l AS (SELECT DISTINCT id FROM decision_git_link WHERE decision_uri IN (SELECT source_uri FROM d))
SELECT 'decision' AS kind, count(*) AS closed FROM d UNION ALL SELECT 'decision_git_link', count(*) FROM l""")
def retract_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "episode", "id", "source").where("source = 'incident'").select(F.col("id").alias("episode_id")).distinct()
    rows = table(spark, d, "decision", "id", "source_uri", "episode_id", "valid_to").where("valid_to IS NULL").join(gone, "episode_id", "left_semi").select("id", "source_uri").distinct()
    links = table(spark, d, "decision_git_link", "id", "decision_uri").join(rows.select(F.col("source_uri").alias("decision_uri")).distinct(), "decision_uri", "left_semi").select("id").distinct()
    count = lambda df, k: df.agg(F.count("*").alias("closed")).select(F.lit(k).alias("kind"), "closed")
    return count(rows, "decision").unionByName(count(links, "decision_git_link"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) AS remaining FROM {t} WHERE repo_id NOT IN (SELECT id FROM repository WHERE date_order = 'mdy')" for t in ("adr_document", "symbol_span", "symbol_edge", "episode", "parsed_adr")))
def delete_repositories(spark: SparkSession, d: str) -> DataFrame:
    gone = F.broadcast(table(spark, d, "repository", "id", "date_order").where("date_order = 'mdy'").select(F.col("id").alias("repo_id")))  # a fixed table
    out = None
    for t in ("adr_document", "symbol_span", "symbol_edge", "episode", "parsed_adr"):
        one = table(spark, d, t, "repo_id").join(gone, "repo_id", "left_anti").agg(F.count("*").alias("remaining")).select(F.lit(t).alias("kind"), "remaining")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT repo_id || '|' || adr_id AS key, count(DISTINCT id) AS n FROM adr_document GROUP BY 1), b AS (SELECT repo_id || '|' || adr_id AS key, count(DISTINCT id) AS n FROM parsed_adr WHERE adr_id IS NOT NULL GROUP BY 1)
SELECT key, coalesce(a.n, 0) AS in_a, coalesce(b.n, 0) AS in_b FROM a FULL JOIN b USING (key) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_surplus(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", "repo_id", "adr_id").alias("key")
    a = table(spark, d, "adr_document", "repo_id", "adr_id", "id").distinct().select(key)
    b = table(spark, d, "parsed_adr", "repo_id", "adr_id", "id").where("adr_id IS NOT NULL").distinct().select(key)
    return surplus(a, b, "key")


@query("SELECT 'clean' AS verdict, CAST(0 AS BIGINT) AS keys")
def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """The last row per episode, kept from rows before an instant by applying the later ones, against that over all rows."""
    rows = table(spark, d, "episode", "repo_id", "source", "id", "ingested_at").distinct()
    late, order = F.coalesce(F.col("ingested_at") >= op.instant(T), F.lit(False)), ["ingested_at", "repo_id", "source"]
    state = op.latest(rows.where(~late), ["id"], [F.col(c) for c in order])
    kept = upsert_latest(state, rows.where(late), ["id"], order)
    full = rows.groupBy("id").agg(F.max(F.struct(*order)).alias("last")).select("id", "last.*")
    key = natural_key(*[F.col(c) for c in ("id", *order)]).alias("key")
    return verdict(surplus(kept.select(key), full.select(key), "key"))


@query(r"""WITH v AS (SELECT DISTINCT source_uri, sha256(trim(regexp_replace(coalesce(title, '') || ' ' || text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h, valid_from, ingested_at, id FROM decision)
SELECT source_uri, count(DISTINCT h) AS forms, count(*) AS versions FROM v GROUP BY 1""")
def text_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision", "source_uri", "title", "text", "id").distinct()
    h = content_hash(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")))
    return rows.select("source_uri", h.alias("h")).groupBy("source_uri").agg(F.countDistinct("h").alias("forms"), F.count("*").alias("versions"))
