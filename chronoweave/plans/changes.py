"""The write algebra: every change takes a store and gives the store after it.

Nothing is changed in place: appends, closings and patches are joins over whole tables, so a batch
of any number of rows is one change. ``t`` is the instant of the change as text. Keys come as
frames. Counts of what a change closes are read from ``closed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.temporal import instant
from chronoweave.plans.store import Store, first_by, semi
from chronoweave.sources.schema import COLUMNS, schema


def rows_of(store: Store, name: str, rows: DataFrame) -> DataFrame:
    """Rows in the table's schema: missing columns are null, others are left out."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def key_id(*parts: str) -> Column:
    """A deterministic id from a natural key, so that a change applied again gives the same rows."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def append(store: Store, name: str, rows: DataFrame) -> Store:
    return store.with_tables(**{name: store.table(name).unionByName(rows_of(store, name, rows))})


def append_new(store: Store, name: str, rows: DataFrame, on: Sequence[str], open_only: bool = False) -> Store:
    """Rows whose key no row (with ``open_only`` no open row) has; of several with one key the smallest."""
    new = rows_of(store, name, rows)
    rest = [c for c in new.columns if c not in on]
    one = new.groupBy(*on).agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("_r")).select(*on, "_r.*").select(*new.columns)
    old = store.open(name) if open_only else store.table(name)
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in on])
    return store.with_tables(**{name: store.table(name).unionByName(one.alias("n").join(old.select(*on).distinct().alias("o"), same, "left_anti"))})


def _marked(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    keys = ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(keys, column, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).select(*df.columns, "_hit")


def close(store: Store, name: str, column: str, ids: DataFrame, t: str, *, open_only: bool = True, where: Column | None = None) -> Store:
    """Sets ``valid_to`` of the rows whose ``column`` is among ``ids``; closed rows keep theirs unless told otherwise."""
    rows = store.table(name)
    marked = _marked(rows, column, ids)
    rule = F.col("_hit") & (F.lit(True) if where is None else where)
    rule = rule & F.col("valid_to").isNull() if open_only else rule
    return store.with_tables(**{name: marked.withColumn("valid_to", F.when(rule, instant(t)).otherwise(F.col("valid_to"))).select(*rows.columns)})


def close_where(store: Store, name: str, where: Column, t: str) -> Store:
    rows = store.table(name)
    return store.with_tables(**{name: rows.withColumn("valid_to", F.when(F.coalesce(where, F.lit(False)) & F.col("valid_to").isNull(), instant(t)).otherwise(F.col("valid_to")))})


def patch(store: Store, name: str, rows: DataFrame, on: Sequence[str], columns: Sequence[str], keep_old: bool = True) -> Store:
    """Columns taken from ``rows`` by key; with ``keep_old`` nulls there leave the old value. Of several rows with one key the largest values count."""
    old = store.table(name)
    new = rows.groupBy(*on).agg(F.max(F.struct(*[F.col(c) for c in columns])).alias("_new"))
    out = old.join(new, list(on), "left")
    for c in columns:
        fresh = F.coalesce(F.col(f"_new.{c}"), F.col(c)) if keep_old else F.col(f"_new.{c}")
        out = out.withColumn(c, F.when(F.col("_new").isNull(), F.col(c)).otherwise(fresh))
    return store.with_tables(**{name: out.select(*old.columns)})


def closed(before: Store, after: Store, names: Sequence[str]) -> DataFrame:
    """(kind, closed): rows of each table that a change closed."""
    parts = [before.open(n).select("id").join(after.open(n).select("id"), "id", "left_anti").agg(F.count("*").alias("closed")).select(F.lit(n).alias("kind"), "closed") for n in names]
    return reduce(DataFrame.unionByName, parts)


# repositories
def upsert_repository(store: Store, rows: DataFrame) -> Store:
    """Repositories (path, name, ingested_at) whose path isn't known; the long-path mark is taken off."""
    clean = rows.withColumn("path", F.regexp_replace("path", r"^\\\\\?\\", "")).withColumn("id", key_id("path"))
    return append_new(store, "repositories", clean, ["path"])


def delete_repository(store: Store, repo_id: str) -> Store:
    """All that belongs to a repository, over all tables: what names it, then what hangs from that."""
    this = store.spark.createDataFrame([(repo_id,)], "id string")
    out = {n: store.table(n).where(~F.col("repo_id").eqNullSafe(F.lit(repo_id))) for n, c in COLUMNS.items() if "repo_id " in c}
    out["repositories"] = store.table("repositories").where(F.col("id") != repo_id)
    owned = lambda n: semi(store.table(n), "repo_id", this).select("id")
    view = store.decision_view().where(F.col("repo_id") == repo_id).select("id")
    anti = lambda n, column, ids: out.get(n, store.table(n)).join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*store.table(n).columns)
    symbols = semi(store.table("symbols"), "file_id", owned("files")).select("id")
    constraints = semi(store.table("constraints"), "decision_id", view).select("id")
    out["decisions"] = anti("decisions", "id", view)
    out["constraints"], out["decision_code_links"], out["decision_git_links"] = (anti(n, "decision_id", view) for n in ("constraints", "decision_code_links", "decision_git_links"))
    out["symbols"], out["file_imports"] = anti("symbols", "file_id", owned("files")), anti("file_imports", "file_id", owned("files"))
    out["community_members"] = anti("community_members", "community_id", owned("communities"))
    out["commit_files"] = anti("commit_files", "commit_id", owned("commits"))
    out["evidence_verifications"] = anti("evidence_verifications", "anchor_id", owned("evidence_anchors"))
    out["supersession_edges"] = anti("supersession_edges", "superseder_id", owned("adr_documents"))
    # edges between things of any kind name no repository: they go with either end
    ids = reduce(DataFrame.unionByName, [view, constraints, symbols, *[owned(n) for n in ("adr_documents", "episodes", "commits", "pull_requests", "entity_nodes", "files")]])
    edges = store.table("temporal_edges")
    out["temporal_edges"] = edges.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti").select(*edges.columns)
    return store.with_tables(**out)


# documents, decisions, constraints
def insert_adr(store: Store, rows: DataFrame) -> Store:
    return append(store, "adr_documents", rows)


def insert_decision(store: Store, rows: DataFrame) -> Store:
    """Decisions with exactly one parent, document or episode; others are refused."""
    bad = rows.where(F.col("adr_id").isNull() == F.col("episode_id").isNull())
    if not bad.isEmpty():
        raise ValueError("a decision has exactly one parent: a document or an episode")
    return append(store, "decisions", rows)


def insert_constraint(store: Store, rows: DataFrame) -> Store:
    return append(store, "constraints", rows)


def insert_decision_code_link(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "decision_code_links", rows, ["id"])


def upsert_supersession_edge(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "supersession_edges", rows, ["superseder_id", "superseded_id"])


def close_adr(store: Store, ids: DataFrame, t: str) -> Store:
    return close(store, "adr_documents", "id", ids, t, open_only=False)


def close_decisions_for_adr(store: Store, document_ids: DataFrame, t: str) -> Store:
    """Closes what hangs from documents: constraints, claims, links, edges, decisions. Constraints and
    decisions closed before get the new end too; the rest keeps its own."""
    own = semi(store.table("decisions"), "adr_id", document_ids).select("id")
    rules = semi(store.table("constraints"), "decision_id", own).select("id")
    claims = store.claim_ids_for_decisions(own)
    out = close(store, "constraints", "id", rules, t, open_only=False)
    out = close(out, "claims", "id", claims, t)
    out = close(out, "decision_code_links", "decision_id", own, t)
    out = close(out, "temporal_edges", "source_id", own, t, where=F.col("edge_type").isin("imposes", "mentions"))
    out = close(out, "temporal_edges", "target_id", own, t, where=F.col("edge_type") == "defines")
    return close(out, "decisions", "id", own, t, open_only=False)


def merge_decision_into(store: Store, merges: DataFrame, t: str) -> Store:
    """Folds decisions (loser_id, survivor_id, episode_id, similarity) into others.

    The episode supports the survivor; constraints the survivor lacks by their text move with their
    edges; links to paths and references the survivor lacks move, the others are closed; other
    edges are repointed unless the survivor has them; what is left of the loser is closed.
    A chain of merges ends at its last survivor.
    """
    from chronoweave.operators.merging import last_survivors

    m = last_survivors(merges.select("loser_id", "survivor_id")).join(merges.groupBy("loser_id").agg(F.min("episode_id").alias("episode_id"), F.max("similarity").alias("similarity")), "loser_id")
    pair = m.select("loser_id", "survivor_id")
    losers = m.select(F.col("loser_id").alias("id"))
    support = m.select(
        F.lit("supports").alias("edge_type"), F.col("episode_id").alias("source_id"), F.lit("episode").alias("source_type"), F.col("survivor_id").alias("target_id"), F.lit("decision").alias("target_type"),
        instant(t).alias("valid_from"), instant(t).alias("ingested_at"), F.col("similarity").alias("confidence"), F.array("episode_id").alias("evidence_refs"),
    ).where("source_id IS NOT NULL").withColumn("id", key_id("edge_type", "source_id", "target_id"))
    out = insert_temporal_edge_if_absent(store, support)

    def moved(name: str, column: str, same: Sequence[Column], where: Column | None = None) -> DataFrame:
        """The table with open rows of losers given to their survivor, unless it has one alike; one of each kind moves."""
        rows = out.table(name)
        live = F.col("valid_to").isNull() & (F.lit(True) if where is None else where)
        tagged = rows.withColumn("_what", F.to_json(F.array(*[c.cast("string") for c in same])))
        have = tagged.where(live).select(F.col(column).alias("survivor_id"), "_what").distinct().withColumn("_has", F.lit(True))
        mine = tagged.where(live).select("id", F.col(column).alias("loser_id"), "_what").join(pair, "loser_id").join(have, ["survivor_id", "_what"], "left").where("_has IS NULL")
        go = first_by(mine, ["survivor_id", "_what"], F.col("id")).select("id", F.col("survivor_id").alias("_to"))
        return rows.join(go, "id", "left").withColumn(column, F.coalesce("_to", column)).select(*rows.columns)

    rules = moved("constraints", "decision_id", [F.expr("trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' '))")])
    shifted = rules.select(F.col("id").alias("target_id"), F.col("decision_id").alias("_to")).join(out.table("constraints").select(F.col("id").alias("target_id"), F.col("decision_id").alias("source_id")), "target_id").where("_to <> source_id")
    edges = out.table("temporal_edges")
    edges = edges.join(shifted, ["source_id", "target_id"], "left").withColumn("source_id", F.when((F.col("edge_type") == "imposes") & F.col("valid_to").isNull(), F.coalesce("_to", "source_id")).otherwise(F.col("source_id"))).select(*edges.columns)
    out = out.with_tables(constraints=rules, temporal_edges=edges)
    out = out.with_tables(decision_code_links=moved("decision_code_links", "decision_id", [F.col("file_path")]))
    out = out.with_tables(decision_git_links=moved("decision_git_links", "decision_id", [F.col(c) for c in ("ref_type", "ref_id", "link_source")]))
    out = close(close(out, "decision_code_links", "decision_id", losers, t), "decision_git_links", "decision_id", losers, t)
    other = F.col("edge_type") != "imposes"
    out = out.with_tables(temporal_edges=moved("temporal_edges", "target_id", [F.col("edge_type"), F.col("source_id")], other & (F.col("target_type") == "decision")))
    out = out.with_tables(temporal_edges=moved("temporal_edges", "source_id", [F.col("edge_type"), F.col("target_id")], other & (F.col("source_type") == "decision")))
    out = close(out, "temporal_edges", "target_id", losers, t, where=F.col("target_type") == "decision")
    out = close(out, "temporal_edges", "source_id", losers, t, where=F.col("source_type") == "decision")
    return retract_decision(out, losers, t)


# episodes and edges
def insert_episode(store: Store, rows: DataFrame) -> Store:
    return append(store, "episodes", rows)


def insert_retraction_episode(store: Store, target: str, reason: str, t: str) -> Store:
    """The audit row of a retraction; it belongs to no repository."""
    row = store.spark.createDataFrame([("retraction", f"retract:{target}", reason)], "source string, source_uri string, content string")
    return append(store, "episodes", row.withColumn("occurred_at", instant(t)).withColumn("ingested_at", instant(t)).withColumn("confidence", F.lit(1.0)).withColumn("id", key_id("source", "source_uri", "occurred_at")))


def insert_temporal_edge(store: Store, rows: DataFrame) -> Store:
    return append(store, "temporal_edges", rows)


insert_test_temporal_edge = insert_temporal_edge


def insert_temporal_edge_if_absent(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "temporal_edges", rows, ["edge_type", "source_id", "target_id"], open_only=True)


# files and symbols
def upsert_file(store: Store, rows: DataFrame, t: str) -> Store:
    """Files (repo_id, path): new ones are added, closed ones that are there again are opened anew."""
    old = store.table("files")
    seen = rows.select("repo_id", "path").distinct().withColumn("_seen", F.lit(True))
    back = F.col("_seen").isNotNull() & F.col("valid_to").isNotNull()
    patched = old.join(seen, ["repo_id", "path"], "left").withColumn("valid_from", F.when(back, instant(t)).otherwise(F.col("valid_from"))).withColumn("ingested_at", F.when(back, instant(t)).otherwise(F.col("ingested_at")))
    patched = patched.withColumn("valid_to", F.when(back, F.lit(None)).otherwise(F.col("valid_to"))).select(*old.columns)
    new = seen.drop("_seen").withColumn("id", key_id("repo_id", "path")).withColumn("valid_from", instant(t)).withColumn("ingested_at", instant(t))
    return append_new(store.with_tables(files=patched), "files", new, ["repo_id", "path"])


def update_file_content_hash(store: Store, rows: DataFrame) -> Store:
    return patch(store, "files", rows, ["id"], ["content_hash"])


SYMBOL_SPAN = ("line", "end_line", "signature", "return_type", "visibility", "is_async", "complexity", "decorators")


def insert_symbol(store: Store, rows: DataFrame, t: str) -> Store:
    """Symbols by (file_id, name, kind): an open one takes the new span and signature, others are added."""
    keys = ["file_id", "name", "kind"]
    new = rows_of(store, "symbols", rows).withColumn("id", key_id(*keys, "line")).withColumn("valid_from", instant(t)).withColumn("ingested_at", instant(t)).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    one = first_by(new, keys, F.col("line"), F.col("id"))
    old = store.table("symbols")
    latest = one.select(*keys, F.struct(*[F.col(c) for c in SYMBOL_SPAN]).alias("_new"))
    out = old.join(latest, keys, "left")
    for c in SYMBOL_SPAN:
        out = out.withColumn(c, F.when(F.col("_new").isNotNull() & F.col("valid_to").isNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return append_new(store.with_tables(symbols=out.select(*old.columns)), "symbols", one, keys, open_only=True)


def retire_files_where(store: Store, paths: DataFrame, t: str) -> Store:
    """Files (repo_id, path) that are gone: their symbols, edges, imports and routes are closed, imports of them forget them."""
    gone = store.open("files").join(paths.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").select("id", "repo_id", "path")
    ids = gone.select("id")
    symbols = semi(store.open("symbols"), "file_id", ids).select("id")
    out = close(store, "symbol_edges", "from_id", symbols, t)
    out = close(out, "symbols", "file_id", ids, t)
    out = close(out, "file_imports", "file_id", ids, t)
    imports = out.table("file_imports")
    forgets = _marked(imports, "target_file_id", ids)
    lost = F.col("_hit") & F.col("valid_to").isNull()
    blank = lambda c: F.when(lost, F.lit(None)).otherwise(F.col(c))
    forgets = forgets.withColumn("target_symbol_id", blank("target_symbol_id")).withColumn("target_file_id", blank("target_file_id")).select(*imports.columns)
    routes = out.table("routes")
    hit = routes.join(gone.select("repo_id", F.col("path").alias("file_path")).withColumn("_hit", F.lit(True)), ["repo_id", "file_path"], "left")
    hit = hit.withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), instant(t)).otherwise(F.col("valid_to"))).select(*routes.columns)
    files = out.table("files")
    shut = _marked(files, "id", ids)
    shut = shut.withColumn("content_hash", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("content_hash"))).withColumn("valid_to", F.when(F.col("_hit"), instant(t)).otherwise(F.col("valid_to"))).select(*files.columns)
    return out.with_tables(file_imports=forgets, routes=hit, files=shut)


def close_contains_edges_for_file(store: Store, file_ids: DataFrame, t: str) -> Store:
    return close(store, "symbol_edges", "from_id", semi(store.table("symbols"), "file_id", file_ids).select("id"), t, where=F.col("edge_type") == "contains")


def _retired(store: Store) -> DataFrame:
    return store.table("symbols").groupBy("id").agg(F.max(F.col("valid_to").isNull()).alias("alive")).where(~F.col("alive")).select("id")


def close_edges_from_retired_symbols(store: Store, t: str) -> Store:
    return close(store, "symbol_edges", "from_id", _retired(store), t)


def unresolve_edges_to_retired_symbols(store: Store) -> Store:
    """Open edges to symbols that are gone lose their target and become unresolved at 0.3."""
    edges = store.table("symbol_edges")
    marked = _marked(edges, "to_id", _retired(store))
    lost = F.col("_hit") & F.col("valid_to").isNull()
    out = marked.withColumn("to_id", F.when(lost, F.lit(None)).otherwise(F.col("to_id"))).withColumn("confidence", F.when(lost, 0.3).otherwise(F.col("confidence"))).withColumn("resolution", F.when(lost, "unresolved").otherwise(F.col("resolution")))
    return store.with_tables(symbol_edges=out.select(*edges.columns))


def close_stale_symbols_for_file(store: Store, current: DataFrame, file_ids: DataFrame, t: str) -> Store:
    """Open symbols of the files that aren't in the current set (file_id, name, kind)."""
    stale = semi(store.open("symbols"), "file_id", file_ids).join(current.select("file_id", "name", "kind").distinct(), ["file_id", "name", "kind"], "left_anti")
    return close(store, "symbols", "id", stale.select("id"), t)


def close_symbol_by_name(store: Store, file_id: str, name: str, t: str) -> Store:
    return close_where(store, "symbols", (F.col("file_id") == file_id) & (F.col("name") == name), t)


def backdate_symbol_valid_from(store: Store, file_id: str, name: str, t: str) -> Store:
    rows = store.table("symbols")
    hit = (F.col("file_id") == file_id) & (F.col("name") == name) & F.col("valid_to").isNull()
    return store.with_tables(symbols=rows.withColumn("valid_from", F.when(hit, F.least("valid_from", instant(t))).otherwise(F.col("valid_from"))))


def insert_symbol_edge(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "symbol_edges", rows, ["id"])


def close_stale_edges_for_symbol(store: Store, symbol_ids: DataFrame, t: str) -> Store:
    return close(store, "symbol_edges", "from_id", symbol_ids, t, where=F.col("edge_type") != "contains")


def resolve_symbol_edge(store: Store, rows: DataFrame) -> Store:
    """Edges (id, to_id, confidence, resolution) that found their target."""
    return patch(store, "symbol_edges", rows, ["id"], ["to_id", "confidence", "resolution"])


def close_stale_file_imports_for_file(store: Store, file_ids: DataFrame, t: str) -> Store:
    return close(store, "file_imports", "file_id", file_ids, t)


def insert_file_import(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "file_imports", rows, ["file_id", "name", "valid_from"])


def insert_route(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "routes", rows, ["id"])


def close_stale_routes_for_file(store: Store, repo_id: str, path: str, t: str) -> Store:
    return close_where(store, "routes", (F.col("repo_id") == repo_id) & (F.col("file_path") == path), t)


# git, entities, communities
def insert_commit(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "commits", rows, ["repo_id", "sha"])


def insert_pull_request(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "pull_requests", rows, ["repo_id", "pr_ref"])


def update_pull_request_enrichment(store: Store, rows: DataFrame) -> Store:
    """Requests (id, title, body, author, state): what is given replaces, what is null stays; they count as enriched."""
    return patch(store, "pull_requests", rows.withColumn("enriched", F.lit(True)), ["id"], ["title", "body", "author", "state", "enriched"])


def insert_decision_git_link(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "decision_git_links", rows, ["decision_id", "ref_type", "ref_id", "link_source"])


def insert_commit_file(store: Store, rows: DataFrame) -> Store:
    """Paths a commit touches; an id from the pair keeps a repeated batch from doubling them."""
    return append_new(store, "commit_files", rows.withColumn("id", key_id("commit_id", "file_path")), ["id"])


def upsert_entity_node(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "entity_nodes", rows.withColumn("id", key_id("repo_id", "canonical_name", "valid_from")), ["repo_id", "canonical_name"], open_only=True)


def close_stale_communities_for_repo(store: Store, repo_id: str, t: str) -> Store:
    return close_where(store, "communities", F.col("repo_id") == repo_id, t)


def insert_community(store: Store, rows: DataFrame) -> Store:
    return append(store, "communities", rows)


def insert_community_member(store: Store, rows: DataFrame) -> Store:
    return append(store, "community_members", rows)


# claims and evidence
def insert_claim(store: Store, rows: DataFrame) -> Store:
    return append(store, "claims", rows)


def close_claims_for_subject(store: Store, subject_ids: DataFrame, t: str) -> Store:
    return close(store, "claims", "subject_id", subject_ids, t)


def insert_evidence_anchor(store: Store, rows: DataFrame) -> Store:
    return append_new(store, "evidence_anchors", rows, ["claim_id", "source_kind", "source_uri", "subpath", "content_hash"])


def insert_anchor_verification(store: Store, rows: DataFrame) -> Store:
    return append(store, "evidence_verifications", rows)


def upsert_index_lane(store: Store, rows: DataFrame) -> Store:
    """One row per repository and lane: the one updated last."""
    both = store.table("index_lanes").unionByName(rows_of(store, "index_lanes", rows))
    return store.with_tables(index_lanes=first_by(both, ["repo_id", "lane"], F.desc("updated_at"), F.desc("indexed_commit")))


def store_freshness_manifest(store: Store, rows: DataFrame) -> Store:
    return append(store, "freshness_manifests", rows)


# retractions
def close_claims_for_decision_subtree(store: Store, decision_ids: DataFrame, t: str) -> Store:
    return close(store, "claims", "id", store.claim_ids_for_decisions(decision_ids), t)


def retract_decision(store: Store, ids: DataFrame, t: str) -> Store:
    """Closes decisions, their constraints and the claims about both."""
    out = close_claims_for_decision_subtree(store, ids, t)
    return close(close(out, "constraints", "decision_id", ids, t), "decisions", "id", ids, t)


def retract_constraint(store: Store, ids: DataFrame, t: str) -> Store:
    out = close(store, "claims", "subject_id", ids, t, where=F.col("subject_type") == "constraint")
    return close(out, "constraints", "id", ids, t)


def retract_episode_facts(store: Store, episode_ids: DataFrame, t: str) -> Store:
    return retract_decision(store, semi(store.open("decisions"), "episode_id", episode_ids).select("id"), t)
