"""Ingestion runs over the knowledge tables: documents, source files, commits, requests and episodes become versions, edges and links.

Every run takes a store and gives the store after it; tables it changed are written once, so that
the next run starts from short plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.functions.parse import hinted_end
from chronoweave.operators import ingest
from chronoweave.operators.temporal import instant
from chronoweave.plans import changes, checks
from chronoweave.plans.changes import key_id
from chronoweave.plans.store import Store, first_by, semi
from chronoweave.runtime import Rounds
from chronoweave.sources.code import extract_files
from chronoweave.sources.markdown import parse_records


def settled(store: Store, *names: str) -> Store:
    """The store with the named tables written."""
    rounds = Rounds(store.spark, "store")
    return store.with_tables(**{n: rounds.cut(store.table(n), keep=True) for n in names})


def _at(df: DataFrame, t: str, *columns: str) -> DataFrame:
    return df.withColumns({c: instant(t) for c in columns})


def sync_documents(store: Store, repo_id: str, files: DataFrame, t: str) -> Store:
    """Records (path, text) become document versions: unchanged ones stay, changed ones close the version before them.

    A record without an error of its parts gives a document, its decision, its constraints with
    their claims, links to the files it mentions, and edges for what defines and imposes.
    Supersessions are linked to the open documents they name.
    """
    parsed = parse_records(files).where(F.col("adr_id").isNotNull() & F.col("title").isNotNull())
    row = parsed.select(
        F.lit(repo_id).alias("repo_id"), "adr_id", "title", F.coalesce("status", F.lit("Proposed")).alias("status"), "date", "decision", "supersedes", "mentions", "constraints", F.col("path").alias("source_uri"),
        F.lit(1.0).alias("confidence"),
    ).withColumn("_what", F.to_json(F.struct("adr_id", "title", "status", "date", "decision", "supersedes", "constraints")))
    row = _at(row, t, "valid_from", "ingested_at").withColumn("id", key_id("repo_id", "source_uri", "_what", "valid_from"))
    row = first_by(row, ["source_uri"], F.col("id"))
    old = store.list_current_adrs(repo_id).select("source_uri", F.col("id").alias("_old"), F.col("title").alias("_t"), F.col("status").alias("_s"), F.col("decision").alias("_d"), F.col("supersedes").alias("_sup"))
    met = row.join(old, "source_uri", "left")
    same = F.col("_old").isNotNull() & F.col("_t").eqNullSafe(F.col("title")) & F.col("_s").eqNullSafe(F.col("status")) & F.col("_d").eqNullSafe(F.col("decision")) & F.col("_sup").eqNullSafe(F.col("supersedes"))
    new = Rounds(store.spark, "documents").cut(met.where(~same), keep=True)
    gone = new.where("_old IS NOT NULL").select(F.col("_old").alias("id"))
    out = changes.close_adr(changes.close_decisions_for_adr(store, gone, t), gone, t)
    out = changes.insert_adr(out, new)
    decisions = _at(new.where("decision IS NOT NULL AND decision <> ''").select(F.col("id").alias("adr_id"), F.col("decision").alias("text"), "source_uri", "confidence", "constraints", "mentions", "repo_id"), t, "valid_from", "ingested_at").withColumn("id", key_id("adr_id", "text"))
    out = changes.insert_decision(out, decisions.drop("constraints").withColumn("episode_id", F.lit(None).cast("string")))
    rules = _at(decisions.select(F.col("id").alias("decision_id"), "source_uri", "repo_id", "confidence", F.explode("constraints").alias("text")), t, "valid_from", "ingested_at").withColumn("id", key_id("decision_id", "text"))
    out = changes.insert_constraint(out, rules)
    claim = lambda df, kind, subject: df.select(F.col("repo_id"), F.lit(kind).alias("kind"), F.lit(kind).alias("subject_type"), F.col(subject).alias("subject_id"), "text", tx.polarity(F.col("text")).alias("polarity"), F.lit("partial").alias("evidence_grade"), "confidence", "valid_from", "ingested_at").withColumn("id", key_id("subject_id", "text"))
    out = changes.insert_claim(changes.insert_claim(out, claim(rules, "constraint", "id")), claim(decisions, "decision", "id"))
    links = _at(decisions.select(F.col("id").alias("decision_id"), F.explode("mentions").alias("file_path")), t, "valid_from", "ingested_at").withColumns({"link_type": F.lit("mentions"), "link_source": F.lit("adr_text"), "confidence": F.lit(0.9)}).withColumn("id", key_id("decision_id", "file_path", "valid_from"))
    out = changes.insert_decision_code_link(out, links)
    edge = lambda df, kind, a, at, b, bt: _at(df.select(F.lit(kind).alias("edge_type"), F.col(a).alias("source_id"), F.lit(at).alias("source_type"), F.col(b).alias("target_id"), F.lit(bt).alias("target_type"), F.lit(0.9).alias("confidence")), t, "valid_from", "ingested_at").withColumn("id", key_id("edge_type", "source_id", "target_id"))
    out = changes.insert_temporal_edge_if_absent(out, edge(decisions, "defines", "adr_id", "adr", "id", "decision"))
    out = changes.insert_temporal_edge_if_absent(out, edge(rules, "imposes", "decision_id", "decision", "id", "constraint"))
    number = lambda c: F.regexp_extract(c, r"0*([0-9]+)$", 1)
    open_docs = out.list_current_adrs(repo_id)
    named = open_docs.select(F.col("id").alias("superseder_id"), F.explode("supersedes").alias("ref")).withColumn("n", number("ref"))
    pairs = named.join(out.table("adr_documents").where(F.col("repo_id") == repo_id).select(F.col("id").alias("superseded_id"), number("adr_id").alias("n")), "n").where("superseder_id <> superseded_id")
    out = changes.upsert_supersession_edge(out, _at(pairs.select("superseder_id", "superseded_id", F.lit(1.0).alias("confidence")), t, "valid_from", "ingested_at").withColumn("id", key_id("superseder_id", "superseded_id")))
    return settled(out, "adr_documents", "decisions", "constraints", "claims", "decision_code_links", "temporal_edges", "supersession_edges")


def _spec(target: Column) -> Column:
    """Path of a module as imported: leading dots go up, dots between names are folders."""
    module = F.regexp_extract(target, r"^([^:]*)", 1)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    return F.concat(F.when(dots == 1, "./").when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise(""), F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/")))


def ingest_symbols(store: Store, repo_id: str, files: DataFrame, t: str, whole: bool = True) -> Store:
    """Source files (path, text) of a repository become files, symbols, imports, edges and routes.

    Only files whose content changed are read. With ``whole`` files that aren't given are retired;
    edges to what is gone lose their target, and edges to names whose live count changed are
    resolved anew, in whatever file they stand.
    """
    given = files.select("path", "text").dropDuplicates(["path"]).withColumn("content_hash", F.sha2("text", 256))
    live = store.open("files").where(F.col("repo_id") == repo_id)
    changed = given.join(live.select("path", "content_hash"), ["path", "content_hash"], "left_anti").withColumn("repo_id", F.lit(repo_id))
    changed = Rounds(store.spark, "changed_files").cut(changed, keep=True)
    before = store.live_symbols().where(F.col("repo_id") == repo_id).select("name")
    out = store
    if whole:
        out = changes.retire_files_where(out, live.join(given.select("path"), "path", "left_anti").select("repo_id", "path"), t)
    out = changes.upsert_file(out, changed.select("repo_id", "path"), t)
    ids = out.open("files").join(changed.select("repo_id", "path", F.col("content_hash").alias("_h")), ["repo_id", "path"])
    out = changes.update_file_content_hash(out, ids.select("id", F.col("_h").alias("content_hash")))
    rounds = Rounds(store.spark, "extracted")
    out = settled(out, "files", "symbols", "symbol_edges", "file_imports", "routes")
    of = out.open("files").where(F.col("repo_id") == repo_id).select(F.col("id").alias("file_id"), "path")
    rows = rounds.cut(extract_files(changed).join(of, "path"), keep=True)
    touched = changed.join(of, "path").select("file_id")
    symbols = rows.where("record = 'symbol'").select("file_id", "name", "kind", "line", "end_line")
    out = changes.close_stale_symbols_for_file(out, symbols, touched, t)
    out = changes.insert_symbol(out, symbols, t)
    out = settled(out, "symbols")
    own = semi(out.table("symbols"), "file_id", touched).select("id").distinct()
    out = changes.close_stale_edges_for_symbol(changes.close_contains_edges_for_file(out, touched, t), own, t)
    out = changes.unresolve_edges_to_retired_symbols(changes.close_edges_from_retired_symbols(out, t))
    out = changes.close_stale_file_imports_for_file(out, touched, t)
    out = settled(out, "symbol_edges")
    here = out.open("files").where(F.col("repo_id") == repo_id).select(F.col("id").alias("file_id"), "repo_id", "path")
    alive = out.live_symbols().where(F.col("repo_id") == repo_id).select("id", "repo_id", "file_id", "name", "line", "end_line", "file_path")
    imports = rows.where("record = 'import'").select("file_id", "path", "name", "target", F.regexp_extract("target", r":(.*)$", 1).alias("what")).withColumn("spec", _spec(F.col("target"))).withColumn("key", key_id("file_id", "name", "target"))
    found = ingest.resolve_specs(imports.select("key", F.lit(repo_id).alias("repo_id"), F.col("path").alias("from_path"), "spec"), here).withColumnRenamed("file_id", "target_file_id")
    meant = alive.groupBy(F.col("file_id").alias("target_file_id"), F.col("name").alias("what")).agg(F.min("id").alias("target_symbol_id"))
    imports = _at(imports.join(found, "key", "left").join(meant, ["target_file_id", "what"], "left").select("file_id", "name", "spec", "target_file_id", "target_symbol_id"), t, "valid_from").withColumn("id", key_id("file_id", "name", "valid_from"))
    out = changes.insert_file_import(out, imports)
    first = alive.groupBy("file_id", F.col("name").alias("source")).agg(F.min("id").alias("from_id"))
    raw = rows.where("record = 'edge' AND kind <> 'contains' AND target IS NOT NULL").select("file_id", "source", F.col("kind").alias("edge_type"), F.col("target").alias("to_name")).distinct().join(first, ["file_id", "source"])
    raw = raw.select(key_id("from_id", "edge_type", "to_name").alias("edge_id"), F.lit(repo_id).alias("repo_id"), "file_id", "from_id", F.col("source").alias("from_name"), "to_name", "edge_type", F.lit(None).cast("string").alias("recv"), F.lit(None).cast("string").alias("spec"))
    out = settled(out, "file_imports")
    resolved = ingest.resolve_edges(raw, alive, here, imports=out.open("file_imports"))
    edges = raw.join(resolved, "edge_id").select(F.concat_ws("@", "edge_id", F.lit(t)).alias("id"), "repo_id", "from_id", "to_id", "to_name", "edge_type", "confidence", "resolution")
    held = ingest.nested_spans(semi(alive, "file_id", touched)).join(alive.select(F.col("id").alias("inner_id"), F.col("name").alias("to_name")), "inner_id")
    held = held.select(F.concat_ws("@", F.col("outer_id"), F.col("inner_id"), F.lit(t)).alias("id"), F.lit(repo_id).alias("repo_id"), F.col("outer_id").alias("from_id"), F.col("inner_id").alias("to_id"), "to_name", F.lit("contains").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit("same-file").alias("resolution"))
    out = changes.insert_symbol_edge(out, _at(edges.unionByName(held), t, "valid_from"))
    # routes of the files read anew replace theirs
    old_routes = out.table("routes")
    ours = old_routes.join(changed.select("repo_id", F.col("path").alias("file_path")).withColumn("_hit", F.lit(True)), ["repo_id", "file_path"], "left")
    out = out.with_tables(routes=ours.withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), instant(t)).otherwise(F.col("valid_to"))).select(*old_routes.columns))
    routes = _at(rows.where("record = 'route'").select(F.lit(repo_id).alias("repo_id"), F.upper("kind").alias("method"), F.col("name").alias("path"), F.col("path").alias("file_path"), "line", F.lit(0.8).alias("confidence")), t, "valid_from")
    out = changes.insert_route(out, routes.withColumn("id", key_id("repo_id", "file_path", "line", "path", "valid_from")))
    out = settled(out, "symbol_edges", "routes")
    after = out.live_symbols().where(F.col("repo_id") == repo_id)
    names = ingest.changed_names(before, after.select("name")).withColumnRenamed("name", "to_name")
    again = out.open("symbol_edges").where((F.col("repo_id") == repo_id) & (F.col("edge_type") != "contains")).join(names, "to_name", "left_semi")
    again = again.join(after.select(F.col("id").alias("from_id"), "file_id", F.col("name").alias("from_name")), "from_id")
    again = again.select(F.col("id").alias("edge_id"), "repo_id", "file_id", "from_name", "to_name", "edge_type", F.lit(None).cast("string").alias("recv"), F.lit(None).cast("string").alias("spec"))
    fresh = ingest.resolve_edges(again, after.select("id", "repo_id", "file_id", "name"), here, imports=out.open("file_imports"))
    out = changes.patch(out, "symbol_edges", fresh.withColumnRenamed("edge_id", "id"), ["id"], ["to_id", "confidence", "resolution"], keep_old=False)
    return settled(out, "symbol_edges")


def sync_commits(store: Store, repo_id: str, log: DataFrame, t: str) -> Store:
    """A log (sha, author, message, source_time, files) becomes commits, touched files, links and evidence.

    A message that names documents links their decisions at 0.95; one that names none links those
    whose title shares two words at 0.6. Commits seen before give nothing new.
    """
    rows = log.withColumn("repo_id", F.lit(repo_id)).withColumn("id", key_id("repo_id", "sha")).withColumn("confidence", F.lit(1.0))
    known = store.table("commits").select("repo_id", "sha")
    fresh = Rounds(store.spark, "commits").cut(_at(rows.join(known, ["repo_id", "sha"], "left_anti"), t, "ingested_at"), keep=True)
    out = changes.insert_commit(store, fresh)
    out = changes.insert_commit_file(out, _at(fresh.select(F.col("id").alias("commit_id"), F.explode("files").alias("file_path")), t, "ingested_at"))
    view = out.decision_view().where(F.col("valid_to").isNull() & (F.col("repo_id") == repo_id))
    docs = out.table("adr_documents").select(F.col("id").alias("adr_id"), F.regexp_extract("adr_id", r"0*([0-9]+)$", 1).alias("number"))
    first = first_by(view.select("id", "adr_id").join(docs, "adr_id"), ["number"], F.col("id"))
    told = fresh.select(F.col("id").alias("commit_id"), F.explode(tx.document_references(F.col("message"))).alias("n")).withColumn("number", F.regexp_replace("n", "^0+(?=[0-9])", ""))
    explicit = told.join(first.select("number", F.col("id").alias("decision_id")), "number").select("commit_id", "decision_id", F.lit(0.95).alias("confidence"))
    links = explicit.unionByName(ingest.keyword_links(fresh, view.select("id", "title"))).groupBy("commit_id", "decision_id").agg(F.max("confidence").alias("confidence"))
    links = Rounds(store.spark, "commit_links").cut(links, keep=True)
    git = _at(links.select("decision_id", F.lit("commit").alias("ref_type"), F.col("commit_id").alias("ref_id"), F.lit("git_history").alias("link_source"), "confidence"), t, "valid_from", "ingested_at").withColumn("id", key_id("decision_id", "ref_type", "ref_id", "link_source"))
    out = changes.insert_decision_git_link(out, git)
    edges = _at(links.select(F.lit("evidences").alias("edge_type"), F.col("commit_id").alias("source_id"), F.lit("commit").alias("source_type"), F.col("decision_id").alias("target_id"), F.lit("decision").alias("target_type"), "confidence"), t, "valid_from", "ingested_at").withColumn("id", key_id("edge_type", "source_id", "target_id"))
    return settled(changes.insert_temporal_edge_if_absent(out, edges), "commits", "commit_files", "decision_git_links", "temporal_edges")


def sync_requests(store: Store, repo_id: str, log: DataFrame, t: str) -> Store:
    """Merge and squash messages of a log (sha, message, source_time) become requests, each once."""
    ref = tx.merged_reference(F.col("message"))
    rows = log.select(F.lit(repo_id).alias("repo_id"), ref.alias("pr_ref"), F.regexp_extract("message", r"^([^\n]*)", 1).alias("title"), "source_time").where("pr_ref <> ''")
    rows = _at(rows, t, "ingested_at").withColumns({"enriched": F.lit(False), "confidence": F.lit(1.0)}).withColumn("id", key_id("repo_id", "pr_ref"))
    return settled(changes.insert_pull_request(store, rows), "pull_requests")


def sync_incremental(store: Store, repo_id: str, files: DataFrame, t: str) -> Store:
    """Source files and records that changed since the last run; others aren't read. What isn't given stays."""
    code = files.where(~F.lower("path").endswith(".md"))
    out = ingest_symbols(store, repo_id, code, t, whole=False)
    return sync_documents(out, repo_id, files.where(F.lower("path").endswith(".md")), t)


def record_episode(store: Store, repo_id: str, episodes: DataFrame, facts: DataFrame, t: str) -> Store:
    """Episodes (id, source, content, occurred_at) with their decisions (episode_id, title, text, hint, embedding, confidence).

    A decision whose normal text an open one has, or whose vector is near one, is the same: its
    episode supports that one instead. 'this sprint' ends a decision after fourteen days.
    """
    out = changes.insert_episode(store, _at(episodes.withColumn("repo_id", F.lit(repo_id)).withColumn("confidence", F.lit(1.0)), t, "ingested_at"))
    at = facts.join(episodes.select(F.col("id").alias("episode_id"), "occurred_at"), "episode_id").withColumn("key", key_id("episode_id", "text"))
    at = Rounds(store.spark, "episode_facts").cut(first_by(at, ["key"], F.col("title")), keep=True)
    near = Rounds(store.spark, "episode_matches").cut(checks.nearest_decision(store, repo_id, at.select("key", "text", "embedding")), keep=True)
    new = at.join(near.select("key"), "key", "left_anti")
    rows = _at(new.select(F.col("key").alias("id"), "title", "episode_id", F.lit(None).cast("string").alias("adr_id"), "text", F.concat(F.lit("episode:"), "episode_id").alias("source_uri"), "embedding", "confidence", F.col("occurred_at").alias("valid_from"), hinted_end(F.col("hint"), F.col("occurred_at")).alias("valid_to")), t, "ingested_at")
    out = changes.insert_decision(out, rows)
    support = at.join(near, "key").select(F.lit("supports").alias("edge_type"), F.col("episode_id").alias("source_id"), F.lit("episode").alias("source_type"), F.col("decision_id").alias("target_id"), F.lit("decision").alias("target_type"), F.col("similarity").alias("confidence"))
    out = changes.insert_temporal_edge_if_absent(out, _at(support, t, "valid_from", "ingested_at").withColumn("id", key_id("edge_type", "source_id", "target_id")))
    return settled(out, "episodes", "decisions", "temporal_edges")


def detect_communities(store: Store, repo_id: str, t: str, rounds: int = 20) -> Store:
    """Communities of the symbol graph replace those before; symbols without an edge are communities of their own."""
    from chronoweave.operators import graph

    edges = store.get_call_edges_for_repo(repo_id).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    labels = graph.label_propagation(edges, rounds)
    alive = store.get_symbols_with_files_for_repo(repo_id).dropDuplicates(["id"])
    members = alive.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(F.coalesce("label", "id").alias("community"), "id", "name", F.col("file_path").alias("path"))
    named = ingest.community_labels(members).select(F.concat_ws("@", "community", F.lit(t)).alias("id"), F.lit(repo_id).alias("repo_id"), "label", F.col("size").cast("int").alias("size"))
    out = changes.close_stale_communities_for_repo(store, repo_id, t)
    out = changes.insert_community(out, _at(named, t, "valid_from"))
    out = changes.insert_community_member(out, members.select(F.concat_ws("@", "community", F.lit(t)).alias("community_id"), F.col("id").alias("symbol_id")))
    return settled(out, "communities", "community_members")


def verify_index(live: Store, rebuilt: Store, repo_id: str) -> DataFrame:
    """(lane, verdict, keys): declared facts of documents and symbols of two stores, compared as multisets."""
    from chronoweave.operators import integrity

    parts = []
    for lane, a, b in (("documents", live.adr_declared_facts(repo_id), rebuilt.adr_declared_facts(repo_id)), ("symbols", live.symbol_declared_facts(repo_id), rebuilt.symbol_declared_facts(repo_id))):
        parts.append(integrity.verdict(integrity.surplus(a, b, "fact")).select(F.lit(lane).alias("lane"), "verdict", "keys"))
    return parts[0].unionByName(parts[1])
