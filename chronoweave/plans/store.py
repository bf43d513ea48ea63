"""The knowledge tables and everything read from them: lookups, joins, counts, neighbourhoods.

Reads take sets of ids as frames with one column ``id`` and give lazy frames. ``at`` is an instant
as text; without it rows count as of the end of time, that is the open ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import graph, retrieval
from chronoweave.operators.temporal import diff_in_range, in_force, instant, overlapping
from chronoweave.runtime import broadcast_if_small
from chronoweave.sources.schema import COLUMNS, EMBEDDED, schema

END = "9999-12-31 23:59:59"
# Edges that make two decisions neighbours, and those an impact follows.
DECISION_EDGES = ("applies_to", "conflicts_with", "supports", "depends_on")
IMPACT_EDGES = ("applies_to", "depends_on", "conflicts_with", "defines", "imposes")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def semi(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids``, by broadcast where the counted ids fit."""
    keys = ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
    return df.join(broadcast_if_small(keys, 64), column, "left_semi").select(*df.columns)


class Store:
    """Frames by table name; tables not given are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str]) -> Store:
        """Tables written as Parquet, with their schemas given."""
        return cls(spark, {n: spark.read.schema(schema(n)).parquet(f"{folder}/{n}") for n in names})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], schema(name))
        return self.tables[name]

    def with_tables(self, **changed: DataFrame) -> Store:
        return Store(self.spark, {**self.tables, **changed})

    def open(self, name: str, at: str = END) -> DataFrame:
        return self.table(name).where(in_force(instant(at)))

    # repositories and counts
    def fetch_all_repositories(self) -> DataFrame:
        return self.table("repositories").orderBy(F.desc("ingested_at"), "id")

    def table_count(self, name: str) -> DataFrame:
        if name not in COLUMNS:
            raise ValueError(f"no table {name}")
        return self.table(name).agg(F.count("*").alias("rows"))

    def table_columns(self, name: str) -> DataFrame:
        """(column, type, nullable, key): the first column of a table is its key, but for members."""
        rows = [(f.name, f.dataType.simpleString(), f.nullable, i == 0 and f.name == "id") for i, f in enumerate(schema(name).fields)]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, key boolean")

    def repository_counts(self) -> DataFrame:
        """Nine counts per repository; temporal edges name no repository and are counted over all."""
        docs = self.table("adr_documents").select(F.col("id").alias("adr_id"), "repo_id")
        eps = self.table("episodes").select(F.col("id").alias("episode_id"), F.col("repo_id").alias("ep_repo"))
        decisions = self.table("decisions").join(docs, "adr_id", "left").join(eps, "episode_id", "left").select("id", F.coalesce("repo_id", "ep_repo").alias("repo_id"))
        files = self.table("files").select(F.col("id").alias("file_id"), "repo_id")
        rows = {
            "documents": docs.select("repo_id"), "decisions": decisions.select("repo_id"),
            "constraints": self.table("constraints").join(decisions.withColumnRenamed("id", "decision_id"), "decision_id").select("repo_id"),
            "files": files.select("repo_id"), "symbols": self.table("symbols").join(files, "file_id").select("repo_id"),
            "commits": self.table("commits").select("repo_id"), "pull_requests": self.table("pull_requests").select("repo_id"), "episodes": self.table("episodes").select("repo_id"),
        }
        union = reduce(DataFrame.unionByName, [df.select("repo_id", F.lit(name).alias("kind")) for name, df in rows.items()])
        counts = union.groupBy("repo_id").agg(*[F.count_if(F.col("kind") == name).alias(name) for name in rows])
        edges = self.table("temporal_edges").agg(F.count("*").alias("temporal_edges"))  # one row
        out = self.table("repositories").select(F.col("id").alias("repo_id")).join(counts, "repo_id", "left").fillna(0, list(rows))
        return out.join(F.broadcast(edges))

    # documents
    def find_current_adr(self, source_uri: str) -> DataFrame:
        return first_by(self.open("adr_documents").where(F.col("source_uri") == source_uri), ["source_uri"], F.desc("valid_from"), F.col("id"))

    def list_current_adrs(self, repo_id: str) -> DataFrame:
        return self.open("adr_documents").where(F.col("repo_id") == repo_id)

    def supersession_pairs_with_status(self, repo_id: str) -> DataFrame:
        docs = self.table("adr_documents").where(F.col("repo_id") == repo_id)
        a = docs.select(F.col("id").alias("superseder_id"), F.col("adr_id").alias("superseder"))
        b = docs.select(F.col("id").alias("superseded_id"), F.col("adr_id").alias("superseded"), "status", "valid_to")
        return self.table("supersession_edges").select("superseder_id", "superseded_id").join(a, "superseder_id").join(b, "superseded_id").select("superseder", "superseded", "status", "valid_to")

    def find_adr_by_adr_id(self, repo_id: str, adr_id: str) -> DataFrame:
        """The open document of that id, spelled exactly so."""
        return self.list_current_adrs(repo_id).where(F.col("adr_id") == adr_id)

    find_adr_document_by_adr_id = find_adr_by_adr_id

    def find_adr_by_adr_id_flex(self, repo_id: str, given: str) -> DataFrame:
        """The open document meant by 'ADR-3', '3' or '0003': the one that began last."""
        number = lambda c: F.regexp_extract(c, r"^(?:[^-]*-)?0*([0-9]+)$", 1)
        hit = self.list_current_adrs(repo_id).where((number(F.col("adr_id")) != "") & (number(F.col("adr_id")) == number(F.lit(given))))
        return hit.orderBy(F.desc("valid_from"), "id").limit(1)

    def find_decision_for_adr(self, document_id: str) -> DataFrame:
        return self.open("decisions").where(F.col("adr_id") == document_id).orderBy(F.desc("confidence"), "id").limit(1)

    def next_adr_number(self, repo_id: str) -> DataFrame:
        n = F.regexp_extract("adr_id", r"-(\d+)$", 1).try_cast("long")
        return self.list_current_adrs(repo_id).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_number"))

    # decisions
    def decision_view(self) -> DataFrame:
        """Decisions with their parent: document or episode, title, status and repository."""
        d = self.table("adr_documents").select(F.col("id").alias("adr_id"), F.col("title").alias("_dt"), "status", F.col("repo_id").alias("_dr"), "effective_from", "effective_to")
        e = self.table("episodes").select(F.col("id").alias("episode_id"), F.col("source").alias("_es"), F.col("repo_id").alias("_er"), "occurred_at")
        return self.table("decisions").join(d, "adr_id", "left").join(e, "episode_id", "left").select(
            "id", F.coalesce("adr_id", F.concat(F.lit("episode:"), "episode_id")).alias("adr_id"), F.coalesce("title", "_dt", "_es").alias("title"), F.coalesce("status", F.lit("episode")).alias("status"),
            F.coalesce("_dr", "_er").alias("repo_id"), "source_uri", "text", "confidence", "embedding", "valid_from", "valid_to", "ingested_at", "effective_from", "effective_to", "occurred_at",
        )

    def list_all_decisions(self, repo_id: str, at: str = END) -> DataFrame:
        return self.fetch_decisions_with_embeddings(repo_id, at).drop("embedding").orderBy(F.desc("confidence"), "id")

    def fetch_decisions_with_embeddings(self, repo_id: str, at: str = END) -> DataFrame:
        return self.decision_view().where(in_force(instant(at)) & (F.col("repo_id") == repo_id))

    def find_decision_with_embedding(self, decision_id: str) -> DataFrame:
        return self.decision_view().where(in_force(instant(END)) & (F.col("id") == decision_id))

    def find_decisions_by_ids(self, ids: list[str], at: str = END, min_confidence: float = 0.0) -> DataFrame:
        """The decisions in the order of the given ids."""
        asked = F.broadcast(self.spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, position int"))  # the request's own list
        return self.decision_view().where(in_force(instant(at)) & (F.col("confidence") >= min_confidence)).join(asked, "id").orderBy("position")

    def find_decisions_for_file(self, path: str, at: str = END, event_time: bool = True) -> DataFrame:
        """Decisions linked to a path: by event time, or by the recorded periods of decision and link."""
        t = instant(at)
        links = self.table("decision_code_links").where(F.col("file_path") == path)
        links = links if event_time else links.where(in_force(t))
        view = self.decision_view()
        rule = in_force(t, F.coalesce("effective_from", "occurred_at", "valid_from"), F.coalesce("effective_to", "valid_to")) if event_time else in_force(t)
        return semi(view.where(rule), "id", links.select("decision_id"))

    def file_paths_linked_to_decision(self, decision_id: str) -> DataFrame:
        return self.open("decision_code_links").where(F.col("decision_id") == decision_id).select("file_path").distinct()

    def file_mentions_for_decision(self, decision_id: str) -> DataFrame:
        return self.table("decision_code_links").where(F.col("decision_id") == decision_id).select("file_path").distinct()

    def decision_ids_linked_under_path_segment(self, segment: str) -> DataFrame:
        part = "/" + segment.strip("/\\").replace("\\", "/").lower() + "/"
        path = F.lower(F.concat(F.lit("/"), F.translate("file_path", "\\", "/"), F.lit("/")))
        return self.open("decision_code_links").where(F.contains(path, F.lit(part))).select("decision_id").distinct()

    # constraints
    def open_constraints_for_decision(self, decision_id: str) -> DataFrame:
        return self.open("constraints").where(F.col("decision_id") == decision_id).select("id", "text")

    def find_constraints_for_decisions(self, ids: DataFrame, open_only: bool = False) -> DataFrame:
        return semi(self.open("constraints") if open_only else self.table("constraints"), "decision_id", ids)

    def find_constraint_facts_for_adr(self, document_id: str) -> DataFrame:
        own = self.table("decisions").where(F.col("adr_id") == document_id).select("id")
        return semi(self.table("constraints"), "decision_id", own).select("text", "confidence").orderBy("text", "confidence")

    # files, symbols, edges
    def live_symbols(self, at: str = END) -> DataFrame:
        """Live symbols with their file's path and repository."""
        files = self.table("files").select(F.col("id").alias("file_id"), "repo_id", F.col("path").alias("file_path"))
        return self.open("symbols", at).join(files, "file_id")

    def find_symbol_ref_by_name(self, name: str, at: str = END) -> DataFrame:
        """The symbol of that name, else the first whose name ends in ``::name``."""
        hit = self.live_symbols(at).where((F.col("name") == name) | F.col("name").endswith(f"::{name}"))
        return hit.orderBy(F.col("name") != name, "name", "id").limit(1)

    def fetch_symbol_ref_by_id(self, ids: DataFrame, at: str = END) -> DataFrame:
        return semi(self.live_symbols(at), "id", ids)

    def fetch_symbol_edges(self, ids: DataFrame, direction: str = "outbound", min_confidence: float = 0.0, at: str = END) -> DataFrame:
        """(from_id, to_id, to_name, edge_type, confidence) at the nodes; outward edges need a target."""
        e = self.open("symbol_edges", at).where(F.col("confidence") >= min_confidence).select("from_id", "to_id", "to_name", "edge_type", "confidence")
        out, back = semi(e.where("to_id IS NOT NULL"), "from_id", ids), semi(e, "to_id", ids)
        return {"outbound": out, "inbound": back, "both": out.unionByName(back).distinct()}[direction]

    def symbol_has_edges(self, ids: DataFrame, direction: str = "outbound", min_confidence: float = 0.0) -> DataFrame:
        """The nodes that have an edge; both ways look outward only."""
        side = "to_id" if direction == "inbound" else "from_id"
        return self.fetch_symbol_edges(ids, "inbound" if direction == "inbound" else "outbound", min_confidence).select(F.col(side).alias("id")).distinct()

    def has_symbol_edges(self) -> bool:
        return not self.open("symbol_edges").isEmpty()

    def fetch_symbols_for_propose(self, paths: DataFrame) -> DataFrame:
        return semi(self.live_symbols(), "file_path", paths).orderBy("name", "id")

    def fetch_routes_for_propose(self, paths: DataFrame) -> DataFrame:
        return semi(self.open("routes"), "file_path", paths).orderBy("path", "id")

    def find_routes_for_repo(self, repo_id: str) -> DataFrame:
        return self.open("routes").where(F.col("repo_id") == repo_id)

    def last_file_ingested_at(self, repo_id: str) -> DataFrame:
        return self.table("files").where(F.col("repo_id") == repo_id).agg(F.max("ingested_at").alias("last_ingested"))

    def fetch_file_symbols_brief(self, path: str, at: str = END) -> DataFrame:
        return self.live_symbols(at).where(F.col("file_path") == path).select("name", "kind", "line", "end_line", "signature").orderBy("line", "name")

    def fetch_symbols_for_file(self, file_id: str) -> DataFrame:
        return self.open("symbols").where(F.col("file_id") == file_id).orderBy("line", "name").select("name", "kind")

    def get_file_content_hash(self, paths: DataFrame) -> DataFrame:
        return semi(self.open("files"), "path", paths).select("path", "content_hash")

    def find_file_id_by_path(self, paths: DataFrame) -> DataFrame:
        return semi(self.open("files"), "path", paths).select("path", "id")

    def find_symbol_id_in_file(self, wanted: DataFrame) -> DataFrame:
        """(file_id, name, id) for wanted (file_id, name): the first live symbol of the name in the file."""
        return self.open("symbols").join(wanted.select("file_id", "name").distinct(), ["file_id", "name"]).groupBy("file_id", "name").agg(F.min("id").alias("id"))

    def find_files_with_symbol(self, name: str, at: str = END) -> DataFrame:
        return self.live_symbols(at).where(F.col("name") == name).select("file_path").distinct()

    def find_unique_symbol_id_in_repo(self) -> DataFrame:
        """(repo_id, name, id) of the names exactly one live symbol has."""
        return self.live_symbols().groupBy("repo_id", "name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")

    def resolve_symbol_span(self, repo_id: str, name: str) -> DataFrame:
        """(file_path, line, end_line) if exactly one live symbol has the name."""
        hit = self.live_symbols().where((F.col("repo_id") == repo_id) & (F.col("name") == name))
        return hit.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").select("file_path", "line", "end_line")

    def find_symbol_id_by_type_and_name(self) -> DataFrame:
        """(repo_id, type, name, id): members that exactly one type of the name contains under that name."""
        s = self.live_symbols().select("id", "repo_id", "name")
        held = self.open("symbol_edges").where("edge_type = 'contains' AND to_id IS NOT NULL").select("from_id", "to_id")
        pairs = held.join(s.select(F.col("id").alias("from_id"), "repo_id", F.col("name").alias("type")), "from_id").join(s.select(F.col("id").alias("to_id"), "name"), "to_id").distinct()
        return pairs.groupBy("repo_id", "type", "name").agg(F.min("to_id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")

    def files_with_open_edges_to_names(self, names: DataFrame) -> DataFrame:
        edges = semi(self.open("symbol_edges").where("edge_type <> 'contains'"), "to_name", names).select(F.col("from_id").alias("id"))
        return semi(self.live_symbols(), "id", edges).select("file_id", "file_path").distinct()

    def fetch_unresolved_symbol_edges(self) -> DataFrame:
        return self.open("symbol_edges").where("to_id IS NULL AND to_name IS NOT NULL")

    def _across(self, at: str) -> DataFrame:
        s = self.live_symbols(at)
        a = s.select(F.col("id").alias("from_id"), F.col("name").alias("caller"), F.col("file_path").alias("caller_file"))
        b = s.select(F.col("id").alias("to_id"), F.col("name").alias("callee"), F.col("file_path").alias("callee_file"))
        return self.open("symbol_edges", at).join(a, "from_id").join(b, "to_id").where("caller_file <> callee_file")

    def find_one_hop_caller_files(self, paths: DataFrame) -> DataFrame:
        return semi(self._across(END), "callee_file", paths).select("callee_file", "caller_file").distinct()

    def expand_callers(self, paths: DataFrame, rounds: int = 3) -> DataFrame:
        """(path): the files and those that reach them within some calls, round by round."""
        links = self._across(END).select(F.col("callee_file").alias("src"), F.col("caller_file").alias("dst"))
        return graph.reachable(links, paths.select(F.col(paths.columns[0]).alias("node")), rounds).select(F.col("node").alias("path"))

    def fetch_file_callers_brief(self, path: str, limit: int = 30, at: str = END) -> DataFrame:
        return self._across(at).where(F.col("callee_file") == path).select("caller", "caller_file", "callee", "edge_type", "confidence").distinct().orderBy(F.desc("confidence"), "caller", "callee", "edge_type").limit(limit)

    def fetch_file_callees_brief(self, path: str, limit: int = 30, at: str = END) -> DataFrame:
        return self._across(at).where(F.col("caller_file") == path).select("caller", "callee", "callee_file", "edge_type", "confidence").distinct().orderBy(F.desc("confidence"), "callee", "caller", "edge_type").limit(limit)

    def get_symbols_with_files_for_repo(self, repo_id: str) -> DataFrame:
        return self.live_symbols().where(F.col("repo_id") == repo_id).select("id", "name", "file_path")

    def get_call_edges_for_repo(self, repo_id: str) -> DataFrame:
        return self.open("symbol_edges").where((F.col("repo_id") == repo_id) & F.col("edge_type").isin("calls", "imports") & F.col("to_id").isNotNull()).select("from_id", "to_id")

    def open_symbol_name_counts(self, repo_id: str) -> DataFrame:
        return self.live_symbols().where(F.col("repo_id") == repo_id).groupBy("name").agg(F.count("*").alias("n"))

    # git
    @staticmethod
    def pr_label(ref: Column) -> Column:
        return F.when(ref.rlike("^[0-9]+$"), F.concat(F.lit("#"), ref)).otherwise(ref)

    def fetch_commits_with_text(self, repo_id: str) -> DataFrame:
        return self.table("commits").where(F.col("repo_id") == repo_id).select("id", "sha", F.coalesce("message", F.lit("")).alias("message"))

    def fetch_commits_with_embeddings_all(self, repo_id: str) -> DataFrame:
        return self.table("commits").where((F.col("repo_id") == repo_id) & F.col("embedding").isNotNull())

    def find_commit_id_by_sha(self, wanted: DataFrame) -> DataFrame:
        return self.table("commits").join(wanted.select("repo_id", "sha").distinct(), ["repo_id", "sha"]).select("repo_id", "sha", "id")

    def find_pull_request_by_ref(self, wanted: DataFrame) -> DataFrame:
        return self.table("pull_requests").join(wanted.select("repo_id", "pr_ref").distinct(), ["repo_id", "pr_ref"]).select("repo_id", "pr_ref", "id", "enriched")

    def fetch_recent_commits_for_file(self, paths: DataFrame, n: int = 5) -> DataFrame:
        """(file_path, rank, sha, message, source_time): the newest commits touching each path."""
        touched = semi(self.table("commit_files"), "file_path", paths).select("file_path", F.col("commit_id").alias("id")).distinct().join(self.table("commits"), "id")
        w = Window.partitionBy("file_path").orderBy(F.desc("source_time"), "sha")
        return touched.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("file_path", "rank", "sha", "message", "source_time")

    def fetch_cochanged_files(self, path: str, n: int = 10) -> DataFrame:
        files = self.table("commit_files").select("commit_id", "file_path").distinct()
        own = files.where(F.col("file_path") == path).select("commit_id")
        peers = semi(files.where(F.col("file_path") != path), "commit_id", own)
        return peers.groupBy(F.col("file_path").alias("peer")).agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "peer").limit(n)

    # entities
    def list_open_entity_nodes(self, repo_id: str, entity_type: str | None = None) -> DataFrame:
        rows = self.open("entity_nodes").where(F.col("repo_id") == repo_id)
        return rows.where(F.col("entity_type").isNull() | (F.col("entity_type") == entity_type)) if entity_type else rows

    list_current_entity_nodes = list_open_entity_nodes

    def find_entity_nodes_by_name(self, repo_id: str, name: str, entity_type: str | None = None) -> DataFrame:
        return self.list_open_entity_nodes(repo_id, entity_type).where(F.lower("canonical_name") == name.lower())

    def decision_ids_mentioning_entities(self, ids: DataFrame, at: str = END) -> DataFrame:
        return semi(self.open("temporal_edges", at).where("edge_type = 'mentions'"), "target_id", ids).select(F.col("source_id").alias("decision_id")).distinct()

    def similar_entity_names(self, repo_id: str, name: str) -> DataFrame:
        """Up to three known names that share words with ``name``, best first."""
        want = tx.entity_tokens(F.lit(name))
        have = tx.entity_tokens(F.col("canonical_name"))
        rows = self.list_open_entity_nodes(repo_id).select("canonical_name", tx.jaccard(F.array_distinct(want), F.array_distinct(have)).alias("share")).distinct()
        return rows.where("share > 0 AND canonical_name <> ''").orderBy(F.desc("share"), "canonical_name").limit(3)

    # claims and evidence
    def claims_for_subject(self, subject_id: str) -> DataFrame:
        return self.open("claims").where(F.col("subject_id") == subject_id)

    def claims_for_subjects(self, ids: DataFrame) -> DataFrame:
        return semi(self.open("claims"), "subject_id", ids)

    def open_claims_for_repo(self, repo_id: str) -> DataFrame:
        return self.open("claims").where(F.col("repo_id") == repo_id)

    def claims_by_ids(self, ids: DataFrame) -> DataFrame:
        return semi(self.table("claims"), "id", ids)

    def anchors_for_claim(self, claim_id: str) -> DataFrame:
        return self.table("evidence_anchors").where(F.col("claim_id") == claim_id)

    def anchors_for_claims(self, ids: DataFrame) -> DataFrame:
        return semi(self.table("evidence_anchors"), "claim_id", ids)

    def open_anchors_for_repo(self, repo_id: str, limit: int | None = None) -> DataFrame:
        rows = self.anchors_for_claims(self.open_claims_for_repo(repo_id).select("id")).orderBy("id")
        return rows.limit(limit) if limit else rows

    def claim_ids_for_decisions(self, ids: DataFrame) -> DataFrame:
        """(id) of the open claims about the decisions and about their constraints."""
        own = self.find_constraints_for_decisions(ids).select("id")
        about = ids.select(F.col(ids.columns[0]).alias("id"), F.lit("decision").alias("kind")).unionByName(own.withColumn("kind", F.lit("constraint"))).distinct()
        claims = self.open("claims").select("id", F.col("subject_id"), F.col("subject_type").alias("kind"))
        return claims.join(about.withColumnRenamed("id", "subject_id"), ["subject_id", "kind"], "left_semi").select("id")

    def claim_ids_for_adr_doc(self, document_id: str) -> DataFrame:
        own = self.table("decisions").where(F.col("adr_id") == document_id).select("id")
        return self.open("claims").where((F.col("subject_type") == "adr") & (F.col("subject_id") == document_id)).select("id").unionByName(self.claim_ids_for_decisions(own)).distinct()

    def decision_and_adr_for_subject(self, claims: DataFrame) -> DataFrame:
        """(claim_id, decision_id, document_id) of claims (id, subject_type, subject_id)."""
        c = claims.select(F.col("id").alias("claim_id"), "subject_type", "subject_id")
        of = self.table("constraints").select(F.col("id").alias("_c"), "decision_id")
        c = c.join(of, (F.col("subject_type") == "constraint") & (F.col("subject_id") == F.col("_c")), "left")
        c = c.select("claim_id", "subject_type", "subject_id", F.when(F.col("subject_type") == "decision", F.col("subject_id")).otherwise(F.col("decision_id")).alias("decision_id"))
        parents = self.table("decisions").select(F.col("id").alias("decision_id"), F.col("adr_id").alias("_adr"))
        return c.join(parents, "decision_id", "left").select("claim_id", "decision_id", F.when(F.col("subject_type") == "adr", F.col("subject_id")).otherwise(F.col("_adr")).alias("document_id"))

    def latest_verification(self, commit_sha: str | None = None) -> DataFrame:
        """The newest verification of each anchor, at a commit if one is given."""
        rows = self.table("evidence_verifications")
        rows = rows.where(F.col("commit_sha") == commit_sha) if commit_sha else rows
        return first_by(rows, ["anchor_id"], F.desc("checked_at"), F.desc("id"))

    def drifted_evidence_decisions(self) -> DataFrame:
        """(decision_id, stale, lost): decisions with stale anchors by each anchor's newest verifications, ties all count."""
        newest = self.table("evidence_verifications").groupBy("anchor_id").agg(F.max("checked_at").alias("checked_at"))
        checks = self.table("evidence_verifications").join(newest, ["anchor_id", "checked_at"]).select(F.col("anchor_id").alias("id"), (F.col("freshness") == "stale").alias("stale"), F.coalesce("relocated", F.lit(False)).alias("relocated"))
        claims = self.decision_and_adr_for_subject(self.open("claims")).where("decision_id IS NOT NULL")
        rows = self.table("evidence_anchors").select("id", "claim_id").join(claims, "claim_id").join(checks, "id")
        return rows.groupBy("decision_id").agg(F.count_if("stale").alias("stale"), F.count_if(F.col("stale") & ~F.col("relocated")).alias("lost")).where("stale > 0")

    def index_lanes(self, repo_id: str) -> DataFrame:
        return self.table("index_lanes").where(F.col("repo_id") == repo_id).orderBy("lane")

    def cached_freshness_manifest(self, repo_id: str, tool: str, view_hash: str, commit: str) -> DataFrame:
        rows = self.table("freshness_manifests").where((F.col("repo_id") == repo_id) & (F.col("tool") == tool) & (F.col("view_hash") == view_hash) & (F.col("repo_commit") == commit))
        return rows.orderBy(F.desc("evaluated_at"), "id").limit(1).select("payload")

    # temporal edges
    def count_open_temporal_edges_of_type(self, edge_type: str) -> DataFrame:
        return self.open("temporal_edges").where(F.col("edge_type") == edge_type).agg(F.count("*").alias("n"))

    def temporal_edges_for_evidence(self, evidence_id: str) -> DataFrame:
        return self.table("temporal_edges").where(F.array_contains("evidence_refs", evidence_id))

    def open_conflict_edges_for_decisions(self, ids: DataFrame) -> DataFrame:
        e = self.open("temporal_edges").where("edge_type = 'conflicts_with'")
        return semi(e, "source_id", ids).unionByName(semi(e, "target_id", ids)).dropDuplicates(["id"])

    def fetch_impact_edges(self, ids: DataFrame, kinds: tuple[str, ...], at: str = END) -> DataFrame:
        return semi(self.open("temporal_edges", at).where(F.col("edge_type").isin(*kinds)), "source_id", ids)

    def impact_of(self, root: str, depth: int = 3, kinds: tuple[str, ...] = IMPACT_EDGES, at: str = END) -> DataFrame:
        e = self.open("temporal_edges", at).where(F.col("edge_type").isin(*kinds)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        return graph.reachable(e, self.spark.createDataFrame([(root,)], "node string"), depth)

    def graph_neighbor_decisions(self, ids: DataFrame, depth: int = 1, at: str = END) -> DataFrame:
        """(id, depth): decisions within ``depth`` steps over decision edges either way, and over commits that back both."""
        e = self.open("temporal_edges", at)
        own = e.where(F.col("edge_type").isin(*DECISION_EDGES) & (F.col("source_type") == "decision") & (F.col("target_type") == "decision")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        backs = e.where("edge_type = 'evidences' AND target_type = 'decision'").select(F.col("source_id").alias("c"), F.col("target_id").alias("d")).distinct()
        # a commit is a node of its own, two steps are one hop: no pairs of the decisions of a commit are made
        node = lambda c, kind: F.concat(F.lit(kind), c)
        direct = own.select(node(F.col("src"), "d:").alias("src"), node(F.concat_ws("|", "src", "dst"), "e:").alias("dst")).union(own.select(node(F.concat_ws("|", "src", "dst"), "e:"), node(F.col("dst"), "d:")))
        bridged = backs.select(node(F.col("d"), "d:").alias("src"), node(F.col("c"), "c:").alias("dst"))
        both = direct.union(bridged)
        both = both.union(both.select("dst", "src"))
        seeds = ids.select(node(F.col(ids.columns[0]), "d:").alias("node"))
        found = graph.reachable(both, seeds, 2 * depth)
        return found.where("node LIKE 'd:%' AND depth > 0").select(F.expr("substring(node, 3)").alias("id"), F.expr("depth DIV 2").cast("int").alias("depth"))

    def supersession_chain(self, document_id: str, max_hops: int = 10, forward: bool = False) -> DataFrame:
        """(id, hops): documents this one supersedes, or with ``forward`` those that supersede it."""
        a, b = ("superseded_id", "superseder_id") if forward else ("superseder_id", "superseded_id")
        e = self.table("supersession_edges").select(F.col(a).alias("src"), F.col(b).alias("dst"))
        return graph.reachable(e, self.spark.createDataFrame([(document_id,)], "node string"), max_hops).where("depth > 0").select(F.col("node").alias("id"), F.col("depth").alias("hops"))

    def get_supersession_predecessors(self, document_id: str, max_hops: int = 10) -> DataFrame:
        return self.supersession_chain(document_id, max_hops)

    def get_supersession_successors(self, document_id: str, max_hops: int = 10) -> DataFrame:
        return self.supersession_chain(document_id, max_hops, forward=True)

    # history
    def trace_symbol_spans(self, name: str, start: str, end: str) -> DataFrame:
        return overlapping(self.table("symbols").where(F.col("name") == name), instant(start), instant(end))

    def trace_decisions_for_files(self, paths: DataFrame, start: str, end: str) -> DataFrame:
        return semi(overlapping(self.decision_view(), instant(start), instant(end)), "id", semi(self.table("decision_code_links"), "file_path", paths).select("decision_id"))

    def trace_constraints_for_decisions(self, ids: DataFrame, start: str, end: str) -> DataFrame:
        return semi(overlapping(self.table("constraints"), instant(start), instant(end)), "decision_id", ids)

    def trace_commits_for_decisions(self, ids: DataFrame, start: str, end: str) -> DataFrame:
        links = semi(self.table("decision_git_links").where("ref_type = 'commit'"), "decision_id", ids).select("decision_id", F.col("ref_id").alias("id")).distinct()
        return links.join(self.table("commits"), "id").where(F.col("source_time").between(instant(start), instant(end))).select("decision_id", "id", "sha", "source_time")

    def trace_episodes_for_decisions(self, ids: DataFrame, start: str, end: str) -> DataFrame:
        own = semi(self.table("decisions"), "id", ids).select(F.col("id").alias("decision_id"), F.col("episode_id").alias("id"))
        return own.join(self.table("episodes"), "id").where(F.col("occurred_at").between(instant(start), instant(end))).select("decision_id", "id", "source", "occurred_at")

    def diff(self, name: str, start: str, end: str) -> DataFrame:
        return diff_in_range(self.table(name), instant(start), instant(end)).select("id", "change")

    def diff_decisions_in_range(self, start: str, end: str) -> DataFrame:
        return self.diff("decisions", start, end)

    def diff_constraints_in_range(self, start: str, end: str) -> DataFrame:
        return self.diff("constraints", start, end)

    def diff_adrs_in_range(self, start: str, end: str) -> DataFrame:
        return self.diff("adr_documents", start, end)

    # staleness and orphans
    def stale_decisions_deleted_files(self) -> DataFrame:
        """(decision_id, file_path): open decisions linked to a path that had a file and has none alive."""
        files = self.table("files").groupBy(F.col("path").alias("file_path")).agg(F.max(F.col("valid_to").isNull()).alias("alive")).where(~F.col("alive")).select("file_path")
        links = self.open("decision_code_links").select("decision_id", "file_path").distinct().join(files, "file_path")
        return semi(links.select("decision_id", "file_path"), "decision_id", self.open("decisions").select("id"))

    def stale_decisions_missing_symbols(self) -> DataFrame:
        """(decision_id, file_path): linked live files that had symbols and have none alive."""
        counts = self.table("symbols").groupBy("file_id").agg(F.count_if(F.col("valid_to").isNull()).alias("alive"), F.count_if(F.col("valid_to").isNotNull()).alias("closed")).where("alive = 0 AND closed > 0")
        paths = self.open("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path")).join(counts, "file_id").select("file_path")
        links = self.open("decision_code_links").select("decision_id", "file_path").distinct().join(paths.distinct(), "file_path")
        return semi(links.select("decision_id", "file_path"), "decision_id", self.open("decisions").select("id"))

    def stale_decisions_no_recent_activity(self, since: str) -> DataFrame:
        links = self.table("decision_git_links").where("ref_type = 'commit'").select("decision_id", F.col("ref_id").alias("id")).distinct().join(self.table("commits").select("id", "source_time"), "id")
        last = links.groupBy("decision_id").agg(F.max("source_time").alias("last")).where(F.col("last") < instant(since))
        return semi(last.select("decision_id"), "decision_id", self.open("decisions").select("id"))

    def stale_decisions_aged(self, since: str) -> DataFrame:
        """(decision_id): open decisions of accepted documents without a successor that began before ``since``."""
        gone = self.table("supersession_edges").select(F.col("superseded_id").alias("id")).distinct()
        docs = self.open("adr_documents").where("lower(status) = 'accepted' AND superseded_by IS NULL").select("id").join(gone, "id", "left_anti")
        return semi(self.open("decisions").where(F.col("valid_from") < instant(since)), "adr_id", docs).select(F.col("id").alias("decision_id"))

    def find_stale_decisions(self, since: str, min_confidence: float = 0.0) -> DataFrame:
        """(decision_id, confidence, signals): the strongest of five signals and the names of all."""
        drift = self.drifted_evidence_decisions()
        signals = [
            (self.stale_decisions_deleted_files(), "deleted_file", F.lit(0.85)), (self.stale_decisions_missing_symbols(), "missing_symbols", F.lit(0.7)),
            (self.stale_decisions_no_recent_activity(since), "inactive", F.lit(0.45)), (self.stale_decisions_aged(since), "aged", F.lit(0.35)), (drift, "drifted_evidence", F.when(F.col("lost") > 0, 0.8).otherwise(0.6)),
        ]
        union = reduce(DataFrame.unionByName, [df.select("decision_id", F.lit(name).alias("signal"), c.alias("c")).distinct() for df, name, c in signals])
        found = union.groupBy("decision_id").agg(F.max("c").alias("confidence"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))  # five names at most
        return found.where(F.col("confidence") >= min_confidence)

    def find_orphaned_files(self, prefix: str = "") -> DataFrame:
        """(repo_id, path): live files no open link of a decision of their repository names."""
        view = self.decision_view().select(F.col("id").alias("decision_id"), "repo_id")
        linked = self.open("decision_code_links").select("decision_id", F.col("file_path").alias("path")).join(view, "decision_id").select("repo_id", "path").distinct()
        return self.open("files").where(F.col("path").startswith(prefix)).select("repo_id", "path").join(linked, ["repo_id", "path"], "left_anti")

    def find_orphaned_symbols(self, prefix: str = "") -> DataFrame:
        """(id, name, file_path): live symbols whose name no open link has."""
        named = self.open("decision_code_links").where("symbol IS NOT NULL").select(F.col("symbol").alias("name")).distinct()
        return self.live_symbols().where(F.col("file_path").startswith(prefix)).join(named, "name", "left_anti").select("id", "name", "file_path")

    # aggregates and declared facts
    def index_status_counts(self) -> DataFrame:
        """(family, total, embedded, last_ingested, coverage) of the seven families that carry vectors."""
        out = []
        for name in EMBEDDED:
            total, filled = F.count("*"), F.count("embedding")
            out.append(self.table(name).agg(total.alias("total"), filled.alias("embedded"), F.max("ingested_at").alias("last_ingested")).select(F.lit(name).alias("family"), "total", "embedded", "last_ingested"))
        return reduce(DataFrame.unionByName, out).withColumn("coverage", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("embedded") / F.col("total")), 6))

    def get_communities_for_repo(self, repo_id: str) -> DataFrame:
        """(id, label, files, symbols): the distinct files and symbol names of each open community, counted and listed in order."""
        members = self.open("communities").where(F.col("repo_id") == repo_id).select("id", "label").join(self.table("community_members").withColumnRenamed("community_id", "id"), "id")
        s = self.live_symbols().select(F.col("id").alias("symbol_id"), "name", "file_path")
        return members.join(s, "symbol_id").groupBy("id", "label").agg(F.array_sort(F.collect_set("file_path")).alias("files"), F.array_sort(F.collect_set("name")).alias("symbols"))

    @staticmethod
    def _fact(df: DataFrame, kind: str, *parts: Column | str) -> DataFrame:
        cols = [F.col(p) if isinstance(p, str) else p for p in parts]
        return df.select(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("fact"))

    def adr_declared_facts(self, repo_id: str) -> DataFrame:
        """(fact): natural keys of the latest version of each document, its supersessions, the links its text declares, its decisions and constraints."""
        all_docs = self.table("adr_documents").where(F.col("repo_id") == repo_id)
        docs = first_by(all_docs, ["adr_id"], F.desc("ingested_at"), F.desc("valid_from"), F.desc("id"))
        c, state = F.format_string("%.2f", "confidence"), F.when(F.col("valid_to").isNull(), "open").otherwise("closed")
        of = self.table("decisions").select(F.col("id").alias("decision_id"), F.col("adr_id").alias("id")).join(all_docs.select("id", "adr_id"), "id").drop("id")
        edges = self.open("temporal_edges")
        a, b = docs.select(F.col("id").alias("superseder_id"), F.col("adr_id").alias("newer")), docs.select(F.col("id").alias("superseded_id"), F.col("adr_id").alias("older"))
        texts = self.table("constraints").select(F.col("id").alias("target_id"), "text")
        imposed = edges.where("edge_type = 'imposes'").join(of.withColumnRenamed("decision_id", "source_id"), "source_id").join(texts, "target_id")
        return reduce(DataFrame.unionByName, [
            self._fact(docs, "adr", "adr_id", "status", state, "title"),
            self._fact(self.table("supersession_edges").join(a, "superseder_id").join(b, "superseded_id"), "supersedes", "newer", "older"),
            self._fact(self.open("decision_code_links").where("link_source = 'adr_text'").join(of, "decision_id"), "link", "adr_id", "file_path", "symbol", "link_type", c),
            self._fact(edges.where("edge_type = 'defines'").join(of.withColumnRenamed("decision_id", "target_id"), "target_id"), "defines", "adr_id", c),
            self._fact(imposed, "imposes", "adr_id", "text", c),
        ])

    def symbol_declared_facts(self, repo_id: str) -> DataFrame:
        """(fact): natural keys of live symbols, open edges, imports and routes."""
        files = self.table("files").select(F.col("id").alias("file_id"), F.col("path"), F.col("repo_id").alias("_repo"))
        s = self.table("symbols").join(files, "file_id")
        c = F.format_string("%.2f", "confidence")
        ends = lambda p: s.select(F.col("id").alias(f"{p}_id"), F.col("path").alias(f"{p}_path"), F.col("name").alias(f"{p}_symbol"))
        edges = self.open("symbol_edges").where(F.col("repo_id") == repo_id).join(ends("from"), "from_id").join(ends("to"), "to_id", "left")
        to_file = files.select(F.col("file_id").alias("target_file_id"), F.col("path").alias("to_path"))
        to_symbol = self.table("symbols").select(F.col("id").alias("target_symbol_id"), F.col("name").alias("to_symbol"))
        imports = self.open("file_imports").join(files.where(F.col("_repo") == repo_id), "file_id").join(to_file, "target_file_id", "left").join(to_symbol, "target_symbol_id", "left")
        handlers = self.table("symbols").select(F.col("id").alias("handler_id"), F.col("name").alias("handler"))
        live = s.where(in_force(instant(END)) & (F.col("_repo") == repo_id))
        return reduce(DataFrame.unionByName, [
            self._fact(live, "symbol", "path", "kind", "name", "line", "end_line", "signature", "return_type", "visibility", F.col("is_async").cast("int"), "complexity", F.to_json("decorators")),
            self._fact(edges, "edge", "from_path", "from_symbol", "edge_type", "to_path", F.coalesce("to_symbol", "to_name"), "resolution", c),
            self._fact(imports, "import", "path", "name", "spec", "to_path", "to_symbol"),
            self._fact(self.open("routes").where(F.col("repo_id") == repo_id).join(handlers, "handler_id", "left"), "route", "method", "path", "framework", F.concat_ws(":", "file_path", "line"), "handler", c),
        ])

    # search
    def search_decisions_ranked(self, words: list[str], repo_id: str, at: str = END, min_confidence: float = 0.0) -> DataFrame:
        """(id, score, confidence, title, rank): decisions that hold a word, by occurrences, confidence and title."""
        body = F.lower(F.concat_ws(" ", "title", "text"))
        hit = self.decision_view().where(in_force(instant(at)) & (F.col("repo_id") == repo_id) & (F.col("confidence") >= min_confidence)).withColumn("score", tx.term_frequency(body, words)).where("score > 0")
        return retrieval.ranked_whole(hit.select("id", "score", "confidence", "title"), [F.desc("score"), F.desc("confidence"), F.col("title"), F.col("id")])

    def search_decisions(self, words: list[str], repo_id: str) -> DataFrame:
        return self.search_decisions_ranked(words, repo_id)

    def semantic_decisions_if_available(self, vector: list[float] | None, repo_id: str, at: str = END, min_confidence: float = 0.0, threshold: float = 0.3) -> DataFrame | None:
        """(id, cosine, confidence, title, rank); None without a query vector."""
        if not vector:
            return None
        rows = self.fetch_decisions_with_embeddings(repo_id, at).where((F.col("confidence") >= min_confidence) & (F.size("embedding") > 0))
        q = F.array(*[F.lit(float(x)) for x in vector])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")) * F.lit(sum(x * x for x in vector)))
        cosine = F.when((F.size("embedding") == len(vector)) & (norm > 0), dot(F.col("embedding"), q) / norm).otherwise(0.0)
        hit = rows.select("id", cosine.alias("cosine"), "confidence", "title").where(F.col("cosine") >= threshold)
        return retrieval.ranked_whole(hit, [F.desc("cosine"), F.desc("confidence"), F.col("title"), F.col("id")])

    def query(self, words: list[str], repo_id: str, vector: list[float] | None = None, at: str = END, top_k: int = 10, graph_depth: int = 1, min_confidence: float = 0.0) -> DataFrame:
        """Decisions by keyword, vector and graph, fused: (id, score, confidence, title, status, snippet, constraints).

        The first five of both lists, repeats included, are the seeds of the graph list, which keeps
        the order of discovery. Lists are ranked whole; ties of the sum go by confidence and title.
        """
        keyword = self.search_decisions_ranked(words, repo_id, at, min_confidence)
        semantic = self.semantic_decisions_if_available(vector, repo_id, at, min_confidence)
        lists = {"keyword": keyword} | ({"semantic": semantic} if semantic is not None else {})
        seeds = reduce(DataFrame.unionByName, [df.where("rank <= 5").select("id", "rank", F.lit(i).alias("list")) for i, df in enumerate(lists.values())]).orderBy("list", "rank").limit(5)
        view = self.decision_view().where(in_force(instant(at)) & (F.col("repo_id") == repo_id) & (F.col("confidence") >= min_confidence))
        near = self.graph_neighbor_decisions(seeds.select("id"), min(graph_depth, 2), at).join(view.select("id"), "id", "left_semi")
        lists["graph"] = retrieval.ranked_whole(near, [F.col("depth"), F.col("id")])
        fused = retrieval.fuse_all({k: df.select("id", "rank") for k, df in lists.items()}, "id")
        top = fused.join(view.select("id", "confidence", "title", "status", "text"), "id").orderBy(F.desc("score"), F.desc("confidence"), "title", "id").limit(top_k)
        rules = self.open("constraints", at).groupBy(F.col("decision_id").alias("id")).agg(F.array_sort(F.collect_list(tx.snippet(F.col("text"), 160))).alias("constraints"))
        return top.join(rules, "id", "left").select("id", "score", "found_by", "confidence", "title", "status", tx.snippet(F.col("text"), 280).alias("snippet"), "constraints")

    # vectors
    def without_embeddings(self, name: str) -> DataFrame:
        """(id, text) of the rows of a family that lack a vector and have a text to make one from."""
        text = F.concat_ws("\n", "title", "body") if name == "pull_requests" else F.col(EMBEDDED[name])
        rows = self.table(name).where("embedding IS NULL").select("id", text.alias("text"))
        return rows.where(F.length(F.trim("text")) > 0)

    def update_embeddings(self, name: str, vectors: DataFrame) -> Store:
        """Vectors (id, embedding) written into a family."""
        new = vectors.groupBy("id").agg(F.max("embedding").alias("_new"))
        rows = self.table(name)
        return self.with_tables(**{name: rows.join(new, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(*rows.columns)})
