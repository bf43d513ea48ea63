"""The public tools: one method per tool over the tables of a folder, each returning a lazy DataFrame."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import graph, integrity, retrieval, rules, temporal, verification
from chronoweave.operators.dedup import exact_groups
from chronoweave.operators.hierarchy import reference_number
from chronoweave.operators.temporal import in_force, instant
from chronoweave.plans.problems import _orphans, _supersession
from chronoweave.sources.code import extract_files
from chronoweave.sources.markdown import parse_record, read_records
from chronoweave.sources.providers import Embed, backfill
from chronoweave.sources.tables import table

TABLES = ("repository", "adr_document", "episode", "decision", "decision_git_link", "decision_merge", "symbol_span", "symbol_edge", "parsed_adr")
FOREVER = "9999-12-31 23:59:59"
#: Most hops a query expands its seeds by, and seeds it expands.
HOPS, SEEDS = 2, 5


class Workspace:
    """Tools over one folder of tables. Nothing runs before the returned frame is read, but for traversals, check_consistency and ranked lists."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    def decisions(self, at: str = FOREVER) -> DataFrame:
        view = temporal.decision_view(self.table("decision"), self.table("adr_document"), self.table("episode"))
        return view.where(in_force(instant(at)))

    # retrieval
    def _ranked(self, text: str, at: str, depth: int, least: float) -> dict[str, DataFrame]:
        words = [w for w in re.split(r"[^\w]+|_", text.lower()) if len(w.encode()) >= 3]
        if not words:
            raise ValueError("the text has no term of three bytes")
        view = self.decisions(at).where(F.col("confidence") >= least)
        body = F.lower(F.concat_ws(" ", "title", "text"))
        hit = view.withColumn("score", tx.term_frequency(body, words)).where("score > 0")
        keyword = retrieval.ranked_whole(hit.select("id", "score", "confidence", "title", "parent_id"), [F.desc("score"), F.desc("confidence"), F.col("title"), F.col("id")])
        seeds = keyword.where(F.col("rank") <= SEEDS).select(F.col("parent_id").alias("node"))
        kin = view.select("id", F.col("parent_id"), "source_uri")
        bridge = self.table("decision_git_link", "decision_uri", "ref_id").distinct()
        # decisions of a document, and documents whose decisions share a reference
        linked = bridge.join(kin.select(F.col("source_uri").alias("decision_uri"), "parent_id"), "decision_uri").select("ref_id", "parent_id").distinct()
        edges = linked.withColumnRenamed("parent_id", "src").join(linked.withColumnRenamed("parent_id", "dst"), "ref_id").where("src <> dst").select("src", "dst")
        near = graph.reachable(edges, seeds, min(depth, HOPS)).withColumnRenamed("node", "parent_id")
        found = kin.join(near, "parent_id").groupBy("id").agg(F.min("depth").alias("depth"))
        graph_list = retrieval.ranked_whole(found, [F.col("depth"), F.col("id")])
        return {"keyword": keyword.select("id", "rank"), "graph": graph_list.select("id", "rank")}

    def query(self, text: str, valid_at: str = FOREVER, top_k: int = 10, graph_depth: int = 1, min_confidence: float = 0.0) -> DataFrame:
        """Decisions found by keyword and graph, fused by reciprocal ranks, with a snippet of each."""
        fused = retrieval.fuse(self._ranked(text, valid_at, graph_depth, min_confidence), "id", top_k)
        return fused.join(self.decisions(valid_at), "id").select("id", "score", "found_by", "title", "status", "confidence", tx.snippet(F.col("text"), 280).alias("snippet")).orderBy(F.desc("score"), F.desc("confidence"), "title", "id")

    def explain_answer(self, text: str, valid_at: str = FOREVER) -> DataFrame:
        return retrieval.explain(self._ranked(text, valid_at, 1, 0.0), "id")

    def propose_links(self, text: str, limit: int = 5) -> DataFrame:
        """Decisions and symbols a text may be about: scores are shares of the best term count."""
        words = sorted({w for w in re.split(r"[^\w]+|_", text.lower()) if len(w.encode()) >= 3})
        tf = tx.term_frequency(F.concat_ws(" ", "title", "text"), words or ["\0"])
        d = self.decisions().select(F.lit("decision").alias("kind"), "id", tf.alias("n"))
        s = self.table("symbol_span", "id", "name", "valid_to").where("valid_to IS NULL").select(F.lit("symbol").alias("kind"), "id", tx.term_frequency(F.col("name"), words or ["\0"]).alias("n")).distinct()
        both = d.unionByName(s).where("n > 0")
        best = F.broadcast(both.groupBy("kind").agg(F.max("n").alias("most")))  # two rows
        w = Window.partitionBy("kind").orderBy(F.desc("n"), "id")
        return both.join(best, "kind").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("kind", "id", F.round(F.col("n") / F.col("most"), 2).alias("score"))

    # code
    def find_decisions_for_code(self, uri_part: str, valid_at: str = FOREVER, event_time: bool = True) -> DataFrame:
        """Decisions whose address contains a path segment, governing at an instant by event or recorded time."""
        part = "/" + uri_part.strip("/").replace("\\", "/").lower() + "/"
        view = temporal.decision_view(self.table("decision"), self.table("adr_document"), self.table("episode"))
        hit = view.where(F.contains(F.lower(F.concat(F.lit("/"), F.translate("source_uri", "\\#", "//"), F.lit("/"))), F.lit(part)))
        return temporal.as_of_event(hit, instant(valid_at), ("effective_from", "occurred_at", "valid_from"), ("effective_to", "valid_to")) if event_time else temporal.as_of(hit, instant(valid_at))

    def _spans(self, at: str) -> DataFrame:
        return self.table("symbol_span", "id", "repo_id", "name", "kind", "file_path", "valid_from", "valid_to").where(in_force(instant(at))).select("id", "repo_id", "name", "kind", "file_path").distinct()

    def _edges(self, least: float = 0.0, kinds: tuple[str, ...] = ()) -> DataFrame:
        e = self.table("symbol_edge", "from_id", "to_id", "edge_type", "confidence", "valid_to").where((F.col("confidence") >= least) & F.col("to_id").isNotNull() & F.col("valid_to").isNull())
        return (e.where(F.col("edge_type").isin(*kinds)) if kinds else e).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_type", "confidence").distinct()

    def focused_file_brief(self, file_path: str, limit: int = 30) -> DataFrame:
        """Exports, callers from and callees in other files of one file, as rows of a tagged union."""
        spans = self._spans(FOREVER)
        own = spans.where(F.col("file_path") == file_path)
        e = self._edges()
        other = spans.where(F.col("file_path") != file_path)
        callers = e.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").join(other.withColumnRenamed("id", "src"), "src")
        callees = e.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(other.withColumnRenamed("id", "dst"), "dst")
        pick = lambda df, tag: df.select(F.lit(tag).alias("section"), "name", "kind", "file_path", "confidence").distinct().orderBy(F.desc("confidence"), "name", "file_path").limit(limit)
        return pick(own.withColumn("confidence", F.lit(1.0)), "export").unionByName(pick(callers, "caller")).unionByName(pick(callees, "callee"))

    def trace_call_path(self, name: str, direction: str = "outbound", depth: int = 4, min_confidence: float = 0.5) -> DataFrame:
        e = self._edges(min_confidence, ("calls",)).select("src", "dst")
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        links = {"outbound": e, "inbound": back, "both": e.unionByName(back)}[direction]
        named = self._spans(FOREVER).where((F.col("name") == name) | F.col("name").endswith(f"::{name}"))
        first = named.orderBy((F.col("name") != name), "id").limit(1).select(F.col("id").alias("node"))
        return graph.reachable(links, first, depth)

    def impact_of(self, root: str, depth: int = 3, kinds: tuple[str, ...] = ("calls", "imports", "inherits", "implements", "uses_type")) -> DataFrame:
        e = self._edges(0.0, kinds).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return graph.reachable(e, self.spark.createDataFrame([(root,)], "node string"), depth)

    def trace_symbol_history(self, symbol_id: str, start: str, end: str) -> DataFrame:
        rows = temporal.overlapping(self.table("symbol_span").where(F.col("id") == symbol_id), instant(start), instant(end))
        seen = rows.select(F.col("valid_from").alias("t"), F.lit("seen").alias("event"), "name", "kind", "file_path")
        gone = rows.where("valid_to IS NOT NULL").select(F.col("valid_to").alias("t"), F.lit("ended").alias("event"), "name", "kind", "file_path")
        return seen.unionByName(gone).distinct().orderBy("t", "event")

    def find_orphaned_code(self, prefix: str = "", links: DataFrame | None = None) -> DataFrame:
        """(id, name, file_path): live symbols under ``prefix`` whose name no link (symbol) of a decision has. The project's tables hold no such links."""
        spans = self._spans(FOREVER).where(F.col("file_path").startswith(prefix)).select("id", "name", "file_path")
        return spans if links is None else spans.join(links.select(F.col("symbol").alias("name")).where("name IS NOT NULL").distinct(), "name", "left_anti").select("id", "name", "file_path")

    def get_graph_snapshot(self, focus: str | None = None, depth: int = 2) -> DataFrame:
        """Edges of the whole symbol graph, or of what lies within ``depth`` (1 to 6) of the symbols named like ``focus``."""
        e = self._edges()
        if focus is None:
            return e
        spans = self._spans(FOREVER)
        seeds = spans.where(F.col("name") == focus).select(F.col("id").alias("node"))
        if seeds.isEmpty():
            seeds = spans.where(F.contains(F.lower("name"), F.lit(focus.lower()))).orderBy("name", "id").limit(30).select(F.col("id").alias("node"))
        both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = graph.reachable(both, seeds, max(1, min(depth, 6))).select(F.col("node").alias("src"))
        inner = near.withColumnRenamed("src", "n")
        out = e.join(inner, F.col("src") == F.col("n"), "left_semi")
        return out.unionByName(e.join(inner, F.col("dst") == F.col("n"), "left_semi")).distinct()

    # rules and evidence
    def _constraints(self) -> DataFrame:
        return rules.constraints(self.decisions(), "id", "text", ["repo_id"])

    def inspect_change(self, files: list[str]) -> DataFrame:
        return rules.violations(self.spark.createDataFrame([(f,) for f in files], "file string"), self._constraints(), "id")

    def check_consistency(self) -> DataFrame:
        return rules.contradictions(self._constraints(), "repo_id", "id")

    def verify_claims(self, anchors: DataFrame | None = None, texts: DataFrame | None = None, symbols: DataFrame | None = None, reachable: DataFrame | None = None) -> DataFrame:
        """(source_uri, disposition) of each decision by its anchors against the present (see ``verify_anchors``).

        Without ``anchors`` a decision rests on the commits and requests its links name; ``reachable``
        are the commits (sha) of the present history, by default those the links know.
        """
        claims = self.table("decision", F.col("source_uri").alias("id")).where("id IS NOT NULL").distinct()
        if anchors is None:
            none = lambda kind: F.lit(None).cast(kind)
            anchors = self.table("decision_git_link", "id", F.col("decision_uri").alias("claim_id"), F.col("ref_type").alias("source_kind"), F.col("ref_id").alias("source_uri")).distinct().withColumns(
                {"subpath": F.lit(""), "anchored_text": F.lit(""), "start_line": none("int"), "end_line": none("int")}
            )
        if reachable is None:
            reachable = self.table("decision_git_link", "ref_type", F.col("ref_id").alias("sha")).where("ref_type = 'commit'").select("sha").distinct()
        texts = self.spark.createDataFrame([], "source_uri string, text string") if texts is None else texts
        verified = verification.verify_anchors(anchors, texts, symbols, reachable)
        return verification.claim_dispositions(claims, verified).select(F.col("claim_id").alias("source_uri"), "disposition", "anchors", "stale")

    def find_stale_decisions(self, since: str, min_confidence: float = 0.0) -> DataFrame:
        rows = self.table("decision", "source_uri", "valid_from", "valid_to").where("valid_to IS NULL").groupBy("source_uri").agg(F.min("valid_from").alias("first"))
        last = self.table("decision_git_link", F.col("decision_uri").alias("source_uri"), "source_time").groupBy("source_uri").agg(F.max("source_time").alias("last"))
        both = rows.join(last, "source_uri", "left")
        signals = {"inactive": (both.where(F.col("last") < instant(since)), 0.45), "aged": (both.where(F.col("first") < instant(since)), 0.35), "unlinked": (both.where("last IS NULL"), 0.7)}
        return rules.fuse_signals(signals, "source_uri").where(F.col("confidence") >= min_confidence)

    def find_dangling_references(self) -> DataFrame:
        return _orphans(self.spark, self.folder)

    def dedup_decisions(self) -> DataFrame:
        """Exact duplicates; near ones are the pairs of problem 4."""
        return exact_groups(self.table("decision", "id", "text", "valid_from"), "id", "text", "valid_from")

    def verify_index_integrity(self, rebuilt: DataFrame) -> DataFrame:
        """clean or divergent: the documents of the tables against rebuilt rows (repo_id, adr_id, title)."""
        key = integrity.natural_key(F.col("repo_id"), F.col("adr_id"), F.col("title")).alias("key")
        live = self.table("adr_document", "repo_id", "adr_id", "title", "valid_to").where("valid_to IS NULL").select("repo_id", "adr_id", "title").distinct()
        return integrity.verdict(integrity.surplus(live.select(key), rebuilt.select("repo_id", "adr_id", "title").distinct().select(key), "key"))

    # documents
    def adr_lineage(self, repo_id: str, number: str, max_hops: int = 10) -> DataFrame:
        """(name, side, hops): predecessors and successors of a document given as '3', '0003' or with a prefix."""
        docs = self.table("adr_document", "repo_id", "adr_id", "supersedes", "superseded_by").where(F.col("repo_id") == repo_id)
        own = reference_number(F.col("adr_id"))
        older = docs.select(own.alias("src"), F.explode("supersedes").alias("r")).select("src", reference_number(F.col("r")).alias("dst"))
        newer = docs.select(reference_number(F.col("superseded_by")).alias("src"), own.alias("dst"))
        down = older.unionByName(newer).where("src IS NOT NULL AND dst IS NOT NULL").join(docs.select(own.alias("dst")).distinct(), "dst", "left_semi").join(docs.select(own.alias("src")).distinct(), "src", "left_semi")
        seed = self.spark.createDataFrame([(number,)], "n string").select(reference_number(F.col("n")).alias("node"))
        before = graph.reachable(down, seed, max_hops).withColumn("side", F.lit("predecessor"))
        after = graph.reachable(down.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed, max_hops).withColumn("side", F.lit("successor"))
        return before.unionByName(after).where("depth > 0").select(F.col("node").alias("number"), "side", F.col("depth").alias("hops"))

    def hierarchies(self) -> DataFrame:
        return _supersession(self.spark, self.folder)

    def diff_architecture(self, start: str, end: str) -> DataFrame:
        parts = [temporal.diff_in_range(self.table(t, "id", "valid_from", "valid_to"), instant(start), instant(end)).select(F.lit(t).alias("kind"), "id", "change").distinct() for t in ("decision", "adr_document", "symbol_span")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def validate_adr(self, path: str, text: str) -> list[str]:
        return parse_record(path, text)["errors"]

    def generate_adr_draft(self, repo_id: str, title: str, context: str) -> str:
        n = self.table("adr_document", "repo_id", "adr_id").where(F.col("repo_id") == repo_id).agg(F.max(reference_number(F.col("adr_id")).try_cast("long"))).first()[0]
        return f"# ADR-{(n or 0) + 1:04d}: {title}\n\n## Status\n\nProposed\n\n## Context\n\n{context}\n\n## Decision\n\n\n## Consequences\n"

    @staticmethod
    def generate_adr_patch(path: str, before: str, after: str) -> str:
        return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))

    # administration
    def list_repos(self) -> DataFrame:
        return self.table("repository").distinct().orderBy("name")

    def delete_repo(self, repo_id: str) -> dict[str, DataFrame]:
        """What remains of each table that names its repository; nothing is overwritten in place."""
        return {t: self.table(t).where(~F.col("repo_id").eqNullSafe(F.lit(repo_id))) for t in ("adr_document", "episode", "symbol_span", "symbol_edge", "parsed_adr")}

    def get_graph_schema(self) -> DataFrame:
        rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t in TABLES for f in self.table(t).schema.fields]
        return self.spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")

    def index_status(self) -> DataFrame:
        out = None
        for t in TABLES:
            one = self.table(t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def get_architecture(self, limit: int = 30) -> DataFrame:
        """The largest communities of the symbol graph, by label propagation over calls and imports."""
        labels = graph.label_propagation(self._edges(0.0, ("calls", "imports")).select("src", "dst"), 20)
        return labels.groupBy("label").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "label").limit(limit)

    def retract(self, episode_id: str, at: str) -> DataFrame:
        """The decision table with the open decisions of an episode closed."""
        rows = self.table("decision")
        keys = rows.where(F.col("episode_id") == episode_id).select("id")
        return temporal.close(rows, keys, ["id"], instant(at))

    def record_decision_episode(self, rows: DataFrame) -> DataFrame:
        """The decision table with new rows appended, unless one of the same normal text is open already."""
        state = self.table("decision")
        known = state.where("valid_to IS NULL").select(tx.content_hash(F.col("text")).alias("h")).distinct()
        fresh = rows.withColumn("h", tx.content_hash(F.col("text"))).dropDuplicates(["h"]).join(known, "h", "left_anti")
        return state.unionByName(fresh.select(*state.columns))

    # ingestion
    def sync_adrs(self, folder: str) -> DataFrame:
        return read_records(self.spark, folder)

    def ingest_symbols(self, folder: str, glob: str = "*") -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
        return extract_files(files.select("path", F.col("content").cast("string").alias("text")))

    def sync_incremental(self, files: DataFrame, known: DataFrame) -> DataFrame:
        """Files (path, text) whose content differs from the hashes (path, hash) known."""
        return files.withColumn("hash", F.sha2("text", 256)).join(known.select("path", "hash"), ["path", "hash"], "left_anti")

    def sync_commits(self, log: DataFrame) -> DataFrame:
        """Links (sha, number, confidence) of a commit log (sha, message) to the records its messages name."""
        return log.select("sha", F.explode(tx.document_references(F.col("message"))).alias("number")).distinct().withColumn("confidence", F.lit(0.95))

    def sync_prs(self, log: DataFrame) -> DataFrame:
        return log.select("sha", tx.merged_reference(F.col("message")).alias("ref")).where("ref <> ''").distinct()

    def embed_all(self, provider: Embed | None, vectors: DataFrame | None = None) -> tuple[DataFrame, str | None]:
        return backfill(self.table("decision", "id", "text"), "id", "text", vectors, provider)
