"""Checks over the knowledge tables: consistency of rules and supersessions, changes against rules, duplicates, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import rules
from chronoweave.operators.temporal import in_force, instant
from chronoweave.plans.store import END, Store, first_by, semi


def check_consistency(store: Store, repo_id: str, at: str = END, min_confidence: float = 0.0) -> DataFrame:
    """(kind, a, b, confidence): declared conflicts, contradictory constraints, supersession circles, superseded but open documents.

    A constraint forbids if its claim says so, else if its text does. Contradictory ones of
    decisions that govern a file together weigh 0.75, others 0.5.
    """
    view = store.decision_view().where(in_force(instant(at)) & (F.col("repo_id") == repo_id))
    own = view.select("id")
    edges = store.open_conflict_edges_for_decisions(own).select(F.lit("explicit_edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "confidence")
    told = store.open("claims").where("subject_type = 'constraint'").groupBy(F.col("subject_id").alias("id")).agg(F.max("polarity").alias("told"))
    found = store.find_constraints_for_decisions(own).select("id", "decision_id", "text").join(told, "id", "left")
    found = found.withColumn("polarity", F.coalesce("told", F.when(tx.negated(F.col("text")), "must_not").otherwise("must")))
    pairs = rules.opposite_pairs(found.select(F.lit(repo_id).alias("g"), F.col("id").alias("c"), F.col("decision_id").alias("r"), "polarity", tx.content_terms(F.col("text")).alias("t")))
    link = store.open("decision_code_links").select("decision_id", "file_path").distinct()
    of = found.select("id", "decision_id")
    governed = lambda side: of.select(F.col("id").alias(side), "decision_id").join(link, "decision_id").select(side, "file_path")
    near = pairs.select("a", "b").join(governed("a"), "a").join(governed("b"), ["b", "file_path"]).select("a", "b").distinct().withColumn("_same", F.lit(True))
    contradictory = pairs.join(near, ["a", "b"], "left").select(F.lit("contradictory_constraints").alias("kind"), "a", "b", F.when(F.col("_same"), 0.75).otherwise(0.5).alias("confidence"))
    sup = store.supersession_pairs_with_status(repo_id)
    active = sup.where("valid_to IS NULL").select(F.lit("superseded_but_active").alias("kind"), F.col("superseder").alias("a"), F.col("superseded").alias("b"), F.lit(0.8).alias("confidence"))
    back = sup.select(F.col("superseded").alias("superseder"), F.col("superseder").alias("superseded")).distinct()
    circle = sup.select("superseder", "superseded").distinct().join(back, ["superseder", "superseded"]).where("superseder < superseded")
    circle = circle.select(F.lit("supersession_cycle").alias("kind"), F.col("superseder").alias("a"), F.col("superseded").alias("b"), F.lit(0.9).alias("confidence"))
    return reduce(DataFrame.unionByName, [edges, contradictory, active, circle]).where(F.col("confidence") >= min_confidence)


def inspect_change(store: Store, repo_id: str, files: DataFrame, summary: str | None = None, at: str = END, expand: bool = False) -> DataFrame:
    """(decision_id, constraint_id, files, in_summary, tier): constraints a change of ``files`` (path) may touch."""
    view = store.decision_view().where(in_force(instant(at)) & (F.col("repo_id") == repo_id)).select(F.col("id").alias("decision_id"), "status")
    given = store.expand_callers(files) if expand else files.select(F.col(files.columns[0]).alias("path"))
    found = semi(store.table("constraints"), "decision_id", view.select("decision_id")).select(F.col("id").alias("constraint_id"), "decision_id", "text")
    hits = rules.touched(given.select(F.col("path").alias("file")), found, "constraint_id", "text", summary)
    accepted = F.lower("status") == "accepted"
    tier = F.when(F.col("in_summary") & (F.size("files") == 0), "medium").when(accepted, "high").otherwise("medium")
    return hits.join(found.drop("text"), "constraint_id").join(view, "decision_id").select("decision_id", "constraint_id", "files", "in_summary", tier.alias("tier"))


def timeline(store: Store, name: str, start: str, end: str) -> DataFrame:
    """(t, event, entity): the first event of each kind for each entity about a symbol: seen, decided, ruled, committed, told."""
    a, z = instant(start), instant(end)
    spans = store.trace_symbol_spans(name, start, end)
    paths = spans.join(store.table("files").select(F.col("id").alias("file_id"), "path"), "file_id").select("path").distinct()
    decided = store.trace_decisions_for_files(paths, start, end)
    ids = decided.select("id").distinct()
    one = lambda df, event, entity, t: df.select(F.col(t).alias("t"), F.lit(event).alias("event"), F.col(entity).alias("entity"))
    parts = [
        one(spans, "symbol", "id", "valid_from"), one(decided, "decision", "id", "valid_from"), one(store.trace_constraints_for_decisions(ids, start, end), "constraint", "id", "valid_from"),
        one(store.trace_commits_for_decisions(ids, start, end), "commit", "id", "source_time"), one(store.trace_episodes_for_decisions(ids, start, end), "episode", "id", "occurred_at"),
    ]
    union = reduce(DataFrame.unionByName, parts).where(F.col("t").between(a, z) | (F.col("t") < a))
    return union.groupBy("event", "entity").agg(F.min("t").alias("t")).select("t", "event", "entity").orderBy("t", "event", "entity")


def propose_links(store: Store, repo_id: str, words: list[str], limit: int = 5) -> DataFrame:
    """(kind, id, score, rank): decisions, commits, symbols and routes a text may be about, the best of each kind.

    Decisions and commits score their share of the most occurrences, commits 0.8 of it and only
    above 0.10; a symbol whose name holds a word scores 0.55, 0.70 if it is one; a route 0.50,
    0.72 if its path has the word as a part.
    """
    tf = lambda c: tx.term_frequency(c, words)
    d = store.list_all_decisions(repo_id).select(F.lit("decision").alias("kind"), "id", tf(F.concat_ws(" ", "title", "text")).alias("n"))
    k = store.fetch_commits_with_text(repo_id).select(F.lit("commit").alias("kind"), "id", tf(F.col("message")).alias("n"))
    counted = d.unionByName(k).where("n > 0")
    best = F.broadcast(counted.groupBy("kind").agg(F.max("n").alias("most")))  # two rows
    shares = counted.join(best, "kind").select("kind", "id", (F.col("n") / F.col("most") * F.when(F.col("kind") == "commit", 0.8).otherwise(1.0)).alias("score")).where("kind = 'decision' OR score > 0.10")
    low = [w.lower() for w in words]
    s = store.live_symbols().where(F.col("repo_id") == repo_id).select("id", F.lower("name").alias("name")).distinct()
    s = s.where(reduce(lambda a, b: a | b, [F.contains("name", F.lit(w)) for w in low])).select(F.lit("symbol").alias("kind"), "id", F.when(F.col("name").isin(*low), 0.70).otherwise(0.55).alias("score"))
    r = store.find_routes_for_repo(repo_id).select("id", F.lower("path").alias("path"))
    parts = F.split("path", r"[^\p{L}\p{N}]+")
    r = r.where(reduce(lambda a, b: a | b, [F.contains("path", F.lit(w)) for w in low])).select(F.lit("route").alias("kind"), "id", F.when(F.arrays_overlap(parts, F.array(*[F.lit(w) for w in low])), 0.72).otherwise(0.50).alias("score"))
    union = reduce(DataFrame.unionByName, [shares, s, r])
    from pyspark.sql import Window

    ranked = union.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= limit).select("kind", "id", F.round("score", 2).alias("score"), "rank")


def nearest_decision(store: Store, repo_id: str, rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(key, decision_id, similarity) of new rows (key, text, embedding): an open decision of equal normal text, else the nearest one by cosine."""
    from chronoweave.operators import retrieval

    own = store.fetch_decisions_with_embeddings(repo_id)
    h = tx.content_hash(F.col("text"))
    exact = rows.select("key", h.alias("h")).join(own.select("id", h.alias("h")), "h").groupBy("key").agg(F.min("id").alias("decision_id")).withColumn("similarity", F.lit(1.0))
    rest = rows.join(exact.select("key"), "key", "left_anti").where(F.size("embedding") > 0).select(F.concat(F.lit("q:"), "key").alias("vec"), "embedding")
    vectors = own.where(F.size("embedding") > 0).select(F.concat(F.lit("d:"), "id").alias("vec"), "embedding")
    hits = retrieval.cosine_search(vectors, rest, "vec", "embedding", threshold).select(F.expr("substring(query, 3)").alias("key"), F.expr("substring(hit, 3)").alias("decision_id"), F.col("cosine").alias("similarity"))
    return exact.unionByName(first_by(hits, ["key"], F.desc("similarity"), F.col("decision_id")))
