"""Queries of the general training-data problems 1, 2, 3, 6 and 7 over the project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.asof import as_known_at
from chronoweave.operators.hierarchy import hierarchy, reference_number
from chronoweave.operators.history import attribute_history
from chronoweave.operators.references import apply_deltas, current_orphans, existence_deltas, orphans, reference_deltas, references
from chronoweave.operators.temporal import instant
from chronoweave.runtime import Rounds
from chronoweave.operators.timestamps import normalise
from chronoweave.sources.tables import table


def _supersession(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "adr_document", "repo_id", "adr_id", "supersedes", "superseded_by").where("repo_id IS NOT NULL AND adr_id IS NOT NULL")
    key = lambda number: F.concat_ws("|", "repo_id", number)
    own = reference_number(F.col("adr_id"))
    nodes = docs.where(own.isNotNull()).select(key(own).alias("node"), F.col("adr_id").alias("name"))
    older = docs.select("repo_id", own.alias("parent"), F.explode("supersedes").alias("ref")).select("repo_id", reference_number(F.col("ref")).alias("child"), "parent")
    newer = docs.select("repo_id", own.alias("child"), reference_number(F.col("superseded_by")).alias("parent"))
    links = older.unionByName(newer).where("child IS NOT NULL AND parent IS NOT NULL").select(key(F.col("child")).alias("child"), key(F.col("parent")).alias("parent"))
    return hierarchy(links, nodes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _supersession(spark, d).select(F.expr("substring_index(node, '|', 1)").alias("repo_id"), F.col("name").alias("adr_id"), F.col("root_name").alias("root_adr_id"), "depth", "path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "decision_git_link", "id", "decision_uri", "source_time")
    rows = table(spark, d, "decision", "id", "source_uri", "valid_from", "valid_to", "ingested_at")
    found = as_known_at(links, rows, event_id="id", event_key="decision_uri", event_time="source_time", row_id="id", row_key="source_uri")
    return found.select(F.col("event_id").alias("link_id"), F.col("row_id").alias("decision_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repository", "id", "time_zone", "date_order")
    repos = repos.groupBy(F.col("id").alias("repo_id")).agg(F.first("time_zone").alias("time_zone"), F.first("date_order").alias("date_order"))
    rows = [table(spark, d, t, "id", "repo_id", "date", "ingested_at").withColumn("src_table", F.lit(t)) for t in ("adr_document", "parsed_adr")]
    rows = rows[0].unionByName(rows[1]).where("date IS NOT NULL").withColumn("rec", F.struct("src_table", "id"))
    found = normalise(rows.join(repos, "repo_id", "left"), row_id="rec", text="date", source="repo_id", seq="ingested_at", zone="time_zone", date_order="date_order")
    return found.select("rec.src_table", F.col("rec.id").alias("rec_id"), "epoch_us")


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "symbol_span", "id", "name", "valid_from", "valid_to", "ingested_at")
    return attribute_history(spans, "id", ["name"]).select("id", "name", _us("valid_from").alias("valid_from_us"), F.coalesce(_us("valid_to"), F.lit(-1)).alias("valid_to_us"))


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The history of three attributes together."""
    spans = table(spark, d, "symbol_span", "id", "name", "kind", "file_path", "valid_from", "valid_to", "ingested_at")
    return attribute_history(spans, "id", ["name", "kind", "file_path"]).select("id", "name", "kind", "file_path", _us("valid_from").alias("valid_from_us"), F.coalesce(_us("valid_to"), F.lit(-1)).alias("valid_to_us"))


def _reference_sides(spark: SparkSession, d: str) -> tuple[dict[str, tuple[DataFrame, str]], list[DataFrame]]:
    """Of each reference field the referring rows with the column of their key, and the existence deltas of all fields."""
    edges = table(spark, d, "symbol_edge", "id", "repo_id", "to_id", "to_name", "valid_from", "valid_to")
    rows = table(spark, d, "decision", "id", "adr_id", "episode_id", "valid_from", "valid_to")
    named = edges.where("to_id IS NULL AND to_name <> '' AND repo_id IS NOT NULL").withColumn("key", F.concat_ws("|", "repo_id", "to_name"))
    refs = {"to_id": (edges, "to_id"), "to_name": (named, "key"), "adr_id": (rows, "adr_id"), "episode_id": (rows, "episode_id")}
    spans = table(spark, d, "symbol_span", "id", "repo_id", "name", "valid_from", "valid_to")
    docs = table(spark, d, "adr_document", "id", "valid_from", "valid_to")
    episodes = table(spark, d, "episode", "id", "occurred_at")
    by_name = spans.where("repo_id IS NOT NULL AND name IS NOT NULL").withColumn("key", F.concat_ws("|", "repo_id", "name"))
    there = [
        existence_deltas(spans, "to_id", "id", "valid_from", "valid_to"),
        existence_deltas(by_name, "to_name", "key", "valid_from", "valid_to"),
        existence_deltas(docs, "adr_id", "id", "valid_from", "valid_to"),
        existence_deltas(episodes, "episode_id", "id", "occurred_at", None),
    ]
    return refs, there


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    sides, there = _reference_sides(spark, d)
    refs = [references(rows, field, "id", key, "valid_from") for field, (rows, key) in sides.items()]
    return orphans(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, there))


#: The instant of the current report, and the one its state is first built at.
NOW, BEFORE = "2024-06-01 00:00:00", "2023-06-01 00:00:00"


def p7_current(spark: SparkSession, d: str) -> DataFrame:
    """The keys referred to and not there at NOW, from counts kept at BEFORE and the deltas since then."""
    sides, there = _reference_sides(spark, d)
    refs = reduce(DataFrame.unionByName, [reference_deltas(rows, field, "id", key, "valid_from", "valid_to") for field, (rows, key) in sides.items()])
    there = reduce(DataFrame.unionByName, there)
    since = (F.col("t") > instant(BEFORE)) & (F.col("t") <= instant(NOW))
    kept = Rounds(spark, "reference_counts").cut(apply_deltas(None, refs.where(F.col("t") <= instant(BEFORE)), there.where(F.col("t") <= instant(BEFORE))), keep=True)
    state = apply_deltas(kept, refs.where(since), there.where(since))
    return current_orphans(state)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    src = F.when(F.col("field").isin("to_id", "to_name"), "symbol_edge").otherwise("decision")
    return _orphans(spark, d).select(src.alias("src_table"), F.col("field").alias("src_field"), "row_id", "kind", F.date_format("t", "yyyy-MM").alias("period"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, field, month and kind."""
    return p7_found(spark, d).groupBy("src_table", "src_field", "period", "kind").agg(F.count("*").alias("orphans"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_attributes": p6_attributes, "p7_found": p7_found, "p7_report": p7_report, "p7_current": p7_current}
