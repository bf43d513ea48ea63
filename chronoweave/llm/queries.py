"""Queries of problems 4, 5, 8, 9 and 10, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.llm.leakage import leaks, without_leaks
from chronoweave.llm.near_dup import SEQUENCE, near_pairs, words
from chronoweave.llm.subjects import subject_areas
from chronoweave.llm.tokenizer import encode_texts
from chronoweave.runtime import Rounds
from chronoweave.sources.tables import table


def _near_decisions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(uri, cid) of every decision that has a word sequence, and the pairs of different texts.

    Texts are told apart by 128 bits and numbered once, so that no two share a number.
    """
    rounds = Rounds(spark, "decision_texts", tidy=True)
    code = F.unhex(F.md5(F.concat_ws("\x01", F.coalesce("title", F.lit("\x02")), F.coalesce("text", F.lit("\x02")))))
    rows = table(spark, d, "decision", "source_uri", "title", "text").where("source_uri IS NOT NULL").withColumn("code", code)
    # copies of a text meet map-side and are cut into words once; neither frame gathers the uris of a text
    texts = rows.groupBy("code").agg(F.first(F.struct("title", "text")).alias("t")).select("code", words(F.col("t.title"), F.col("t.text")).alias("w"))
    texts = rounds.cut(texts.where(F.size(F.split("w", " ")) >= SEQUENCE).withColumn("cid", F.monotonically_increasing_id()), keep=True)
    members = rows.select("code", F.col("source_uri").alias("uri")).distinct().join(texts.select("code", "cid"), "code").select("cid", "uri")
    return members, near_pairs(texts.select("cid", "w"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = _near_decisions(spark, d)
    a = members.select(F.col("cid").alias("a"), F.col("uri").alias("u"))
    b = members.select(F.col("cid").alias("b"), F.col("uri").alias("v"))
    across = pairs.join(a, "a").join(b, "b").select("u", "v")
    same = a.withColumnRenamed("a", "c").join(b.withColumnRenamed("b", "c"), "c").select("u", "v")
    return across.unionByName(same).where("u <> v").select(F.least("u", "v").alias("uri_a"), F.greatest("u", "v").alias("uri_b")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "decision_merge", "loser_id", "survivor_id", "similarity").where(F.col("similarity") >= F.lit(0.9).cast("float"))
    return components(rows, "loser_id", "survivor_id").select("group_id", F.col("member").alias("decision_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "text"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its evaluation passages cut out: words removed, whether it was dropped, characters left."""
    clean = without_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "text"))
    return clean.select("doc_id", "removed", "dropped", F.length("text").alias("chars"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "subject_label"), table(spark, d, "subject"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject."""
    sizes = table(spark, d, "documents", "doc_id", "n_chars")
    return p10_found(spark, d).join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_clean": p9_clean, "p10_found": p10_found, "p10_composition": p10_composition}

SQL = {
    "p4_found": r"""
WITH t AS (SELECT DISTINCT source_uri AS u, regexp_extract_all(lower(concat_ws(' ', title, text)), '[\p{L}\p{N}]+') AS w FROM decision WHERE source_uri IS NOT NULL),
g AS (SELECT u, row_number() OVER () AS k, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 3),
e AS (SELECT u, k, len(s) AS n, unnest(s) AS s FROM g)
SELECT DISTINCT uri_a, uri_b FROM (
  SELECT least(a.u, b.u) AS uri_a, greatest(a.u, b.u) AS uri_b FROM e a JOIN e b ON a.s = b.s AND a.k < b.k AND a.u <> b.u GROUP BY a.u, b.u, a.k, b.k, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*))
""",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT loser_id AS u, survivor_id AS v FROM decision_merge WHERE similarity >= CAST(0.9 AS FLOAT) AND loser_id <> survivor_id),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS origin, u AS reached FROM s UNION SELECT r.origin, s.v FROM r JOIN s ON s.u = r.reached)
SELECT min(reached) AS group_id, origin AS decision_id FROM r GROUP BY origin
""",
}
