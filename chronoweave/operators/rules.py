"""Rules over constraints and decisions: contradictions, violations, staleness, orphans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import content_terms, polarity
from chronoweave.runtime import Rounds


def constraints(rows: DataFrame, row_id: str, text: str, keep: list[str]) -> DataFrame:
    """One row per sentence of obligation or prohibition: (row_id, n, sentence, polarity, keep..)."""
    parts = rows.select(F.col(row_id), *keep, F.posexplode(F.split(text, r"(?<=[.!?])[ \t\r\n]+")).alias("n", "sentence"))
    return parts.withColumn("polarity", polarity(F.col("sentence"))).where("polarity IS NOT NULL")


def contradictions(found: DataFrame, group: str, row_id: str) -> DataFrame:
    """(a, b, shared, confidence): constraints of different rows of a group, of opposite polarity, that share
    at least two content terms and half of the smaller set.

    Terms are ordered from the rarest of the group to the commonest. The first term a pair shares lies
    early enough in both orders to leave room for the others, so only those terms are joined on, the
    pair is kept at its first shared term alone, and the commonest terms bring no pairs together. The
    ordered sets are written once, before the joins.
    """
    key = F.concat_ws("#", row_id, "n")
    words = found.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), key.alias("c"), F.col(row_id).alias("r"), "polarity", content_terms(F.col("sentence")).alias("t"))
    return opposite_pairs(words).select("a", "b", "shared", F.lit(0.5).alias("confidence"))


def opposite_pairs(words: DataFrame) -> DataFrame:
    """(a, b, shared) of constraints (g, c, r, polarity, t) of one group and different rows; see ``contradictions``."""
    words = words.distinct()
    run = Rounds(words.sparkSession, "contradictions")
    words = run.cut(words.where(F.size("t") >= 2).withColumn("k", F.xxhash64("c", "t")))
    each = words.select("g", "c", "k", "r", "polarity", F.explode("t").alias("term"))
    often = each.groupBy("g", "term").agg(F.count("*").alias("often"))
    sets = each.join(often, ["g", "term"]).groupBy("g", "c", "k", "r", "polarity").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "term"))), lambda x: x["term"]).alias("t"))
    sets = run.cut(sets, keep=True)
    run.drop(words)
    size = F.size("t")

    def side(polarity: str, name: str, last: Column) -> DataFrame:
        terms = F.explode(F.slice("t", F.lit(1), last))
        return sets.where(F.col("polarity") == polarity).select("g", F.col("c").alias(name), F.col("r").alias(f"r{name}"), F.col("t").alias(f"t{name}"), terms.alias("term"))

    few, most = size + 1 - F.greatest(F.lit(2), F.ceil(size / 2).cast("int")), size - 1
    met = [
        side("must", "a", few).join(side("must_not", "b", most), ["g", "term"]).where("size(ta) <= size(tb)"),
        side("must", "a", most).join(side("must_not", "b", few), ["g", "term"]).where("size(tb) < size(ta)"),
    ]
    both = F.array_intersect("ta", "tb")
    pairs = met[0].unionByName(met[1]).where("ra <> rb").where(both[0] == F.col("term")).select("a", "b", F.size(both).alias("shared"), F.least(F.size("ta"), F.size("tb")).alias("least"))
    pairs = pairs.where((F.col("shared") >= 2) & (2 * F.col("shared") >= F.col("least")))
    return pairs.select("a", "b", F.col("shared").cast("long").alias("shared")).distinct()


def _met(files: DataFrame, found: DataFrame, row_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, w), the words of more than three bytes of each constraint, and (row_id, file, w) of those that are part of a path's segment.

    Segments are cut into all their parts, so that words are looked up by equality and no
    constraint meets every file. Paths are short; a change has few.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 3))
    parts = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(i, F.length(c)), lambda j: F.substring(c, i, j - i + 1))))
    segments = files.select("file", F.explode(F.split(F.lower("file"), "/")).alias("s")).where("s <> ''").distinct()
    pieces = segments.select("file", F.explode(F.array_distinct(F.filter(parts(F.col("s")), lambda w: F.octet_length(w) > 3))).alias("w")).distinct()
    each = found.select(F.col(row_id), F.explode(words(F.col(text))).alias("w")).distinct()
    return each, each.join(pieces, "w")


def touched(files: DataFrame, found: DataFrame, row_id: str, text: str, summary: str | None = None) -> DataFrame:
    """(row_id, files, in_summary): constraints one of whose words is part of a path's segment or of a summary's word."""
    each, met = _met(files, found, row_id, text)
    by_file = met.groupBy(row_id).agg(F.array_sort(F.collect_set("file")).alias("files"))
    told = [w for w in re.split(r"[\W_]+", (summary or "").lower()) if len(w.encode()) > 3]
    hit = reduce(lambda a, b: a | b, [F.contains(F.lit(w), F.col("w")) for w in told], F.lit(False))
    by_text = each.where(hit).select(row_id).distinct().withColumn("_told", F.lit(True))
    both = by_file.join(by_text, row_id, "full")
    return both.select(row_id, F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("_told", F.lit(False)).alias("in_summary"))


def violations(files: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """(file, row_id, matched): constraints some of whose words are part of a path's segments, and how many."""
    return _met(files, found, row_id, "sentence")[1].groupBy("file", row_id).agg(F.count("*").alias("matched"))


def fuse_signals(signals: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """(key, confidence, signals): the strongest of the staleness signals and the names of all."""
    parts = [df.select(key).distinct().select(key, F.lit(name).alias("signal"), F.lit(c).alias("c")) for name, (df, c) in signals.items()]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy(key).agg(F.max("c").alias("confidence"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
