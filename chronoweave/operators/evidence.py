"""Evidence checks: edit classes, dispositions, completeness of read sets, freshness manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import content_hash, jaccard, normal, tokens

#: Token overlap from which an edited passage counts as affected rather than deleted.
AFFECTED = 0.6


def edit_class(old: Column, new: Column) -> Column:
    """unchanged, shifted (contained elsewhere), affected (Jaccard >= 0.6) or deleted; null where a side is null."""
    same = content_hash(old) == content_hash(new)
    inside = F.contains(normal(new), normal(old)) & (normal(old) != "")
    alike = jaccard(tokens(old), tokens(new)) >= AFFECTED
    known = old.isNotNull() & new.isNotNull()
    return F.when(known, F.when(same, "unchanged").when(inside, "shifted").when(alike, "affected").otherwise("deleted"))


def is_stale(kind: Column) -> Column:
    return kind.isin("affected", "deleted")


def dispositions(claims: DataFrame, anchors: DataFrame, claim: str) -> DataFrame:
    """(claim, disposition): unprovable without anchors, unaffected if all are fresh, affected if all
    stale ones were relocated, else unprovable. ``anchors`` has (claim, stale, relocated)."""
    counts = anchors.groupBy(claim).agg(F.count("*").alias("n"), F.count_if(F.col("stale")).alias("s"), F.count_if(F.col("stale") & ~F.col("relocated")).alias("lost"))
    rule = F.when(F.col("n").isNull(), "unprovable").when(F.col("s") == 0, "unaffected").when(F.col("lost") == 0, "affected").otherwise("unprovable")
    return claims.select(claim).distinct().join(counts, claim, "left").select(claim, rule.alias("disposition"))


def latest_stale(verifications: DataFrame, anchor: str, checked: str, subject: str) -> DataFrame:
    """Per subject the stale anchors, and those not relocated, by each anchor's newest verification (ties all count)."""
    newest = verifications.groupBy(anchor).agg(F.max(checked).alias(checked))
    rows = verifications.join(newest, [anchor, checked])
    return rows.groupBy(subject).agg(F.count_if(F.col("stale")).alias("stale"), F.count_if(F.col("stale") & ~F.col("relocated")).alias("lost")).where("stale > 0")


def uncovered(reads: DataFrame, anchors: DataFrame) -> DataFrame:
    """Read identities (claim, kind, uri, subpath) with no anchor of the same artifact, whole or same part."""
    cover = anchors.select("claim", "kind", "uri", F.coalesce("subpath", F.lit("")).alias("part")).distinct()
    want = reads.withColumn("part", F.coalesce("subpath", F.lit("")))
    whole = cover.where("part = ''").select("claim", "kind", "uri").distinct()
    return want.join(whole, ["claim", "kind", "uri"], "left_anti").join(cover, ["claim", "kind", "uri", "part"], "left_anti").drop("part")


def manifest(disposed: DataFrame) -> DataFrame:
    """Claims per disposition."""
    return disposed.groupBy("disposition").agg(F.count("*").alias("claims"))
