"""Evidence against the present: where anchored passages stand now, and what follows for the claims on them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.text import content_hash, jaccard, normal, tokens
from chronoweave.operators.evidence import AFFECTED
from chronoweave.runtime import ship

#: Most lines of a passage that is looked for, and bytes a window may hold beyond the passage itself.
LINES, SLACK = 80, 512
#: Lines of context on either side of a passage.
CONTEXT = 8


def find_span(text: str, needle: str) -> tuple[int, int] | None:
    """First and last line (from 1) of the earliest window of lines that holds the normal text ``needle``.

    Lines are put in normal form and joined by blanks. A window has at most LINES lines, and no
    more is added once it holds SLACK bytes more than the passage.
    """
    want = needle.encode()
    if not want:
        return None
    lines = [" ".join(x.split()).encode() for x in text.splitlines()]
    joined, starts, at = b" ".join(lines), [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    for first, at in enumerate(starts):
        found = joined.find(want, at)
        if found < 0:
            return None
        last = bisect_right(starts, found + len(want) - 1) - 1
        before = starts[last] - 1 - at if last > first else 0
        if last - first < LINES and before <= len(want) + SLACK:
            return first + 1, last + 1
    return None


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [find_span(t or "", n or "") or (None, None) for t, n in zip(batch.column("text").to_pylist(), batch.column("needle").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("anchor_id"), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], names=["anchor_id", "first", "last"])


def span_search(rows: DataFrame) -> DataFrame:
    """(anchor_id, first, last) of (anchor_id, text, needle): where each passage stands; null where nowhere."""
    ship(rows.sparkSession)
    return rows.select("anchor_id", "text", "needle").mapInArrow(_search, f"anchor_id {dict(rows.dtypes)['anchor_id']}, first int, last int")


def context_hash(text: Column, first: Column, last: Column) -> Column:
    """Hash of lines ``first`` to ``last`` with CONTEXT lines around them; null where there are no such lines."""
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    lo, hi = F.greatest(first - CONTEXT, F.lit(1)), F.least(last + CONTEXT, F.size(lines))
    return F.when((first >= 1) & (last <= F.size(lines)) & (first <= last), content_hash(F.array_join(F.slice(lines, lo, hi - lo + 1), "\n")))


def verify_anchors(anchors: DataFrame, texts: DataFrame, symbols: DataFrame | None = None, reachable: DataFrame | None = None) -> DataFrame:
    """(anchor_id, claim_id, edit_class, freshness, relocated, first, last, similarity) of each anchor.

    ``anchors`` has (id, claim_id, source_kind, source_uri, subpath, anchored_text, start_line,
    end_line), ``texts`` the present (source_uri, text), ``symbols`` the spans (source_uri, name,
    line, end_line) of symbols that are the only ones of their name in their file, ``reachable``
    the commits (sha) of the present history. Episodes and requests never change; a commit is
    fresh while reachable; a passage is compared with its span, and looked for in the whole text
    where that fails.
    """
    a = anchors.select(F.col("id").alias("anchor_id"), "claim_id", "source_kind", "source_uri", "subpath", "anchored_text", "start_line", "end_line")
    out = ("anchor_id", "claim_id", "edit_class", "freshness", "relocated", "first", "last", "similarity")
    none, no = F.lit(None).cast("int"), F.lit(None).cast("double")
    fixed = a.where(F.col("source_kind").isin("episode", "pr")).select("anchor_id", "claim_id", F.lit("unchanged").alias("edit_class"), F.lit("fresh").alias("freshness"), F.lit(False).alias("relocated"), none.alias("first"), none.alias("last"), no.alias("similarity"))
    spark = anchors.sparkSession
    known = (spark.createDataFrame([], "sha string") if reachable is None else reachable.select("sha").distinct()).withColumn("_there", F.lit(True))
    commits = a.where("source_kind = 'commit'").join(known, F.col("source_uri") == F.col("sha"), "left")
    there = F.coalesce("_there", F.lit(False))
    commits = commits.select("anchor_id", "claim_id", F.when(there, "unchanged").otherwise("deleted").alias("edit_class"), F.when(there, "fresh").otherwise("stale").alias("freshness"), F.lit(False).alias("relocated"), none.alias("first"), none.alias("last"), no.alias("similarity"))
    rest = a.where(~F.col("source_kind").isin("episode", "pr", "commit")).join(texts.select("source_uri", "text"), "source_uri", "left")
    if symbols is not None:
        spans = symbols.select("source_uri", F.col("name").alias("subpath"), F.col("line").alias("_line"), F.col("end_line").alias("_end"))
        rest = rest.join(spans, ["source_uri", "subpath"], "left")
    else:
        rest = rest.withColumn("_line", none).withColumn("_end", none)
    first, last = F.coalesce("_line", "start_line", F.lit(1)), F.coalesce("_end", "end_line", F.size(F.split("text", r"\r?\n")))
    rest = rest.withColumn("first", first).withColumn("last", last)
    part = F.array_join(F.slice(F.split("text", r"\r?\n"), F.greatest(F.col("first"), F.lit(1)), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
    rest = rest.withColumn("part", F.coalesce(part, F.lit("")))
    same = content_hash(F.col("anchored_text")) == content_hash(F.col("part"))
    moved = F.coalesce(F.col("first") != F.col("start_line"), F.lit(False)) | F.coalesce(F.col("last") != F.col("end_line"), F.lit(False))
    inside = F.contains(normal(F.col("part")), normal(F.col("anchored_text")))
    alike = jaccard(tokens(F.col("anchored_text")), tokens(F.col("part")))
    edit = F.when(same & ~moved, "unchanged").when(same | inside, "shifted").when(alike >= AFFECTED, "affected").otherwise("deleted")
    rest = rest.withColumn("edit_class", edit).withColumn("similarity", F.when(~same & ~inside, F.round(alike, 6)))
    stale = F.col("edit_class").isin("affected", "deleted")
    looked = span_search(rest.where(stale & F.col("text").isNotNull()).select("anchor_id", "text", normal(F.col("anchored_text")).alias("needle"))).select("anchor_id", F.col("first").alias("_f"), F.col("last").alias("_l"))
    rest = rest.join(looked.where("_f IS NOT NULL"), "anchor_id", "left")
    back = F.col("_f").isNotNull()
    rest = rest.select(
        "anchor_id", "claim_id", F.when(back, "shifted").otherwise(F.col("edit_class")).alias("edit_class"), F.when(stale & ~back, "stale").otherwise("fresh").alias("freshness"),
        (back | (F.col("edit_class") == "affected") | ((F.col("edit_class") == "shifted") & moved)).alias("relocated"), F.when(back, F.col("_f")).otherwise(F.col("first")).alias("first"),
        F.when(back, F.col("_l")).otherwise(F.col("last")).alias("last"), F.when(~back, F.col("similarity")).alias("similarity"),
    )
    return fixed.select(*out).unionByName(commits.select(*out)).unionByName(rest.select(*out))


def claim_dispositions(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """(claim_id, disposition, anchors, stale): unprovable without anchors, unaffected if all are fresh, affected if every stale one was found again."""
    counts = verified.groupBy("claim_id").agg(F.count("*").alias("anchors"), F.count_if(F.col("freshness") == "stale").alias("stale"), F.count_if((F.col("freshness") == "stale") & ~F.col("relocated")).alias("lost"))
    rule = F.when(F.col("anchors").isNull(), "unprovable").when(F.col("stale") == 0, "unaffected").when(F.col("lost") == 0, "affected").otherwise("unprovable")
    zero = F.lit(0).cast("long")
    return claims.select(F.col("id").alias("claim_id")).distinct().join(counts, "claim_id", "left").select("claim_id", rule.alias("disposition"), F.coalesce("anchors", zero).alias("anchors"), F.coalesce("stale", zero).alias("stale"))


def incomplete_claims(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """(claim_id, kind, uri, subpath): what a claim read that no anchor of it covers, as a whole or in that part."""
    reads = claims.select(F.col("id").alias("claim_id"), F.explode("read_set").alias("r")).select("claim_id", "r.kind", "r.uri", F.coalesce("r.subpath", F.lit("")).alias("subpath")).distinct()
    cover = anchors.select("claim_id", F.col("source_kind").alias("kind"), F.col("source_uri").alias("uri"), F.coalesce("subpath", F.lit("")).alias("subpath")).distinct()
    return reads.join(cover, ["claim_id", "kind", "uri", "subpath"], "left_anti").join(cover.where("subpath = ''"), ["claim_id", "kind", "uri"], "left_anti").select("claim_id", "kind", "uri", "subpath")


def freshness_manifest(disposed: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(unaffected, affected, unprovable, incomplete): one row of counts."""
    counts = disposed.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("unaffected", "affected", "unprovable")])
    return counts.join(F.broadcast(incomplete.agg(F.countDistinct("claim_id").alias("incomplete"))))  # one row each


def obligation(disposed: DataFrame, anchors: DataFrame, verified: DataFrame) -> DataFrame:
    """(unprovable, affected, drifted, syncs): what stands against an answer; no row where every claim is unaffected.

    ``syncs`` are the runs that would renew the evidence, by the kinds of its sources.
    """
    bad = disposed.where("disposition <> 'unaffected'")
    of = anchors.select(F.col("id").alias("anchor_id"), "claim_id", "source_kind").join(bad.select("claim_id"), "claim_id", "left_semi")
    drifted = of.join(verified.where("freshness = 'stale'").select("anchor_id"), "anchor_id", "left_semi").agg(F.count("*").alias("drifted"))
    kinds = of.agg(F.collect_set("source_kind").alias("k"))  # a handful of kinds
    run = lambda name, *of: F.when(F.arrays_overlap("k", F.array(*[F.lit(x) for x in of])), name)
    syncs = F.filter(F.array(run("sync_adrs", "adr"), run("sync_incremental", "source_file", "symbol"), run("sync_commits", "commit")), lambda x: x.isNotNull())
    counts = bad.agg(F.count_if(F.col("disposition") == "unprovable").alias("unprovable"), F.count_if(F.col("disposition") == "affected").alias("affected"))
    one = counts.join(F.broadcast(drifted)).join(F.broadcast(kinds))  # one row each
    return one.where("unprovable + affected > 0").select("unprovable", "affected", "drifted", F.array_join(syncs, ",").alias("syncs"))


def lane_lag(lanes: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, lane, status, lag): commits newer than the one a lane was last indexed at; null where that is unknown."""
    at = commits.select("repo_id", F.col("sha").alias("indexed_commit"), F.col("source_time").alias("_at"))
    known = lanes.join(at, ["repo_id", "indexed_commit"], "left")
    newer = known.select("repo_id", "lane", "_at").join(commits.select("repo_id", "source_time"), "repo_id").where("source_time > _at").groupBy("repo_id", "lane").agg(F.count("*").alias("n"))
    return known.join(newer, ["repo_id", "lane"], "left").select("repo_id", "lane", "status", F.when(F.col("_at").isNotNull(), F.coalesce("n", F.lit(0))).alias("lag"))


def newest_change(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(newest): last modification below a folder, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.agg(F.max("modificationTime").alias("newest"))
