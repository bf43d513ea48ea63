"""Graph operators over edge frames: bounded traversal, co-change, label propagation, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import Rounds


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds, each with its least depth.

    ``edges`` has (src, dst), ``seeds`` (node). Level by level: only the frontier is joined, nodes
    seen before are left out, so cycles end. Each level is written before the next one starts.
    """
    rounds = Rounds(edges.sparkSession, "reachable")
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    seen = rounds.cut(seeds.where("node IS NOT NULL").select("node", F.lit(0).alias("depth")).distinct(), keep=True)
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        frontier = rounds.cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth")), keep=True)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def truncated(edges: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """Whether a node beyond the depth would have been reached: one row (truncated)."""
    rim = found.where(F.col("depth") == depth).select(F.col("node").alias("src"))
    beyond = edges.join(rim, "src", "left_semi").select(F.col("dst").alias("node")).join(found, "node", "left_anti")
    return beyond.agg((F.count("*") > 0).alias("truncated"))


def cochange(items: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n): pairs of items that occur together in at least ``least`` groups, a < b."""
    x = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    a, b = x.withColumnRenamed("i", "a"), x.withColumnRenamed("i", "b")
    return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after synchronous rounds: the most frequent label among neighbours, ties to the least.

    Undirected; a node's label starts as its id. Counts are aggregated before the shuffle of labels.
    Rounds end early when no label changes.
    """
    run = Rounds(edges.sparkSession, "labels")
    one = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    links = run.cut(one.union(one.select("dst", "src")).distinct(), keep=True)
    state = run.cut(links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = links.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
        fresh = run.cut(best)
        same = fresh.join(state, ["node", "label"], "left_anti").isEmpty()
        run.drop(state)
        state = fresh
        if same:
            break
    return state


def unique_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys.., value) of the keys that have exactly one distinct value."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max")).where(F.col(value) == F.col("_max")).drop("_max")


def contained(spans: DataFrame, group: list[str], start: str, end: str, row_id: str) -> DataFrame:
    """(outer, inner) pairs of a group: the outer starts before the inner and ends no earlier."""
    o = spans.select(*group, F.col(row_id).alias("outer_id"), F.col(start).alias("os"), F.col(end).alias("oe"))
    i = spans.select(*group, F.col(row_id).alias("inner_id"), F.col(start).alias("is"), F.col(end).alias("ie"))
    return o.join(i, group).where((F.col("os") < F.col("is")) & (F.col("oe") >= F.col("ie"))).select(*group, "outer_id", "inner_id")


def node_rows(df: DataFrame, kind: str, node: Column, label: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), node.alias("node"), label.alias("label")).where("node IS NOT NULL").distinct()
