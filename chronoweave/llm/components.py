"""Consolidating pairwise matches into groups: minimum labels with pointer jumping on a shrinking graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import BROADCAST_BYTES, Rounds

#: Joins between two tables of a jumping round, where pointers are shuffled and where they are
#: broadcast: pointers grow (joins + 1)-fold a round.
JUMPS, SMALL_JUMPS = 3, 7
#: Bytes a pointer takes as the small side of a join.
POINTER_BYTES = 160


def to_roots(rounds: Rounds, pointers: DataFrame, small: bool) -> DataFrame:
    """(node, label) with every label moved to the end of its chain of pointers.

    A root points to itself. Each round replaces the pointers by those several times as long, so a
    chain of n links takes log n rounds; the last one is that in which no pointer moved. ``small``
    tells that the counted pointers may be broadcast.
    """
    while True:
        ahead = pointers.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        ahead = F.broadcast(ahead) if small else ahead
        jumped = pointers.select("node", "label", F.col("label").alias("before"))
        for _ in range(SMALL_JUMPS if small else JUMPS):
            jumped = jumped.join(ahead, "label").select("node", F.col("_label").alias("label"), F.col("label").alias("before"))
        fresh, seen = rounds.counted(jumped, moved=F.col("label") != F.col("before"))
        rounds.drop(pointers)
        pointers = fresh
        # a pointer that the last step left in place stands at a root
        if not seen["moved"]:
            return pointers


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, member): the smallest id of the group each linked id belongs to.

    Every round each vertex points to the least id among itself and its neighbours, the pointers
    are jumped until all stand at roots, and the edges are rewritten to the roots; edges inside a
    root and repeats vanish. A round leaves at most every second vertex, so rounds are at most the
    logarithm of the vertices, and so are the jumps within one. Rounds end when no edge is left,
    that is when no label would change. Minima are aggregated before the shuffle, so a vertex with
    many links is no hot group; the rewriting joins leave skewed vertices to be split at run time,
    or broadcast the pointers where their counted rows fit.

    Pairs with a null side or the same id on both sides link nothing; repeats and either order
    count once. An empty table gives an empty one.
    """
    rounds = Rounds(pairs.sparkSession, "components")
    one = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, seen = rounds.counted(one)
    jumps: list[tuple[DataFrame, bool]] = []
    while seen["rows"]:
        # u < v on every edge: the least neighbour of a vertex, if less than itself, is a u
        low = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
        both = edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct().unionByName(low)
        step = both.groupBy("node").agg(F.min("label").alias("label"))
        # an edge has two vertices at most
        small = 2 * seen["rows"] * POINTER_BYTES <= BROADCAST_BYTES
        jump = to_roots(rounds, step if small else rounds.cut(step), small)
        jumps.append((jump, small))
        side = F.broadcast(jump) if small else jump
        moved = edges.join(side.select(F.col("node").alias("u"), F.col("label").alias("_u")), "u").join(side.select(F.col("node").alias("v"), F.col("label").alias("_v")), "v")
        fresh, seen = rounds.counted(moved.where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
        rounds.drop(edges)
        edges = fresh
    if not jumps:
        return one.select(F.col("u").alias("group_id"), F.col("v").alias("member"))
    labels = jumps[0][0].select("node", "label")
    for jump, small in jumps[1:]:
        over = jump.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        labels = labels.join(F.broadcast(over) if small else over, "label", "left").select("node", F.coalesce("_label", "label").alias("label"))
    return labels.select(F.col("label").alias("group_id"), F.col("node").alias("member"))
