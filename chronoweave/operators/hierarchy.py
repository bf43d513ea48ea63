"""Parent-child links to full hierarchies: cycles by leaf peeling, intervals by Euler tour and list ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import BROADCAST_BYTES, SLICE_ROWS, Rounds, broadcast_if_small, carried_next, ship, slice_hot

#: Joins a round makes before its table is written, where pointers are shuffled and where they are
#: broadcast: with n of them a jump grows (n + 1)-fold a round.
HOPS, SMALL_HOPS = 3, 7
#: Bytes a pointer takes as the small side of a join.
POINTER_BYTES = 96


def reference_number(ref: Column) -> Column:
    """Number a written document reference names, without leading zeros; null if it names none.

    Markdown links count by their label, paths by their last part; then the first run of digits counts.
    """
    label = F.regexp_replace(ref, r"^\s*\[([^\]]*)\]\(.*$", "$1")
    last = F.when(label.rlike(r"/[^/]*$"), F.regexp_extract(label, r"([^/]*)/?\s*$", 1)).otherwise(label)
    digits = F.regexp_extract(last, r"([0-9]+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=[0-9])", ""))


def _side(df: DataFrame, rows: int) -> DataFrame:
    """Pointers as one side of a join: broadcast where their counted rows fit."""
    return F.broadcast(df) if rows * POINTER_BYTES <= BROADCAST_BYTES else df


def _hops(rows: int) -> int:
    return SMALL_HOPS if rows * POINTER_BYTES <= BROADCAST_BYTES else HOPS


def _peel(rounds: Rounds, parent: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Splits the nodes of (node, up) into the forest (node) and, if any, (node, entry on a cycle).

    A round peels four or eight times as many layers as the one before: ``jump`` is the node's 4^k-th
    (or 8^k-th) ancestor, and nodes without one hang from a root. Depths have no gaps, so once a round settles
    no node the rest hangs from cycles. The images of the rest shrink as leaves are peeled; once
    they don't, they are the nodes on cycles.
    """
    state, seen = rounds.counted(parent.select("node", F.col("up").alias("jump")), left=F.col("jump").isNotNull())
    left, hops = -1, _hops(rows)
    while True:
        before, left = left, seen["left"]
        if left in (0, before):
            break
        up, rest = _side(state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump")), rows), state.where("jump IS NOT NULL")
        for _ in range(hops):
            rest = rest.join(up, "jump", "left").select("node", F.col("_jump").alias("jump"))
        fresh, seen = rounds.counted(state.where("jump IS NULL").unionByName(rest), left=F.col("jump").isNotNull())
        rounds.drop(state)
        state = fresh
    forest = rounds.cut(state.where("jump IS NULL").select("node"), keep=True) if left else parent.select("node")
    if not left:
        rounds.drop(state)
        return forest, None
    ring, images = rounds.cut(state.where("jump IS NOT NULL")), -1
    rounds.drop(state)
    while True:
        before, images = images, ring.agg(F.countDistinct("jump")).first()[0]
        if images == before:
            return forest, ring.select("node", F.col("jump").alias("entry"))
        up, step = _side(ring.select(F.col("node").alias("jump"), F.col("jump").alias("_jump")), left), ring
        for _ in range(_hops(left)):
            step = step.join(up, "jump").select("node", F.col("_jump").alias("jump"))
        fresh = rounds.cut(step)
        rounds.drop(ring)
        ring = fresh


def _cycle_names(rounds: Rounds, parent: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(node, on_cycle, root): the smallest name on the cycle each node lies on or leads into."""
    on = cyclic.select(F.col("entry").alias("node")).distinct()
    ring, seen = rounds.counted(parent.join(on, "node", "left_semi").select("node", F.col("up").alias("jump"), F.col("name").alias("low")))
    rows = 2 * seen["rows"]
    while True:
        ahead = ring.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"))
        ahead = _side(ahead, rows)
        turned = ring.select("node", "jump", "low", F.lit(False).alias("moved"))
        for _ in range(_hops(rows)):
            turned = turned.join(ahead, "jump").select("node", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"), (F.col("moved") | (F.col("_low") < F.col("low"))).alias("moved"))
        fresh, seen = rounds.counted(turned, moved=F.col("moved"))
        rounds.drop(ring)
        ring = fresh
        if not seen["moved"]:
            break
    lows = ring.select(F.col("node").alias("entry"), F.col("low").alias("root"))
    marked = on.withColumn("on_cycle", F.lit(True))
    return cyclic.join(lows, "entry").join(marked, "node", "left").select("node", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "root")


def euler_tour(rounds: Rounds, forest: DataFrame, rows: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(node, root, first, last) of a forest (node, up; numbers, roots have no up).

    Each node has an arc down into it (2 * node) and one up out of it (2 * node + 1). The arcs of
    a tree form a list: down to the first child, from a child up and down to the next, at last up.
    Ranking the list by pointer jumping gives the position of each arc, counted from the end of the
    tour: ``first`` of the arc down, ``last`` of that up; x lies under y if first and last of x lie
    between those of y. The arc at the end names the root.
    """
    kids, hot = slice_hot(forest.where("up IS NOT NULL"), ["up"], "node", slice_rows)
    kids = carried_next(kids, ["up"], ["node"], F.col("node"), "sibling", hot)
    none = F.lit(None).cast("long")
    child = forest.select("node", none.alias("child")).unionByName(forest.where("up IS NOT NULL").select(F.col("up").alias("node"), F.col("node").alias("child")))
    down = child.groupBy("node").agg(F.min("child").alias("child")).select((2 * F.col("node")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("node") + 1).alias("next"))
    up = kids.select((2 * F.col("node") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"))
    end = forest.where("up IS NULL").select((2 * F.col("node") + 1).alias("arc"), none.alias("next"))
    # ``hops`` counts the arcs from this one up to, not including, ``next``; ``tail`` is the last arc passed
    ranks, seen = rounds.counted(down.unionByName(up).unionByName(end).select("arc", "next", F.lit(1).cast("long").alias("hops"), F.col("arc").alias("tail")), left=F.col("next").isNotNull())
    while seen["left"]:
        ahead = _side(ranks.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("hops").alias("_hops"), F.col("tail").alias("_tail")), 2 * rows)
        jumped = ranks.where("next IS NOT NULL")
        for _ in range(_hops(2 * rows)):
            jumped = jumped.join(ahead, "next", "left").select("arc", F.col("_next").alias("next"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_tail", "tail").alias("tail"))
        fresh, seen = rounds.counted(ranks.where("next IS NULL").unionByName(jumped), left=F.col("next").isNotNull())
        rounds.drop(ranks)
        ranks = fresh
    return ranks.groupBy(F.expr("arc DIV 2").alias("node")).agg(
        (F.max("tail") - 1).cast("long").alias("_root"), F.max(F.when(F.col("arc") % 2 == 0, F.col("hops"))).alias("first"), F.max(F.when(F.col("arc") % 2 == 1, F.col("hops"))).alias("last")
    ).select("node", F.expr("_root DIV 2").alias("root"), "first", "last")


_READ = "root_name string, depth long, path string, entry long, exit long, descendants long, ancestors array<string>"


def _read_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth, path and ancestors of rows sorted by tree, slice and position: the intervals open at a row are its ancestors.

    Only the open intervals are held, from batch to batch. Carried rows open their interval and give no row.
    """
    tree, total, open_to, keys, names = None, 0, [], [], []
    for batch in batches:
        root, part, first, last, key, name, carried = (batch.column(c).to_pylist() for c in ("root", "_slice", "first", "last", "key", "name", "carried"))
        at, out = [], []
        for i in range(batch.num_rows):
            if (root[i], part[i]) != tree:
                tree, total, open_to, keys, names = (root[i], part[i]), first[i], [], [], []
            while open_to and open_to[-1] >= first[i]:
                open_to.pop(), keys.pop(), names.pop()
            if not carried[i]:
                at.append(i)
                out.append((names[0] if names else name[i], len(keys), "/".join([*names, name[i]]), total - first[i], total - last[i], (first[i] - last[i] - 1) // 2, list(keys)))
            open_to.append(last[i]), keys.append(key[i]), names.append(name[i])
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(at, pa.int64())), batch.column("name").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["node", "name", *[f.split()[0] for f in _READ.split(", ")]],
        )


def read_intervals(tour: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(node, name, root_name, depth, path, entry, exit, descendants, ancestors) from (root, first, last, key, name).

    Trees are spread over the tasks by their root. A tree of more than ``slice_rows`` arcs is cut at
    multiples of that along its tour; nodes whose interval crosses a cut are carried into the slices
    they reach. Those at one cut are ancestors of the next node, so they are no more than its path.
    """
    ship(tour.sparkSession)
    big = tour.where(f"key IS NOT NULL AND node = root AND first > {slice_rows}").select("root", F.col("first").alias("_total"))
    big = broadcast_if_small(big, 48)
    cut = lambda c: F.floor((F.col("_total") - F.col(c)) / slice_rows).cast("int")
    rows = tour.join(big, "root", "left").select("root", "first", "last", "key", "name", F.coalesce(cut("first"), F.lit(-1)).alias("_slice"), F.coalesce(cut("last"), F.lit(-1)).alias("_end"))
    own = rows.withColumn("carried", F.lit(False)).drop("_end")
    over = rows.where("_end > _slice").withColumn("_slice", F.explode(F.sequence(F.col("_slice") + 1, F.col("_end")))).withColumn("carried", F.lit(True)).drop("_end")
    sorted_rows = own.unionByName(over).repartition("root", "_slice").sortWithinPartitions("root", "_slice", F.desc("first"))
    return sorted_rows.mapInArrow(_read_intervals, "node string, name string, " + _READ)


def hierarchy(links: DataFrame, nodes: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(node, name, root_name, depth, path, entry, exit, descendants, ancestors) for every node with a link.

    ``links`` has (child, parent) keys, ``nodes`` (node, name). Links to or from unknown nodes and
    nulls are void; repeated links count once; of several parents of one node the one of smallest
    name counts. depth is the number of links up to the root (0 there), path the names from root
    to node. On a cycle depth is -1, on a way into one -2; path is then '', root_name the smallest
    name on the cycle and entry, exit and descendants are null. A link of a node to itself is a
    cycle of one. A node's descendants are the nodes of its root whose entry lies between its
    entry and exit; their number is (exit - entry - 1) / 2.

    Nodes are numbered once; leaves are peeled until cycles are left; Euler tours of the rest are
    ranked, and depth, path, ancestors and descendants are read off the intervals.
    """
    rounds = Rounds(links.sparkSession, "hierarchy")
    nodes = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("name").alias("name"))
    up = nodes.select(F.col("node").alias("parent"), F.col("name").alias("_pname"))
    known = links.distinct().join(up, "parent").join(nodes.select(F.col("node").alias("child")), "child", "left_semi")
    one = rounds.cut(known.groupBy("child").agg(F.min(F.struct("_pname", "parent")).alias("p")).select(F.col("child").alias("key"), F.col("p.parent").alias("up_key")))
    linked = one.select("key").union(one.select(F.col("up_key").alias("key"))).distinct()
    numbered, seen = rounds.counted(linked.join(one, "key", "left").join(nodes.withColumnRenamed("node", "key"), "key").withColumn("node", F.monotonically_increasing_id()))
    rows = seen["rows"]
    parent = rounds.cut(numbered.join(_side(numbered.select(F.col("key").alias("up_key"), F.col("node").alias("up")), 2 * rows), "up_key", "left").select("node", "up", "key", "name"), keep=True)
    rounds.drop(one, numbered)
    trees, cyclic = _peel(rounds, parent, rows)
    forest = parent if cyclic is None else parent.join(trees, "node")
    tour = euler_tour(rounds, forest.select("node", "up"), rows, slice_rows)
    out = read_intervals(tour.join(parent.select("node", "key", "name"), "node"), slice_rows)
    if cyclic is None:
        return out
    rings = _cycle_names(rounds, parent, cyclic).join(parent.select("node", "key", "name"), "node")
    none = F.lit(None).cast("long")
    return out.unionByName(
        rings.select(
            F.col("key").alias("node"), "name", F.col("root").alias("root_name"), F.when(F.col("on_cycle"), -1).otherwise(-2).cast("long").alias("depth"), F.lit("").alias("path"),
            none.alias("entry"), none.alias("exit"), none.alias("descendants"), F.array().cast("array<string>").alias("ancestors"),
        )
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendant): every pair of the forest once, read off the lists of ancestors without a join."""
    return tree.select(F.explode("ancestors").alias("node"), F.col("node").alias("descendant"))
