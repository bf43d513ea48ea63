"""Attributes as known at event time: bitemporal as-of join by co-grouping and binary search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.runtime import SLICE_ROWS, broadcast_if_small, broadcast_list, carried_min_before, hot_keys, quantile_cuts, quantile_grid, ship, slice_hot

FOREVER = np.iinfo(np.int64).max
#: Rows of both sides that one co-group task holds.
GROUP_ROWS = 100_000


def known_periods(entity: np.ndarray, vf: np.ndarray, vt: np.ndarray, rec: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each version the instants at which it is the one known and in force: (order, start, end).

    A row counts from when it is both recorded and valid until a later recorded row of the same
    ``vf`` replaces it or its own ``vt``. Of rows recorded at the same instant the largest row id counts.
    """
    order = np.lexsort((row, rec, vf, entity))
    e, f, t, r = entity[order], vf[order], vt[order], rec[order]
    end = t.copy()
    if len(e) > 1:
        same = (e[1:] == e[:-1]) & (f[1:] == f[:-1])
        end[:-1] = np.where(same, np.minimum(end[:-1], r[1:]), end[:-1])
    return order, np.maximum(f, r), end


def top_periods(entity: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entity the row of highest ``rank`` over time, as breakpoints (entity, time, row or -1)."""
    keep = start < end
    entity, start, end, rank, row = entity[keep], start[keep], end[keep], rank[keep], row[keep]
    order = np.lexsort((start, entity))
    entity, start, end, rank, row = (x[order] for x in (entity, start, end, rank, row))
    n = len(entity)
    if not n:
        return entity, start, row
    # entities whose periods don't overlap need no sweep: breakpoints are the starts and the ends before a gap
    ends = np.flatnonzero(np.r_[entity[1:] != entity[:-1], True])
    starts = np.r_[0, ends[:-1] + 1]
    follows = np.r_[False, entity[1:] == entity[:-1]]
    clash = np.zeros(n, bool)
    clash[1:] = follows[1:] & (start[1:] < end[:-1])
    messy = np.add.reduceat(clash, starts) > 0
    plain = ~np.repeat(messy, ends - starts + 1)
    gap = plain & (end < FOREVER)
    be, bt, br = [entity[plain], entity[gap]], [start[plain], end[gap]], [row[plain], np.full(gap.sum(), -1, np.int64)]
    out_e, out_t, out_r = [], [], []
    for lo, hi in zip(starts[messy], ends[messy] + 1):
        times = np.unique(np.r_[start[lo:hi], end[lo:hi]])
        heap, i, last = [], lo, None
        for t in times.tolist():
            while i < hi and start[i] <= t:
                heapq.heappush(heap, (-int(rank[i]), int(end[i]), int(row[i])))
                i += 1
            while heap and heap[0][1] <= t:
                heapq.heappop(heap)
            now = heap[0][2] if heap else -1
            if now != last:
                out_e.append(entity[lo])
                out_t.append(t)
                out_r.append(now)
                last = now
    e = np.concatenate([*be, np.array(out_e, entity.dtype)])
    t = np.concatenate([*bt, np.array(out_t, np.int64)])
    r = np.concatenate([*br, np.array(out_r, np.int64)])
    # at one instant a beginning stands after the end of the period before it
    order = np.lexsort((r >= 0, t, e))
    return e[order], t[order], r[order]


def _micros(s: pd.Series) -> np.ndarray:
    """Microseconds since 1970 as given by Spark; nulls are FOREVER."""
    return s.fillna(FOREVER).to_numpy(np.int64) if s.dtype != np.int64 else s.to_numpy()


def _match(events: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
    if not len(events) or not len(versions):
        return pd.DataFrame({"event_id": pd.Series(dtype=object), "row_id": pd.Series(dtype=object)})
    events, versions = events.drop_duplicates(ignore_index=True), versions.drop_duplicates(ignore_index=True)
    codes, _ = pd.factorize(pd.concat([versions["entity"], events["entity"]], ignore_index=True))
    ve, ee = codes[: len(versions)], codes[len(versions) :]
    rank_of = np.argsort(np.argsort(versions["row_id"].to_numpy().astype(str), kind="stable"), kind="stable")
    order, start, end = known_periods(ve, _micros(versions["vf"]), _micros(versions["vt"]), _micros(versions["rec"]), rank_of)
    given = _micros(versions["until"])[order]
    end = np.minimum(end, given)
    be, bt, br = top_periods(ve[order], start, end, _micros(versions["vf"])[order], order.astype(np.int64))
    t = _micros(events["t"])
    times = np.unique(np.r_[bt, t])
    width = np.int64(len(times) + 1)
    at = np.searchsorted(be * width + np.searchsorted(times, bt), ee * width + np.searchsorted(times, t), side="right") - 1
    hit = (at >= 0) & (len(be) > 0)
    hit[hit] = (be[at[hit]] == ee[hit]) & (br[at[hit]] >= 0)
    return pd.DataFrame({"event_id": events["event_id"].to_numpy()[hit], "row_id": versions["row_id"].to_numpy()[br[at[hit]]]})


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str,
    event_key: str,
    event_time: str,
    row_id: str,
    row_key: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    recorded: str = "ingested_at",
    group_rows: int = GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(event_id, row_id): for each event the version of its entity known and in force at its time.

    Of the versions recorded by then only the one recorded last counts for each ``valid_from``; of
    those in force (valid_from <= t < valid_to) the latest ``valid_from`` wins. Events without an
    answer, and rows with a null key, time, ``valid_from`` or ``recorded``, give no row; repeated
    rows count once. Entities share co-groups of about ``group_rows`` rows; a hot entity is cut into
    slices of time, in which a version takes part wherever the period reaches in which it may win.
    """
    spark = events.sparkSession
    ship(spark)
    us = lambda c, kind: F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")
    ek, vk = dict(events.dtypes), dict(versions.dtypes)
    ev = events.select(F.col(event_key).alias("entity"), us(event_time, ek[event_time]).alias("t"), F.col(event_id).alias("event_id")).where("entity IS NOT NULL AND t IS NOT NULL")
    ve = versions.select(
        F.col(row_key).alias("entity"), us(valid_from, vk[valid_from]).alias("vf"), us(valid_to, vk[valid_to]).alias("vt"), us(recorded, vk[recorded]).alias("rec"), F.col(row_id).alias("row_id")
    ).where("entity IS NOT NULL AND vf IS NOT NULL AND rec IS NOT NULL")
    ve = ve.withColumn("until", F.lit(None).cast("long"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(events.count() + versions.count()) // group_rows))
    bucket = F.pmod(F.xxhash64("entity"), F.lit(groups)).cast("int")
    hot = hot_keys(ev.select("entity").unionByName(ve.select("entity")), F.col("entity"), slice_rows)
    ev, ve = ev.withColumn("_slice", F.lit(-1)), ve.withColumn("_slice", F.lit(-1))
    if hot:
        ev, ve = _slice_hot_entities(ev, ve, hot, slice_rows)
        bucket = F.when(F.col("_slice") < 0, bucket).otherwise(F.pmod(F.xxhash64("entity", "_slice", "_deal"), F.lit(groups)).cast("int") + groups)
    left = ev.withColumn("_bucket", bucket).drop("_slice", "_deal")
    # nulls would make pandas turn the numbers into floats
    right = ve.withColumn("_bucket", bucket).drop("_slice", "_deal").fillna(int(FOREVER), ["vt", "until"])
    kinds = f"event_id {ek[event_id]}, row_id {vk[row_id]}"
    found = left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInPandas(lambda a, b: _match(a, b), kinds)
    return found


def _without_dominated(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Ends each version of a hot entity where one of later ``vf`` begins that never ends itself: it can't be on top after that.

    So an entity whose versions all stay open has periods that follow each other instead of
    reaching to the end of time.
    """
    # of rows recorded at one instant any may be the one that counts, so all must be open
    same = rows.groupBy("entity", "vf", "rec").agg(F.max("vt").alias("_vt"), F.max("until").alias("_until"))
    open_start = F.when(F.col("_vt").isNull() & F.col("_until").isNull(), F.greatest("vf", "rec"))
    per = same.groupBy("entity", "vf").agg(F.min(open_start).alias("_s")).withColumn("_back", -F.col("vf"))
    per, hot = slice_hot(per, ["entity"], "_back", slice_rows)
    per = carried_min_before(per, ["entity"], ["_back"], "_s", "_over", hot).select("entity", "vf", "_over")
    return rows.join(per, ["entity", "vf"]).withColumn("until", F.least("until", "_over")).drop("_over")


def _slice_hot_entities(ev: DataFrame, ve: DataFrame, hot: list, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Cuts hot entities at quantiles of the event times; ends by replacement are set beforehand.

    Events of one slice that are still too many, as at one instant, are dealt to several groups,
    each with the versions of the slice.
    """
    spark = ev.sparkSession
    kind = dict(ev.dtypes)["entity"]
    few = broadcast_list(spark, [(h,) for h in hot], f"entity {kind}", 64)
    hot_ev, hot_ve = (x.join(few, "entity", "left_semi") for x in (ev.drop("_slice"), ve.drop("_slice")))
    w = Window.partitionBy("entity", "vf").orderBy("rec")
    # rows of one recording instant keep a common end, so that the co-group still settles the tie
    ends = hot_ve.groupBy("entity", "vf", "rec").agg(F.lit(1).alias("one")).withColumn("until", F.lead("rec").over(w)).drop("one")
    rows = _without_dominated(hot_ve.distinct().drop("until").join(ends, ["entity", "vf", "rec"]), slice_rows)
    both = hot_ev.select("entity", "t").unionByName(rows.select("entity", F.greatest("vf", "rec").alias("t")))
    most = both.groupBy("entity").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = both.groupBy("entity").agg(F.count("*").alias("n"), F.expr(f"approx_percentile(t, {quantile_grid(-(-most // slice_rows))})").alias("q")).collect()  # one row per hot entity
    cuts = [(r["entity"], quantile_cuts(max(r["n"], slice_rows + 1), r["q"], slice_rows)) for r in n]
    table = broadcast_list(spark, cuts, f"entity {kind}, _cuts array<bigint>", 64 + 8 * max((len(c) for _, c in cuts), default=0))
    part = lambda c: F.expr(f"size(filter(_cuts, c -> c <= {c}))")
    hot_ev = hot_ev.join(table, "entity").withColumn("_slice", part("t")).drop("_cuts")
    deals = hot_ev.groupBy("entity", "_slice").agg(F.ceil(F.count("*") / (2 * slice_rows)).cast("int").alias("_deals")).where("_deals > 1")
    deals = broadcast_if_small(deals, 96)
    hot_ev = hot_ev.join(deals, ["entity", "_slice"], "left").withColumn("_deal", F.pmod(F.xxhash64("event_id"), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    rows = (
        rows.join(table, "entity").withColumn("_a", F.greatest("vf", "rec")).withColumn("_z", F.least("vt", "until"))
        .where("_z IS NULL OR _a < _z")
        .withColumn("_slice", F.explode(F.sequence(part("_a"), F.when(F.col("_z").isNull(), F.size("_cuts")).otherwise(part("_z - 1")))))
        .drop("_a", "_z", "_cuts")
    )
    rows = rows.join(deals, ["entity", "_slice"], "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    rest = lambda x: x.join(few, "entity", "left_anti").withColumn("_deal", F.lit(0))
    return rest(ev).unionByName(hot_ev), rest(ve).unionByName(rows)
