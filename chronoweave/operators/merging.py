"""Chains of merges: every loser goes to the survivor at the end of its chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import Rounds


def last_survivors(merges: DataFrame) -> DataFrame:
    """(loser_id, survivor_id) with chains followed to their end, by pointers that double each round.

    A loser named twice goes to its smallest survivor; merges of a row with itself and circles of
    merges, which no row survives, are left out. Rounds end when no pointer moves or only circles do.
    """
    rounds = Rounds(merges.sparkSession, "merges")
    one = merges.where("loser_id IS NOT NULL AND survivor_id IS NOT NULL AND loser_id <> survivor_id").groupBy("loser_id").agg(F.min("survivor_id").alias("survivor_id"))
    state, left = rounds.cut(one.withColumn("done", F.lit(False))), -1
    while True:
        ahead = state.select(F.col("loser_id").alias("survivor_id"), F.col("survivor_id").alias("_next"), F.col("done").alias("_done"))
        moved = state.join(ahead, "survivor_id", "left").select("loser_id", F.coalesce("_next", "survivor_id").alias("survivor_id"), (F.col("done") | F.col("_next").isNull() | F.col("_done")).alias("done"))
        fresh = rounds.cut(moved)
        rounds.drop(state)
        state = fresh
        before, left = left, state.where("NOT done").count()
        # in a circle nothing is ever done, elsewhere every round settles some
        if left in (0, before):
            return state.where("done").select("loser_id", "survivor_id")
