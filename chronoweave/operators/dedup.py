"""Duplicate detection: exact normal forms by aggregation, near ones by an ordered greedy fold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import content_hash
from chronoweave.runtime import ship


def exact_groups(df: DataFrame, row_id: str, text: str, order: str) -> DataFrame:
    """(row_id, survivor_id, copies): rows of equal normalised text; the first by order and id survives.

    The survivor is a minimum, so a text with very many copies is aggregated before the shuffle.
    """
    h = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), content_hash(F.col(text)).alias("h"), F.col(order).alias("o")).distinct()
    first = h.groupBy("h").agg(F.min(F.struct("o", "row_id"))["row_id"].alias("survivor_id"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(first, "h").select(F.col("row_id").alias(row_id), "survivor_id", "copies")


def greedy_survivors(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(loser_id, survivor_id): rows folded, oldest first, into the best earlier kept row they match.

    ``pairs`` has (group, a, b, similarity) with one group per connected set of matches, ``rows``
    (group, id, seq, fixed); fixed rows only survive. The fold runs per group: cut very large
    groups by a higher threshold first.
    """
    ship(pairs.sparkSession)
    kind = dict(rows.dtypes)["id"]

    def fold(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, s in zip(p["a"], p["b"], p["similarity"]):
            near.setdefault(a, []).append((s, b))
            near.setdefault(b, []).append((s, a))
        kept, out = set(), []
        for row in r.sort_values(["fixed", "seq", "id"], ascending=[False, True, True]).itertuples():
            best = [(-s, o) for s, o in near.get(row.id, []) if o in kept]
            if row.fixed or not best:
                kept.add(row.id)
            else:
                out.append((row.id, min(best)[1]))
        return pd.DataFrame(out, columns=["loser_id", "survivor_id"])

    return pairs.groupBy("group").cogroup(rows.groupBy("group")).applyInPandas(fold, f"loser_id {kind}, survivor_id {kind}")
