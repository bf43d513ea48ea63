"""References to records that aren't there: signed reference and existence counts per key, kept from change deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import SLICE_ROWS, Rounds, broadcast_if_small, carried_sum, carried_total, hot_keys, slice_hot

KEYS = ["field", "key"]


def _points(df: DataFrame, begins: str, ends: str | None) -> DataFrame:
    """One row per beginning (+1) and end (-1) of each row: (field, key, t, began, delta).

    An end before the beginning would count below zero: such a row holds at no time.
    """
    points = [F.struct(F.col(begins).alias("t"), F.lit(1).alias("began"), F.lit(1).alias("delta"))]
    if ends:
        points.append(F.when(F.col(ends).isNotNull(), F.struct(F.greatest(F.col(begins), F.col(ends)).alias("t"), F.lit(0).alias("began"), F.lit(-1).alias("delta"))))
    return df.select("field", "key", F.explode(F.array(*points)).alias("p")).where(F.col("p").isNotNull()).select("field", "key", "p.t", "p.began", "p.delta")


def existence_deltas(targets: DataFrame, field: str, key: str, begins: str, ends: str | None) -> DataFrame:
    """(field, key, t, began, delta): +1 where a target row begins, -1 where it ends.

    Target rows with a null key or no beginning exist at no time and give no delta.
    """
    df = targets.where(F.col(key).isNotNull() & F.col(begins).isNotNull())
    return _points(df.withColumns({"field": F.lit(field), "key": F.col(key)}), begins, ends)


def reference_deltas(rows: DataFrame, field: str, row_id: str, key: str, begins: str, ends: str | None) -> DataFrame:
    """(field, key, t, began, delta): +1 where a reference begins, -1 where its row ends. Repeated rows count once."""
    df = rows.where(F.col(key).isNotNull() & F.col(begins).isNotNull()).select(F.lit(field).alias("field"), F.col(key).alias("key"), F.col(row_id), F.col(begins), *([F.col(ends)] if ends else [])).distinct()
    return _points(df, begins, ends)


def references(rows: DataFrame, field: str, row_id: str, key: str, at: str) -> DataFrame:
    """(field, key, t, row_id) of rows that refer to something; a null key or time refers to nothing."""
    return rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.lit(field).alias("field"), F.col(key).alias("key"), F.col(at).alias("t"), F.col(row_id).alias("row_id"))


def apply_deltas(state: DataFrame | None, refs: DataFrame, there: DataFrame) -> DataFrame:
    """State (field, key, refs, there, begun) with signed deltas added: counts per key, by sums that combine before the shuffle.

    ``refs`` and ``there`` are deltas of references and of existence. The order of batches doesn't
    matter, and a row taken back is a delta of the other sign. Keys all of whose counts are zero
    are left out.
    """
    zero = F.lit(0).cast("long")
    new = refs.select(*KEYS, F.col("delta").cast("long").alias("refs"), zero.alias("there"), zero.alias("begun")).unionByName(
        there.select(*KEYS, zero.alias("refs"), F.col("delta").cast("long").alias("there"), F.col("began").cast("long").alias("begun"))
    )
    both = new if state is None else state.select(*KEYS, "refs", "there", "begun").unionByName(new)
    return both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("refs", "there", "begun")]).where("refs <> 0 OR there <> 0 OR begun <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """(field, key, refs, kind) of the keys that are referred to and aren't there: missing, or deleted where they once began."""
    return state.where("refs > 0 AND there <= 0").select(*KEYS, "refs", F.when(F.col("begun") > 0, "deleted").otherwise("missing").alias("kind"))


def orphan_instants(refs: DataFrame, deltas: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(field, key, t, kind): the instants at which a key with new references has no target in force.

    Reference and existence deltas are summed per key and instant and run along the time: a
    positive number of references beside an existence count of zero is an orphan. Deltas of an
    instant apply before the references of that instant. ``kind`` is missing (the key never
    begins), late (nothing has begun by then) or deleted.

    Without hot keys one shuffle by key serves all steps; hot keys are summed per instant before
    they are shuffled, and cut into slices of time.
    """
    zero = F.lit(0).cast("long")
    events = deltas.select(*KEYS, "t", F.col("began").cast("long").alias("began"), F.col("delta").cast("long").alias("delta"), zero.alias("refs")).unionByName(
        refs.select(*KEYS, "t", zero.alias("began"), zero.alias("delta"), F.lit(1).cast("long").alias("refs"))
    )
    probe = refs.select(*KEYS).unionByName(deltas.select(*KEYS))
    hot = bool(hot_keys(probe, F.xxhash64(*KEYS), slice_rows))
    summed = (events if hot else events.repartition(*KEYS)).groupBy(*KEYS, "t").agg(*[F.sum(c).alias(c) for c in ("began", "delta", "refs")])
    summed = slice_hot(summed, KEYS, "t", slice_rows, probe)[0] if hot else summed.withColumn("_slice", F.lit(-1))
    summed = carried_sum(summed, KEYS, ["t"], "delta", "_alive", hot)
    summed = carried_sum(summed, KEYS, ["t"], "began", "_begun", hot)
    summed = carried_total(summed, KEYS, "began", "_ever", hot)
    kind: Column = F.when(F.col("_begun") > 0, "deleted").when(F.col("_ever") > 0, "late").otherwise("missing")
    return summed.where("refs > 0 AND _alive <= 0").select(*KEYS, "t", kind.alias("kind"))


def orphans(refs: DataFrame, deltas: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """References whose key has no existing target at their time: (field, row_id, kind, t).

    The counts give the keys and instants (``orphan_instants``); the referring rows are those of
    such a key and instant. Repeated reference rows count once. The few orphans are broadcast to
    the references where their counted rows fit, else joined by shuffle.
    """
    found = Rounds(refs.sparkSession, "orphans").cut(orphan_instants(refs, deltas, slice_rows), keep=True)
    return refs.join(broadcast_if_small(found, 160), [*KEYS, "t"]).select("field", F.col("row_id").cast("string").alias("row_id"), "kind", "t").distinct()
