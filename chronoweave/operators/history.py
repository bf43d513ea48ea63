"""History of changing attributes: per-attribute change logs, combined at the union of their boundaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import SLICE_ROWS, carried_last, carried_next, carried_sum, hot_keys, slice_hot


def counted_rows(df: DataFrame, key: str, attrs: Sequence[str], valid_from: str, valid_to: str, recorded: str) -> DataFrame:
    """Of the rows with one key and ``valid_from`` the one recorded last: (key, _from, _until, attrs).

    Rows whose key or ``valid_from`` is null are left out: they state nothing about any time. A
    null ``recorded`` counts as earliest; ties are settled by the largest ``valid_to`` (null, that
    is open, first of all) and then the largest attribute values, so the result is defined.
    """
    state = F.struct(F.col(recorded).alias("r"), F.col(valid_to).isNull().alias("o"), F.col(valid_to).alias("u"), *[F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)])
    return (
        df.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(valid_from).alias("_from"))
        .agg(F.max(state).alias("_s"))
        .select("_key", "_from", F.col("_s.u").alias("_until"), *[F.col(f"_s.a{i}").alias(f"_a{i}") for i in range(len(attrs))])
    )


def change_log(df: DataFrame, keys: Sequence[str], value: str, hot: bool) -> DataFrame:
    """Intervals of one attribute: adjoining rows of equal value (nulls are equal) become one.

    ``df`` has (keys.., _from, _end, value, _slice), disjoint per key; ``_end`` null is open.
    """
    keys = list(keys)
    df = carried_next(df, keys, ["_from"], F.struct(F.col("_end").alias("e"), F.col(value).alias("v")), "_prev", hot, back=True)
    starts = (F.col("_prev").isNull() | ~(F.col("_prev.v").eqNullSafe(F.col(value))) | F.col("_prev.e").isNull() | (F.col("_prev.e") != F.col("_from"))).cast("long")
    df = carried_sum(df.withColumn("_starts", starts), keys, ["_from"], "_starts", "_version", hot)
    last = F.max(F.struct("_from", "_end"))
    return df.groupBy(*keys, "_version").agg(F.min("_from").alias("_from"), last["_end"].alias("_end"), F.first(value).alias(value)).drop("_version")


def attribute_history(
    df: DataFrame, key: str, attrs: Sequence[str], valid_from: str = "valid_from", valid_to: str = "valid_to", recorded: str = "ingested_at", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row per version: (key, attrs..., valid_from, valid_to), ``valid_to`` null while open.

    Each attribute gets its own change log with its own intervals; the logs are split at the union
    of their boundaries and equal neighbours are joined again. A row holds until its ``valid_to``
    or the next counted row of the key, whichever is earlier; rows that then hold for no time are
    left out, though they still end the row before. An empty table gives an empty one.

    Without hot keys all steps share one partitioning by the key, so the rows are shuffled once.
    """
    given = df.select(F.col(key).alias("_k"), *[F.col(c).alias(n) for c, n in zip((valid_from, valid_to, recorded), ("_vf", "_vt", "_rec"))], *[F.col(a).alias(f"_v{i}") for i, a in enumerate(attrs)]).where("_k IS NOT NULL AND _vf IS NOT NULL")
    hot = bool(hot_keys(given, F.xxhash64("_k"), slice_rows))
    rows = counted_rows(given if hot else given.repartition("_k"), "_k", [f"_v{i}" for i in range(len(attrs))], "_vf", "_vt", "_rec")
    rows = slice_hot(rows, ["_key"], "_from", slice_rows, given.select(F.col("_k").alias("_key")))[0] if hot else rows.withColumn("_slice", F.lit(-1))
    rows = carried_next(rows, ["_key"], ["_from"], F.col("_from"), "_next", hot)
    rows = rows.withColumn("_end", F.least("_until", "_next")).where("_end IS NULL OR _end > _from").drop("_until", "_next")
    names = [f"_a{i}" for i in range(len(attrs))]
    kinds = dict(rows.dtypes)
    # one frame holds the logs of all attributes, side by side under the key
    own = [F.struct(F.lit(i).alias("attr"), *[(F.col(n) if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in names]) for i, name in enumerate(names)]
    each = rows.select("_key", "_from", "_end", "_slice", F.explode(F.array(*own)).alias("o")).select("_key", F.col("o.attr").alias("_attr"), "_from", "_end", "_slice", F.struct(*[F.col(f"o.{n}") for n in names]).alias("_held"))
    logs = change_log(each, ["_key", "_attr"], "_held", hot)
    out = _combine(logs, names, hot, slice_rows)
    return out.select(F.col("_key").alias(key), *[F.col(a).alias(n) for a, n in zip(names, attrs)], F.col("_from").alias("valid_from"), F.col("_end").alias("valid_to"))


def _combine(logs: DataFrame, names: list[str], hot: bool, slice_rows: int) -> DataFrame:
    """Splits the logs at the union of their boundaries and joins equal neighbours."""
    state = dict(logs.dtypes)["_held"]
    held = F.struct(F.col("_from").alias("t"), F.lit(1).alias("p"), F.col("_held").alias("v"))
    ended = F.struct(F.col("_end").alias("t"), F.lit(0).alias("p"), F.lit(None).cast(state).alias("v"))
    marks = logs.select("_key", "_attr", F.explode(F.array(held, ended)).alias("m")).where("m.t IS NOT NULL")
    # of an end and a beginning at one instant the beginning counts; a null value is the end of a period
    mark = [F.max_by(F.struct(F.col("m.p").alias("on"), F.col(f"m.v.{n}").alias("v")), F.when(F.col("_attr") == i, F.col("m.p"))).alias(n) for i, n in enumerate(names)]
    points = marks.groupBy("_key", F.col("m.t").alias("_from")).agg(*mark)
    points = slice_hot(points, ["_key"], "_from", slice_rows, marks.select("_key"))[0] if hot else points.withColumn("_slice", F.lit(-1))
    for name in names:
        points = carried_last(points, ["_key"], ["_from"], name, f"{name}_now", hot)
    points = carried_next(points, ["_key"], ["_from"], F.col("_from"), "_end", hot)
    points = points.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{n}_now.on") == 1, F.lit(False)) for n in names]))
    points = points.select("_key", "_from", "_end", F.struct(*[F.col(f"{n}_now") for n in names]).alias("_state"), "_slice")
    out = change_log(points, ["_key"], "_state", hot)
    return out.select("_key", "_from", "_end", *[F.col(f"_state.{n}_now.v").alias(n) for n in names])
