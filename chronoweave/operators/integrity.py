"""Integrity oracle: natural-key projections compared as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_key(*parts: Column) -> Column:
    """Parts joined by '|', nulls as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def surplus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b) of keys whose counts differ."""
    x = a.groupBy(key).agg(F.count("*").alias("in_a"))
    y = b.groupBy(key).agg(F.count("*").alias("in_b"))
    zero = F.lit(0).cast("long")
    return x.join(y, key, "full_outer").select(key, F.coalesce("in_a", zero).alias("in_a"), F.coalesce("in_b", zero).alias("in_b")).where("in_a <> in_b")


def verdict(differences: DataFrame) -> DataFrame:
    """One row: clean or divergent, and the number of differing keys."""
    return differences.agg(F.count("*").alias("keys")).select(F.when(F.col("keys") == 0, "clean").otherwise("divergent").alias("verdict"), "keys")
