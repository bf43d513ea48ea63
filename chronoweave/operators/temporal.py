"""Bitemporal predicates and state algebra: as-of, event time, overlap, change windows, versions, closing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(text: str) -> Column:
    """A literal instant, compared with timestamps without zone that mean UTC."""
    return F.lit(text).cast("timestamp_ntz")


def in_force(t: Column, begins: Column | str = "valid_from", ends: Column | str = "valid_to") -> Column:
    """begins <= t and (ends null or t < ends); false where ``begins`` or ``t`` is null."""
    begins, ends = (F.col(c) if isinstance(c, str) else c for c in (begins, ends))
    return F.coalesce((begins <= t) & (ends.isNull() | (ends > t)), F.lit(False))


def as_of(df: DataFrame, t: Column) -> DataFrame:
    """Rows in force at ``t`` by their validity."""
    return df.where(in_force(t))


def as_of_event(df: DataFrame, t: Column, begins: Sequence[str] = ("effective_from", "valid_from"), ends: Sequence[str] = ("effective_to", "valid_to")) -> DataFrame:
    """Rows in force at ``t`` by event time: the first known of ``begins`` and of ``ends``."""
    return df.where(in_force(t, F.coalesce(*begins), F.coalesce(*ends)))


def overlapping(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose closed period meets the closed window."""
    return df.where((F.col("valid_from") <= end) & (F.col("valid_to").isNull() | (F.col("valid_to") >= start)))


def diff_in_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that began (added) or ended (removed) in [start, end), tagged; a row may be both."""
    within = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    tags = F.filter(F.array(F.when(within("valid_from"), "added"), F.when(within("valid_to"), "removed")), lambda x: x.isNotNull())
    return df.withColumn("change", F.explode(tags))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``, by aggregation of one struct: no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def close(state: DataFrame, keys: DataFrame, on: Sequence[str], t: Column, open_only: bool = True) -> DataFrame:
    """Sets ``valid_to`` of the rows whose key is in ``keys``; rows already closed keep theirs if ``open_only``."""
    hit = state.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), list(on), "left")
    guard = F.col("_hit") & F.col("valid_to").isNull() if open_only else F.col("_hit")
    return hit.withColumn("valid_to", F.when(F.coalesce(guard, F.lit(False)), t).otherwise(F.col("valid_to"))).select(*state.columns)


def append_absent(state: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows whose key the state lacks are appended, one per key."""
    fresh = rows.dropDuplicates(list(on)).join(state.select(*on).distinct(), list(on), "left_anti")
    return state.unionByName(fresh.select(*state.columns))


def patch(state: DataFrame, update: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column the update's value where it has one, else the old one."""
    new = update.dropDuplicates(list(on)).select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = state.join(new, list(on), "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    return joined.select(*state.columns)


def remap(df: DataFrame, mapping: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Ids of ``column`` replaced by ``new`` where the mapping has them."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("_to"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def decision_view(decisions: DataFrame, documents: DataFrame, episodes: DataFrame) -> DataFrame:
    """Decisions with their parent: document or episode, title, status and repository."""
    d = documents.select(F.col("id").alias("adr_id"), F.col("title").alias("doc_title"), "status", F.col("repo_id").alias("doc_repo"), "effective_from", "effective_to").dropDuplicates(["adr_id"])
    e = episodes.select(F.col("id").alias("episode_id"), "source", F.col("repo_id").alias("ep_repo"), "occurred_at").dropDuplicates(["episode_id"])
    return (
        decisions.dropDuplicates(["id"]).join(d, "adr_id", "left").join(e, "episode_id", "left")
        .select(
            "id", F.coalesce("adr_id", F.concat(F.lit("episode:"), "episode_id")).alias("parent_id"), F.coalesce("title", "doc_title", "source").alias("title"),
            F.coalesce("status", F.lit("episode")).alias("status"), F.coalesce("doc_repo", "ep_repo").alias("repo_id"), "source_uri", "text", "confidence",
            "valid_from", "valid_to", "ingested_at", "effective_from", "effective_to", "occurred_at",
        )
    )


def running_change(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Each version beside the value of the version before it."""
    return df.withColumn(f"{value}_before", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
