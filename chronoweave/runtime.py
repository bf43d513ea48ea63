"""Execution helpers shared by the operators: lineage cuts, hot keys, slices of hot groups."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Items a heavy-hitter sketch tracks, and the most it reports. Any key that holds more than about
#: 1.4 / TRACKED of a sketch's rows is certain to be reported.
TRACKED, REPORTED = 10_000, 4_000
#: Most slices of one key.
SLICES = 10_000
#: Rows of one key that a single task may hold before the key is cut into slices.
SLICE_ROWS = 200_000
#: Bytes up to which a side may be broadcast, after its size was measured.
BROADCAST_BYTES = 32 << 20
#: Setting under which the shuffle files of a query are deleted when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local folder is made, but only with a local master: on a cluster each
    executor would write to its own disk and rows would be lost on reading back.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_chronoweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="chronoweave-"), "chronoweave_code.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    context._chronoweave_shipped = True


#: Folders of tables each application has written, for ``clear``.
_WRITTEN: dict[str, set[str]] = {}


def clear(spark: SparkSession) -> None:
    """Deletes all tables written between rounds; frames that still read them can't be used after."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for base in _WRITTEN.pop(spark.sparkContext.applicationId, set()):
        p = jvm.org.apache.hadoop.fs.Path(base)
        p.getFileSystem(conf).delete(p, True)


class Rounds:
    """Tables written between the rounds of an iterative operator.

    Each ``cut`` writes the frame to the shared folder and reads it back, so that lineage stays
    short and a lost executor costs no recomputation. ``drop`` deletes tables no later plan reads;
    those a returned frame still reads stay until ``clear``. With ``tidy`` the shuffle files of a
    write are deleted when it ends; else they stay until the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(self.base)
        self.n = 0
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.base}/{self.n:04d}"
        self.n += 1
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.paths[id(out)] = path
        return out

    def counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``cut``, with the number of rows (``rows``) and of rows that meet each condition, counted while writing.

        A part written twice after a lost executor may count twice, so the numbers tell nothing from
        something and bound sizes from above.
        """
        seen = Observation()
        columns = df.columns
        marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])
        return self.cut(marked.select(*columns)), {k: int(v or 0) for k, v in seen.get.items()}

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where a scan has fewer parts than there are cores; large scans stay as they are.

    For work that costs much per row, over tables of few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def measured_bytes(df: DataFrame, row_bytes: int) -> int:
    """Rows times a stated row size; used before a broadcast."""
    return df.count() * row_bytes


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast when its measured size is under ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if measured_bytes(df, row_bytes) <= limit else df


def hot_keys(df: DataFrame, key: Column, slice_rows: int = SLICE_ROWS) -> list:
    """Keys with more than ``slice_rows`` rows, from mergeable sketches (no shuffle of keys).

    One sketch is certain to see such keys among REPORTED * ``slice_rows`` rows; larger tables take
    one sketch per bucket of keys. There are no more such keys than rows / ``slice_rows``. Nulls
    are never reported.
    """
    given = df.select(key.alias("k")).where("k IS NOT NULL")
    top = F.expr(f"approx_top_k(k, {REPORTED}, {TRACKED})").alias("top")
    row = given.select(top, F.count("*").alias("n")).first()
    buckets = -(-row["n"] // (REPORTED // 2 * slice_rows))
    if buckets <= 1:
        return [r["item"] for r in row["top"] or [] if r["count"] > slice_rows]
    tops = given.groupBy(F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")).agg(top).select(F.explode("top").alias("t"))
    return [r[0] for r in tops.where(F.col("t.count") > slice_rows).select("t.item").collect()]


def quantile_cuts(n: int, quantiles: list | None, slice_rows: int) -> list:
    """Bounds that cut ``n`` rows with the given evenly spaced quantiles into slices of about ``slice_rows``."""
    q = [x for x in (quantiles or []) if x is not None]
    parts = min(len(q) + 1, max(1, -(-n // slice_rows)))
    return sorted({q[min(len(q) - 1, max(0, round((len(q) + 1) * i / parts) - 1))] for i in range(1, parts)})


def quantile_grid(parts: int) -> str:
    """The array of fractions for approx_percentile that allows up to ``parts`` slices, 200 at least."""
    steps = min(SLICES, max(200, 2 * parts))
    return "array(" + ", ".join(f"{i / steps:.6f}D" for i in range(1, steps)) + f"), {10 * max(2000, steps)}"


def slice_hot(df: DataFrame, key: Sequence[str], order: str, slice_rows: int = SLICE_ROWS, probe: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Adds ``_slice``: -1 for ordinary keys; for hot keys the number of the range of ``order`` a row lies in.

    Slices are cut at approximate quantiles of ``order`` (equal values share a slice, so callers
    make ``order`` distinct within a key; at most SLICES slices a key), so that windows over
    (key, _slice) stay bounded; the carried_* functions below take what crosses the edge of a slice
    from a summary of one row per slice. ``order`` is a number or a time. ``probe`` is a cheaper
    frame with the same key columns to look for hot keys in (the rows before a shuffle). The second
    result tells whether any key is hot.
    """
    code = F.xxhash64(*[F.col(c) for c in key])
    hot = hot_keys(df if probe is None else probe, code, slice_rows)
    if not hot:
        return df.withColumn("_slice", F.lit(-1)), False
    spark = df.sparkSession
    at = f"CAST({order} AS TIMESTAMP)" if dict(df.dtypes)[order] == "timestamp_ntz" else order
    marked = df.withColumn("_code", code)
    few = broadcast_list(spark, [(h,) for h in hot], "_code long", 16)
    held = marked.join(few, "_code", "left_semi")
    most = held.groupBy("_code").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rows = held.groupBy("_code").agg(F.count("*").alias("n"), F.expr(f"approx_percentile({at}, {quantile_grid(-(-most // slice_rows))})").alias("q")).collect()  # one row per hot key
    kind = "timestamp" if at != order else dict(df.dtypes)[order]
    cuts = [(r["_code"], quantile_cuts(r["n"], r["q"], slice_rows)) for r in rows]
    table = broadcast_list(spark, cuts, f"_code long, _cuts array<{kind}>", 16 + 8 * max((len(c) for _, c in cuts), default=0))
    sliced = (
        marked.join(table, "_code", "left")
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), -1).otherwise(F.coalesce(F.expr(f"size(filter(_cuts, c -> c < {at}))"), F.lit(0))))
        .drop("_code", "_cuts")
    )
    return sliced, True


def broadcast_list(spark: SparkSession, rows: list, schema: str, row_bytes: int) -> DataFrame:
    """A frame of driver rows, marked for broadcast while its size allows."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) * row_bytes <= BROADCAST_BYTES else df


def _with_edges(df: DataFrame, key: Sequence[str], summary: DataFrame) -> DataFrame:
    """Joins the one-row-per-slice summary of the hot keys, by broadcast where its counted rows fit."""
    return df.join(broadcast_if_small(summary, 256), [*key, "_slice"], "left")


def carried_sum(df: DataFrame, key: Sequence[str], order: Sequence, value: str, out: str, hot: bool) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, this row included."""
    w = Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.sum(value).over(w))
    if not hot:
        return df
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = df.where("_slice >= 0").groupBy(*key, "_slice").agg(F.sum(value).alias("_sum")).withColumn("_carry", F.sum("_sum").over(before)).select(*key, "_slice", "_carry")
    return _with_edges(df, key, edges).withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def carried_total(df: DataFrame, key: Sequence[str], value: str, out: str, hot: bool) -> DataFrame:
    """Sum of ``value`` over all rows of the key."""
    df = df.withColumn(out, F.sum(value).over(Window.partitionBy(*key, "_slice")))
    if not hot:
        return df
    whole = df.where("_slice >= 0").groupBy(*key, "_slice").agg(F.sum(value).alias("_sum")).select(*key, "_slice", F.sum("_sum").over(Window.partitionBy(*key)).alias("_carry"))  # one row per slice
    return _with_edges(df, key, whole).withColumn(out, F.coalesce("_carry", out)).drop("_carry")


def carried_min_before(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str, hot: bool) -> DataFrame:
    """Least ``value`` of the rows of the key that stand before the row in ``order``."""
    before = lambda *part: Window.partitionBy(*part)
    df = df.withColumn(out, F.min(value).over(before(*key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    if not hot:
        return df
    earlier = before(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = df.where("_slice >= 0").groupBy(*key, "_slice").agg(F.min(value).alias("_min")).withColumn("_carry", F.min("_min").over(earlier)).select(*key, "_slice", "_carry")
    return _with_edges(df, key, edges).withColumn(out, F.least(out, "_carry")).drop("_carry")


def carried_next(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str, hot: bool, back: bool = False) -> DataFrame:
    """``value`` of the next row per key in ascending ``order`` (with ``back``: of the previous row)."""
    w = Window.partitionBy(*key, "_slice").orderBy(*order)
    take = F.lag if back else F.lead
    df = df.withColumn("_value", F.struct(value.alias("v"))).withColumn(out, take("_value").over(w))
    if hot:
        first = (F.max_by if back else F.min_by)("_value", F.struct(*order))
        edges = df.where("_slice >= 0").groupBy(*key, "_slice").agg(first.alias("_first")).withColumn("_carry", take("_first").over(Window.partitionBy(*key).orderBy("_slice"))).select(*key, "_slice", "_carry")
        df = _with_edges(df, key, edges).withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
    return df.withColumn(out, F.col(out)["v"]).drop("_value")


def carried_last(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str, hot: bool) -> DataFrame:
    """Last non-null ``value`` per key up to and including the row."""
    w = Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.last(value, True).over(w))
    if not hot:
        return df
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        df.where("_slice >= 0").groupBy(*key, "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
        .withColumn("_carry", F.last("_end", True).over(before)).select(*key, "_slice", "_carry")
    )
    return _with_edges(df, key, edges).withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
