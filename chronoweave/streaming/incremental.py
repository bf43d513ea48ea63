"""Streaming ingestion: file streams into versioned state, late and repeated rows included."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chronoweave.operators.temporal import latest


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Rows once per key within the watermark; state is dropped beyond it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, size: str, keys: Sequence[str], late: str) -> DataFrame:
    """Counts per tumbling window and keys; a window is final once the watermark has passed it."""
    w = F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


class VersionedState:
    """Tables replaced as a whole: version n + 1 is written beside version n, then a pointer moves.

    A batch applied twice (after a lost driver) finds its number at the pointer and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        root = self.path(self.folder)
        if not self.fs.exists(root):
            return -1
        names = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done")), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{v}") if v >= 0 else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame, version: int) -> None:
        if version <= self.version():
            return
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.fs.create(self.path(f"{self.folder}/v{version}.done"), True).close()
        old = self.path(f"{self.folder}/v{version - 2}")
        if self.fs.exists(old):
            self.fs.delete(old, True)


class PartedState:
    """A table kept in parts by the hash of its key: a batch reads and rewrites only the parts it touches.

    The manifest of version n names the batch in which each part was last written. It is written
    whole before it gets its name, so a batch that died half-way leaves the old version in force,
    and a batch applied twice finds its number and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], parts: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.parts = spark, folder, schema, list(keys), parts
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """(version, batch of each part that has rows)."""
        root = self.path(self.folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        version = max((int(n[1:]) for n in names if n.startswith("m") and n[1:].isdigit()), default=-1)
        if version < 0:
            return -1, {}
        row = self.spark.read.json(f"{self.folder}/m{version}", schema="part int, batch int").collect()  # one row per part
        return version, {r["part"]: r["batch"] for r in row}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/b{batch}/part={part}" for part, batch in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()[1])

    def apply(self, batch: DataFrame, number: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the touched parts by ``change(old rows, batch)``, which keeps rows in their part."""
        version, held = self.manifest()
        if number <= version:
            return
        touched = [r[0] for r in batch.select(self._part().alias("p")).distinct().collect()]  # at most ``parts``
        fresh = change(self._rows({p: b for p, b in held.items() if p in set(touched)}), batch)
        target = f"{self.folder}/b{number}"
        fresh.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(target)
        root = self.path(target)
        written = [s.getPath().getName() for s in self.fs.listStatus(root)]
        now = {p: b for p, b in held.items() if p not in set(touched)} | {int(n[5:]): number for n in written if n.startswith("part=")}
        draft = f"{self.folder}/_m{number}"
        self.spark.createDataFrame(sorted(now.items()), "part int, batch int").coalesce(1).write.mode("overwrite").json(draft)
        self.fs.rename(self.path(draft), self.path(f"{self.folder}/m{number}"))
        live = set(now.values()) | set(held.values())
        for s in self.fs.listStatus(self.path(self.folder)):
            n = s.getPath().getName()
            old_batch = n.startswith("b") and n[1:].isdigit() and int(n[1:]) not in live
            old_manifest = n.startswith("m") and n[1:].isdigit() and int(n[1:]) < version
            if old_batch or old_manifest:
                self.fs.delete(s.getPath(), True)


def upsert_latest(state: DataFrame, batch: DataFrame, keys: Sequence[str], recorded: Sequence[str]) -> DataFrame:
    """Of state and batch the row recorded last per key; arrival order doesn't matter."""
    both = state.unionByName(batch.select(*state.columns))
    return latest(both, keys, [F.col(c) for c in recorded]).select(*state.columns)


def run_into_parts(stream: DataFrame, state: PartedState, change: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Applies every micro-batch to the parts it touches, exactly once by the batch's number."""
    return stream.writeStream.foreachBatch(lambda batch, number: state.apply(batch, number, change)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_counts(stream: DataFrame, time: str, size: str, slide: str, keys: Sequence[str], late: str) -> DataFrame:
    """Counts per sliding window and keys; a window is final once the watermark has passed it."""
    w = F.window(time, size, slide)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_into(stream: DataFrame, state: VersionedState, apply: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Applies every micro-batch to the state, exactly once by the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        state.replace(apply(state.read(), batch), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
