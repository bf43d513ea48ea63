"""Hybrid retrieval: keyword and vector rankings, fused by reciprocal ranks, with their provenance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import term_frequency
from chronoweave.runtime import Rounds, ship

#: Constant of reciprocal-rank fusion.
RRF = 60
#: Query vectors held by a task at a time.
BLOCK = 4096


def keyword_rank(df: DataFrame, key: str, title: str, text: str, words: list[str], k: int) -> DataFrame:
    """(key, score, rank): the k rows with most occurrences of the words in title and text, ties by key."""
    top = keyword_scores(df, key, title, text, words).orderBy(F.desc("score"), key).limit(k)
    return ranked(top, [F.desc("score"), F.col(key)])


def keyword_scores(df: DataFrame, key: str, title: str, text: str, words: list[str]) -> DataFrame:
    """(key, score): occurrences of the words in title and text, of all rows that have any."""
    score = term_frequency(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), words)
    return df.select(F.col(key), score.alias("score")).where("score > 0")


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the rank of the rows of a short (top-k) list."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked_whole(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the rank of the rows of a list of any length: a sort by ranges, each range behind the rows before it.

    The ranges are written once, so that they can't differ between the count and the ranks.
    """
    spark = df.sparkSession
    parts = Rounds(spark, "ranked").cut(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()), keep=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("rank", within.cast("long")).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("rank") + F.col("_before")).drop("_part", "_before")


def fuse(lists: dict[str, DataFrame], key: str, k: int) -> DataFrame:
    """(key, score, found_by): sum of 1 / (60 + rank) over ranked lists, best k, ties by key."""
    return fuse_all(lists, key).orderBy(F.desc("score"), key).limit(k)


def fuse_all(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, score, found_by) of all rows of the lists."""
    parts = [df.select(key, "rank", F.lit(name).alias("list")) for name, df in lists.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("found_by"))


def explain(lists: dict[str, DataFrame], key: str) -> DataFrame:
    """(step, key, rank): what each list contributed."""
    parts = [df.select(F.lit(name).alias("step"), key, "rank") for name, df in lists.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def cosine_search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, threshold: float, best: int | None = None) -> DataFrame:
    """(query, hit, cosine) of all rows whose cosine with a query vector reaches the threshold, itself left out.

    The queries are read in blocks of BLOCK vectors; each block meets every row in one matrix
    product per batch and length of vectors. Vectors of different lengths, empty and null ones and
    those of zero norm have cosine 0, and are hits where the threshold allows that. With ``best``
    each batch gives no more than its best hits of a query, ties by hit, which ``nearest`` merges.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[key]
    out, block = None, []

    def search(rows: list) -> DataFrame:
        ids = np.array([k for k, _ in rows])
        widths = np.array([len(v) if v else 0 for _, v in rows], np.int64)
        by_width = {}
        for n in np.unique(widths[widths > 0]).tolist():
            at = np.flatnonzero(widths == n)
            q = np.array([rows[i][1] for i in at], np.float64).reshape(len(at), n)
            by_width[n] = (at, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))
        sent = spark.sparkContext.broadcast((ids, by_width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, by_width = sent.value
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = batch.column(1).to_pylist()
                sizes = np.array([len(v) if v else 0 for v in vectors], np.int64)
                c = np.zeros((len(ids), len(keys)))
                for n, (at, q) in by_width.items():
                    own = np.flatnonzero(sizes == n)
                    if len(own):
                        m = np.array([vectors[i] for i in own], np.float64).reshape(len(own), n)
                        c[np.ix_(at, own)] = q @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
                keep = (c >= threshold) & (ids[:, None] != keys[None, :])
                x, y = np.nonzero(keep)
                if best is not None and len(x):
                    order = np.lexsort((keys[y], -c[x, y], x))
                    x, y = x[order], y[order]
                    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
                    x, y = x[place < best], y[place < best]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(keys[y]), pa.array(c[x, y])], names=["query", "hit", "cosine"])

        return vectors.select(key, vector).where(F.col(key).isNotNull()).mapInArrow(run, f"query {kind}, hit {kind}, cosine double")

    for r in queries.select(key, vector).where(F.col(key).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, ties by hit: partial lists are merged, no query's hits are sorted whole."""
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "hit")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
