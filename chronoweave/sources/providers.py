"""Pluggable embedding providers; without one, work is skipped with a warning row instead of failing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import ship

Embed = Callable[[list[str]], list[list[float]]]


def hashing_embedder(width: int = 64) -> Embed:
    """A deterministic offline provider: signed counts of hashed words, of length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def chunks(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(0, len(text), n)] or [""]


def backfill(rows: DataFrame, key: str, text: str, vectors: DataFrame | None, provider: Embed | None, chunk: int = 2000) -> tuple[DataFrame, str | None]:
    """(key, embedding) of the rows without a vector, and a warning if there is no provider.

    Long texts are embedded in chunks whose vectors of equal length are averaged.
    """
    todo = rows.where(F.col(text).isNotNull()).select(key, text).dropDuplicates([key])
    if vectors is not None:
        todo = todo.join(vectors.where("embedding IS NOT NULL").select(key), key, "left_anti")
    kinds = f"{key} {dict(rows.dtypes)[key]}, embedding array<float>"
    if provider is None:
        return rows.sparkSession.createDataFrame([], kinds), "no embedding provider: skipped"
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [chunks(t, chunk) for t in f[text]]
            flat = provider([c for cs in cut for c in cs])
            out, at = [], 0
            for cs in cut:
                part = [np.array(v) for v in flat[at : at + len(cs)]]
                at += len(cs)
                part = [v for v in part if len(v) == len(part[0])]
                out.append(np.mean(part, axis=0).astype("float32").tolist())
            yield pd.DataFrame({key: f[key], "embedding": out})

    return todo.mapInPandas(run, kinds), None
