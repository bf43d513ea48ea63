"""Near-duplicate records with small edits: segments of min-hash signatures with one wildcard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import Rounds, broadcast_if_small, ship, spread

#: Words of a sequence, least similarity, segments of a signature and values of a segment.
SEQUENCE, SIMILARITY, SEGMENTS, VALUES = 3, 0.5, 16, 4
#: Texts that share a key with more texts than this are paired by an exact index instead.
HOT_KEY = 500
#: A key that a batch of texts holds so often is counted along its task, so that no task sends many more rows than tell it is hot.
FREQUENT = 16
#: Seed of the hash functions.
SEED = 11
#: Values compared in the sketches, and the columns these travel in.
FIELDS, MARKS = 64, ("s0", "s1", "s2", "s3")
#: Columns of the parities of a text's sequences, 64 bits each.
PARITY = tuple(f"p{i}" for i in range(8))


def words(title: Column, text: Column) -> Column:
    """Lower-case runs of letters and digits of both, joined by blanks; '' for nulls."""
    return F.array_join(F.regexp_extract_all(F.lower(F.concat_ws(" ", title, text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sequence_hashes(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word sequences, text after text, and where each text starts; texts are long enough."""
    split = [t.split(" ") for t in texts]
    sizes = np.array([len(s) for s in split])
    codes, uniques = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    word = np.array([xxhash.xxh64_intdigest(u.encode()) for u in uniques], np.uint64)[codes]
    n = len(word) - length + 1
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = _mix(h + word[i : i + n] + np.uint64(i + 1))
    ends = np.cumsum(sizes)
    inside = np.ones(len(word), bool)
    for i in range(1, length):
        inside[ends - i] = False
    starts = np.r_[0, np.cumsum(sizes - length + 1)[:-1]]
    return h[inside[:n]], starts


def min_hashes(h: np.ndarray, starts: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(count, texts) least values of ``count`` hash functions over each text's sequences."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((count, len(starts)), np.uint64)
    for i in range(count):
        x = h * mult[i] + add[i]
        out[i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return out


def variant_keys(low: np.ndarray, segments: int, values: int) -> np.ndarray:
    """(segments * values, texts) keys: each segment once for each of its values left out.

    Two signatures whose segments differ in at most one value share the key with that value left out.
    """
    keys = []
    for s in range(segments):
        part = _mix(low[s * values : (s + 1) * values])
        for skip in range(values):
            k = np.full(low.shape[1], s * values + skip + 1, np.uint64)
            for j in range(values):
                if j != skip:
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + part[j])
            keys.append(k)
    return np.array(keys)


def sketch(low: np.ndarray) -> np.ndarray:
    """(4, texts): four bits of each of the first 64 values, 16 to a word, for a quick comparison."""
    bits = _mix(low[:FIELDS]) & np.uint64(15)
    shift = (np.arange(len(bits), dtype=np.uint64) % np.uint64(16)) * np.uint64(4)
    packed = bits << shift[:, None]
    return np.array([np.bitwise_or.reduce(packed[i : i + 16]) for i in range(0, FIELDS, 16)])


def _signatures(segments: int, values: int, length: int, seed: int, hot_key: int):
    """Rows (key, cid, marks) of each text, but no more than tell that a key is hot from one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                texts, ids = part.column("w").to_pylist(), part.column("cid").to_numpy(zero_copy_only=False)
                if not texts:
                    continue
                low = min_hashes(*sequence_hashes(texts, length), segments * values, seed)
                keys = variant_keys(low, segments, values)
                n = len(keys)
                # the rows of one text follow each other, which the shuffle's compression profits from
                flat, rows = keys.T.reshape(-1), np.repeat(np.arange(len(ids)), n)
                often, of, counts = np.unique(flat, return_inverse=True, return_counts=True)
                place = np.empty(len(flat), np.int64)  # of a row among those of its key
                place[np.argsort(of, kind="stable")] = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
                most = np.full(len(often), len(flat))
                for i in np.flatnonzero(counts >= min(FREQUENT, hot_key + 1)).tolist():
                    key = int(often[i])
                    before = sent.get(key, 0)
                    most[i] = hot_key + 1 - before
                    sent[key] = before + int(counts[i])
                keep = place < most[of]
                marks = sketch(low)
                flat, rows = flat[keep], rows[keep]
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids[rows]), *[pa.array(m[rows].view(np.int64)) for m in marks]], names=["key", "cid", *MARKS])

    return run


def _in_hot_keys(segments: int, values: int, length: int, seed: int):
    """(cid, key) of every key of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                texts, ids = part.column("w").to_pylist(), part.column("cid").to_numpy(zero_copy_only=False)
                if texts:
                    keys = variant_keys(min_hashes(*sequence_hashes(texts, length), segments * values, seed), segments, values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(keys))), pa.array(keys.T.reshape(-1).view(np.int64))], names=["cid", "key"])

    return run


def _hashed(length: int):
    """(cid, size, h): the distinct word sequences of each text, by hash, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("w").to_pylist()
            if not texts:
                continue
            h, starts = sequence_hashes(texts, length)
            own = [np.unique(x).view(np.int64) for x in np.split(h, starts[1:])]
            sizes = np.array([len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(zero_copy_only=False), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(own))], names=["cid", "size", "h"])

    return run


def _index(similarity: float):
    """(h, cid, size, alone, left, bits): of each text (cid, size, t) the sequences it is to be joined on.

    ``t`` holds the sequences that other texts have too, from the rarest on; ``alone`` counts the
    others, ``left`` the ones of t from h on; a bit is the parity of the sequences of t that fall on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "size"))
            held = batch.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column("t").flatten().to_numpy(zero_copy_only=False)
            starts, alone = np.cumsum(held) - held, size - held
            first = size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1 - alone
            code = h.view(np.uint64)
            word, bit = (code >> np.uint64(6)) % np.uint64(len(PARITY)), np.uint64(1) << (code & np.uint64(63))
            bits = [np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), starts).view(np.int64) for i in range(len(PARITY))]
            at = np.arange(len(h)) - np.repeat(starts, held)
            keep = np.flatnonzero(at < np.repeat(first, held))
            row = np.repeat(np.arange(len(held)), held)[keep]
            whole = [x.astype(np.int32) for x in (size[row], alone[row], held[row] - at[keep])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[keep], cid[row], *whole, *(x[row] for x in bits))], names=["h", "cid", "size", "alone", "left", *PARITY])

    return run


def indexed_pairs(texts: DataFrame, length: int, similarity: float) -> DataFrame:
    """(x, y): every pair of texts (cid, w) that may reach ``similarity``, by an index of their rarest sequences.

    A text of n sequences that shares the given part of all with another one shares at least
    s = ceil(similarity * n) of its own; in one order of all sequences, from the rarest to the
    commonest, the first shared one then lies within the first n - s + 1 of both. Only those are
    joined on, without the ones that no other text has. Two bounds, neither of which loses a pair,
    tell most of the others off before their texts are fetched: the sequences from the joined one
    on must be enough (they are at the first shared one), and so many bits of parity as differ,
    so many sequences at least do only one of the two texts have.
    """
    each = texts.mapInArrow(_hashed(length), "cid long, size int, h long")
    often = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"])  # the sequences of one text
    sets = each.join(often, "h").groupBy("cid", "size").agg(order.alias("t"))
    index = sets.mapInArrow(_index(similarity), "h long, cid long, size int, alone int, left int, " + ", ".join(f"{p} long" for p in PARITY))
    a = index.select("h", *[F.col(c).alias(f"x_{c}") for c in index.columns if c != "h"])
    b = index.select("h", *[F.col(c).alias(f"y_{c}") for c in index.columns if c != "h"])
    sizes = F.col("x_size") + F.col("y_size")
    differ = F.col("x_alone") + F.col("y_alone")
    for p in PARITY:
        differ = differ + F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}")))
    enough = (F.least("x_left", "y_left") * (1 + similarity) >= sizes * similarity - 1e-9) & (differ * (1 + similarity) <= sizes * (1 - similarity) + 1e-9)
    return a.join(b, "h").where("x_cid < y_cid").where(enough).select(F.col("x_cid").alias("x"), F.col("y_cid").alias("y")).distinct()


def paired(least: int, hot_key: int):
    """Pairs (x, y) of the rows of one key, over batches sorted by key, whose sketches agree in ``least`` fields.

    A key with more than ``hot_key`` rows gives the one row (null, key) instead. No more than a
    batch and ``hot_key`` rows are held at a time.
    """
    low = np.uint64(0x1111111111111111)

    def pairs(key: np.ndarray, cid: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[edge, len(key)])
        hot = sizes > hot_key
        keep = np.repeat((sizes > 1) & ~hot, sizes)
        hot_at, key, cid, marks = key[edge[hot]], key[keep], cid[keep], marks[:, keep]
        xs, ys, i, step = [], [], np.arange(len(key) - 1), 1
        while len(i):
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            j = i + step
            differ = np.zeros(len(i), np.int64)
            for m in marks:
                d = m[i] ^ m[j]
                d |= d >> np.uint64(1)
                d |= d >> np.uint64(2)
                differ += np.bitwise_count(d & low)
            ok = (differ <= FIELDS - least) & (cid[i] != cid[j])
            xs.append(np.minimum(cid[i[ok]], cid[j[ok]]))
            ys.append(np.maximum(cid[i[ok]], cid[j[ok]]))
            step += 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *xs]), np.concatenate([none, *ys]), hot_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x, y, hot):
            given = np.r_[np.zeros(len(x), bool), np.ones(len(hot), bool)]
            return pa.RecordBatch.from_arrays([pa.array(np.r_[x, hot], mask=given), pa.array(np.r_[y, hot])], names=["x", "y"])

        held = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cid", *MARKS)]
            if held is not None:
                part = [np.r_[h, p] for h, p in zip(held, part)]
            if not len(part[0]):
                continue
            # the last key goes on in the next batch; of a hot one no more rows are needed than tell so
            at = np.searchsorted(part[0], part[0][-1])
            held = [p[at:][: hot_key + 1] for p in part]
            if at:
                yield out(*pairs(part[0][:at], part[1][:at], np.array([p[:at] for p in part[2:]]).view(np.uint64)))
        if held is not None:
            yield out(*pairs(held[0], held[1], np.array(held[2:]).view(np.uint64)))

    return run


def _least_alike(similarity: float) -> int:
    """Fields that a pair of that similarity agrees in, less 3.4 standard deviations (1 in 3 000 falls short)."""
    p = similarity + (1 - similarity) / 16
    return int(FIELDS * p - 3.4 * (FIELDS * p * (1 - p)) ** 0.5)


def shares(length: int, similarity: float):
    """Exact share of common sequences of pairs (x, y, wx, wy); those under ``similarity`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequences(w: str) -> set:
            parts = w.split(" ")
            return set(zip(*[parts[i:] for i in range(length)]))

        for batch in batches:
            share = []
            for wx, wy in zip(batch.column("wx").to_pylist(), batch.column("wy").to_pylist()):
                a, b = sequences(wx), sequences(wy)
                n = len(a & b)
                share.append(n / (len(a) + len(b) - n))
            keep = np.array(share, float) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep)), pa.array(np.array(share, float)[keep])], names=["a", "b", "similarity"])

    return run


def near_pairs(texts: DataFrame, *, length: int = SEQUENCE, similarity: float = SIMILARITY, segments: int = SEGMENTS, values: int = VALUES, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b, similarity) over (cid, w): pairs of distinct word texts with enough word sequences in common.

    A text's signature has ``segments`` segments of ``values`` min-hash values. Each segment is
    indexed once per value left out; texts sharing such a key differ in at most one value of the
    segment. The keys are joined by equality, candidates pass a comparison of sketches carried
    with the keys (one pair in 3 000 at the least similarity falls short), and the exact share of
    common sequences decides. At a similarity of exactly 0.5 one pair in 400 shares no key, at 0.6
    one in 20 000. Keys with more than ``hot_key`` members aren't paired: the texts in them are
    paired by an index of their rarest sequences, which loses no pair; no task sends or holds many
    more rows of a hot key than tell that it is one.

    ``w`` holds words joined by one blank; texts with fewer words than a sequence pair with nothing.
    """
    spark = texts.sparkSession
    ship(spark)
    rounds = Rounds(spark, "near_dup", tidy=True)
    base = texts.where(F.size(F.split("w", " ")) >= length)
    source = spread(base.select("cid", "w"))
    signed = source.mapInArrow(_signatures(segments, values, length, SEED, hot_key), "key long, cid long, " + ", ".join(f"{m} long" for m in MARKS))
    met = signed.repartition("key").sortWithinPartitions("key").mapInArrow(paired(_least_alike(similarity), hot_key), "x long, y long").distinct()
    step = rounds.cut(met, keep=True)
    pairs = step.where("x IS NOT NULL")
    hot = step.where("x IS NULL").select(F.col("y").alias("key"))
    if not hot.isEmpty():
        keys = source.mapInArrow(_in_hot_keys(segments, values, length, SEED), "cid long, key long")
        members = keys.join(broadcast_if_small(hot, 16), "key", "left_semi").select("cid").distinct()
        inside = rounds.cut(base.join(members, "cid", "left_semi").select("cid", "w"), keep=True)
        pairs = rounds.cut(pairs.unionByName(indexed_pairs(inside, length, similarity)).distinct(), keep=True)
    needed = broadcast_if_small(pairs, 24)
    left = base.select(F.col("cid").alias("x"), F.col("w").alias("wx")).join(needed, "x")
    both = left.join(base.select(F.col("cid").alias("y"), F.col("w").alias("wy")), "y")
    return both.select("x", "y", "wx", "wy").mapInArrow(shares(length, similarity), "a long, b long, similarity double")
