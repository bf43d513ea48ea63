"""Encoding with a public byte-level tokenizer: longest matches and adjacent-token compatibility."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import ship, spread

#: Folder of the vocabulary files; a parameter of the queries.
VOCABULARIES = "/opt/tokenizers"
#: Pieces and token pairs a worker remembers before it starts anew, and the longest piece kept.
PIECES, PAIRS, PIECE_LENGTH = 400_000, 1_000_000, 40
# Fixed value: the published pattern that cuts text into pieces. White space is the Unicode
# property, which the information separators 1c to 1f don't have.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Encoder:
    """Byte-level merges by rank, reproduced without merging.

    A sequence of tokens is what the merges give exactly if every two neighbours are what the
    merges give for their joint bytes. So tokens are taken left to right, the longest match first;
    a token that isn't compatible with the one before makes way for the next shorter one, and if
    none is left the token before is given up. A position given up once is never tried again,
    which keeps the time linear.
    """

    def __init__(self, ranks: bytes):
        self.rank: dict[str, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, number = line.split()
                self.rank[base64.b64decode(token).decode("latin-1")] = int(number)
        self.text = {n: t for t, n in self.rank.items()}
        self.trie = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.trie.add_word(token, (len(token), number))
        self.trie.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.pieces = Pieces(self.piece)
        self.split = regex.compile(PATTERN).findall

    def merged(self, s: str) -> list[int]:
        """The merges themselves, lowest rank first; used on pairs of tokens only."""
        parts = list(s)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of ``token``, -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            s = self.text[token]
            found = self.shorter[token] = next((self.rank[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.rank), -1)
        return found

    def piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece of text."""
        s = piece.encode().decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None and self.merged_is_whole(s, whole):
            return (whole,)
        n = len(s)
        longest = [-1] * n
        reach = [0] * n
        for end, (length, number) in self.trie.iter(s):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, number
        out: list[int] = []
        free = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + len(self.text[token])
            if free[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = self.next_shorter(token)
            while token < 0:
                # nothing fits at this position: give it up and try a shorter token before it
                free[at] = 0
                before = out.pop()
                at -= len(self.text[before])
                token = self.next_shorter(before)

    def merged_is_whole(self, s: str, token: int) -> bool:
        """A token's own bytes always merge to it in these vocabularies; checked once per token."""
        key = (token, -1)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(s) == [token]
        return known

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


class Pieces(dict):
    """Ids of the pieces seen, found by the encoder where they are missing."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.find(piece)
        if len(piece) <= PIECE_LENGTH:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """One encoder per vocabulary and worker process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, doc_id: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): token ids of every text without special tokens, [] for null and empty texts.

    Whole texts are encoded, whatever their length; rows keep their number, repeated ids included.
    The vocabulary file (under 1 MB, a fixed size) is read by the driver and broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            # texts of a batch may be long: rows go out in parts of bounded size
            texts, ids = batch.column("text"), batch.column("doc_id")
            lo, out, size = 0, [], 0
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                row = enc.encode(t) if t else []
                out.append(np.array(row, np.int32))
                size += len(row)
                if size >= 1_000_000 or i == batch.num_rows - 1:
                    offsets = np.r_[0, np.cumsum([len(r) for r in out])].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), lists], names=["doc_id", "ids"])
                    lo, out, size = i + 1, [], 0

    rows = spread(df).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, ids array<int>").withColumnRenamed("doc_id", doc_id)
