"""Evaluation texts in training texts: a suffix automaton of the items, streamed over every document."""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.runtime import ship, spread

#: Least words of a passage, words per allowed edit, and least exact words in a row any passage has.
PASSAGE, PER_EDIT, SEED = 16, 9, 6
#: Characters of item text in one automaton (about 75 MB in each worker); larger sets are worked off in blocks.
BLOCK_CHARS = 1_000_000
#: Matched words in a row that are cut out of a text, and share of matched words beyond which it is dropped.
LONGEST, COVERAGE = PASSAGE, 0.5
#: Words of the sequences texts are narrowed down by, and how many of them the shortest, most edited
#: passage keeps (18 words with two edits: 18 - 4 + 1 - 2 * 4).
GRAM, LEAST = 4, 7
#: Pairs of equal sequences of texts and items that are counted at a time.
PAIRS = 2_000_000
FOREVER = 1 << 40
#: Lists of places an automaton remembers at a time.
REMEMBERED = 20_000

_TAG = re.compile(r"<[^<>\s][^<>]*>|\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")


_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]+")


def plain(text: str) -> str:
    """One form of letters, without entities, tags, link targets and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    return text.lower()


def own_wording(texts: list[str]) -> list[str]:
    """Item texts without their first paragraph where several items share it."""
    heads = [re.split(r"\r?\n[ \t]*\r?\n", t.strip(), maxsplit=1) for t in texts]
    shared = Counter(h[0].strip() for h in heads if len(h) > 1)
    return [h[1] if len(h) > 1 and shared[h[0].strip()] > 1 else t for h, t in zip(heads, texts)]


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """Cuts sentence [a, b) into one part more than it may have edits, so that one of them is exact."""
    parts = (b - a) // PER_EDIT + 1
    cuts = [a + (b - a) * j // parts for j in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def exact_run(n: int) -> int:
    """Exact words in a row that a sentence of n words has at least, with its edits."""
    return -(-(n - n // PER_EDIT) // (n // PER_EDIT + 1))


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(words) - n + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Automaton:
    """Generalised suffix automaton of the items' word sequences."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        bodies = [plain(t) for _, t in items]
        self.words: dict[str, int] = {}
        self.sequences = [[self.words.setdefault(w, len(self.words)) for w in _WORD.findall(b)] for b in bodies]
        self.sentences = []
        for b in bodies:
            spans, at = [], 0
            for s in _SENTENCE.split(b):
                n = len(_WORD.findall(s))
                if n:
                    spans.append((at, at + n))
                at += n
            self.sentences.append(spans)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(self.sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((k, i))
        self.children: list[list[int]] = [[] for _ in self.next]
        for v, up in enumerate(self.link):
            if up >= 0:
                self.children[up].append(v)
        self.count = [len(e) for e in self.ends]  # occurrences of a state's sequence
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]
        self.seen: dict[int, list[tuple[int, int]]] = {}
        # items whose sentences may all lack SEED exact words when they stand in another order: found by
        # the pieces of their longest sentence, one of which is exact
        self.weak: dict[int, list[tuple[list[int], int, int]]] = {}
        for k, spans in enumerate(self.sentences):
            if len(spans) > 1 and max(exact_run(b - a) for a, b in spans) < SEED:
                a, b = max(spans, key=lambda s: (exact_run(s[1] - s[0]), s))
                for x, y in pieces(a, b):
                    gram = self.sequences[k][x:y]
                    self.weak.setdefault(gram[0], []).append((gram, k, y))
        # a sentence of n words with e edits keeps n - GRAM + 1 - GRAM * e of its GRAM-word sequences
        self.need = np.array([sum(max(0, b - a - GRAM + 1 - GRAM * ((b - a) // PER_EDIT)) for a, b in spans) if len(spans) > 1 else FOREVER for spans in self.sentences], np.int64)
        grams: dict[int, set[tuple]] = {}
        for own in self.weak.values():
            for gram, k, _ in own:
                if not self.need[k]:
                    grams.setdefault(len(gram), set()).add(tuple(gram))
        self.tiny = {n: np.unique(rolled(np.array(sorted(g), np.int64).reshape(-1), n)[::n]) for n, g in grams.items()}
        sizes = np.array([max(0, len(seq) - GRAM + 1) for seq in self.sequences], np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *[rolled(np.array(seq, np.int64), GRAM) for seq in self.sequences]])
        order = np.argsort(hashes, kind="stable")
        self.gram_item = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.gram_at = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.gram_hash, first = np.unique(hashes[order], return_index=True)
        self.gram_from = np.r_[first, len(hashes)]

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> dict[int, set[int] | None]:
        """Items each text may hold a passage of; ``words`` of all texts in a row, each text from ``starts``.

        A passage of fewer than twice PASSAGE words keeps at least LEAST of its GRAM-word sequences
        within a few diagonals of text and item, and all sentences of an item keep ``need`` of
        them. Texts with very many common sequences are not narrowed down (None).
        """
        sizes = np.diff(np.r_[starts, len(words)])
        text = np.repeat(np.arange(len(starts)), sizes)
        out: dict[int, set[int] | None] = {}

        def known(n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h = rolled(words, n)
            if not len(h) or not len(table):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            p = np.flatnonzero((table[at] == h) & (text[: len(h)] == text[n - 1 :]))
            return p, at[p]

        for n, table in self.tiny.items():
            for t in np.unique(text[known(n, table)[0]]).tolist():
                out.setdefault(t, set()).update(k for own in self.weak.values() for _, k, _ in own)
        p, at = known(GRAM, self.gram_hash)
        many = self.gram_from[at + 1] - self.gram_from[at]
        per_text = np.bincount(text[p], many, len(starts))
        for t in np.flatnonzero(per_text > PAIRS).tolist():
            out[t] = None
        kept = per_text[text[p]] <= PAIRS
        p, at, many = p[kept], at[kept], many[kept]
        done = np.cumsum(many)
        lo = 0
        while lo < len(p):  # whole texts, about PAIRS pairs at a time
            base = done[lo] - many[lo]
            hi = int(np.searchsorted(done, base + PAIRS, side="right"))
            hi = len(p) if hi >= len(p) else max(lo + 1, int(np.searchsorted(text[p], text[p[hi]], side="left")))
            if hi <= lo:
                hi = int(np.searchsorted(text[p], text[p[lo]], side="right"))
            self._count(p[lo:hi], at[lo:hi], many[lo:hi], text, starts, out)
            lo = hi
        return out

    def _count(self, p: np.ndarray, at: np.ndarray, many: np.ndarray, text: np.ndarray, starts: np.ndarray, out: dict) -> None:
        place = np.repeat(p, many)
        flat = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.gram_from[at], many)
        k, i, t = self.gram_item[flat], self.gram_at[flat], text[place]
        pair = t * len(self.ids) + k
        # two neighbouring strips of 8 diagonals hold any passage
        strip, n = np.unique((pair << 32) + ((place - starts[t] - i + (1 << 30)) >> 3), return_counts=True)
        n = n.copy()
        follows = np.flatnonzero(strip[1:] == strip[:-1] + 1)
        n[follows] += np.diff(np.r_[0, np.cumsum(n)])[follows + 1]
        near = strip[n >= LEAST] >> 32
        whole, n = np.unique(np.unique((pair << 32) + i) >> 32, return_counts=True)
        enough = self.need[whole % len(self.ids)]
        whole = whole[(n >= enough) & (enough > 0)]
        for x in np.unique(np.r_[near, whole]).tolist():
            out.setdefault(x // len(self.ids), set()).add(x % len(self.ids))

    def ids_of(self, text: str) -> list[int]:
        """The text's words by their number, -1 for words no item has."""
        words = self.words
        return [words.get(w, -1) for w in _WORD.findall(plain(text))]

    def batch(self, texts: list[str]) -> Iterator[tuple[int, list[int], set[int] | None]]:
        """(position, words, items) of the texts that may hold a passage."""
        docs = [self.ids_of(t) for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        words = np.fromiter((w for d in docs for w in d), np.int64, int(sizes.sum()))
        for n, items in sorted(self.candidates(words, np.cumsum(sizes) - sizes).items() if len(docs) else ()):
            yield n, docs[n], items

    def matched(self, doc: list[int]) -> np.ndarray:
        """For each word the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        out, v, n = np.zeros(len(doc), np.int64), 0, 0
        for p, c in enumerate(doc):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            v, n = (0, 0) if to is None else (to, n + 1)
            out[p] = n
        return out

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _fork(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._fork(last, q, c)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._fork(p, q, c)
        return cur

    def places(self, state: int) -> list[tuple[int, int]]:
        """(item, index of the last word) of every occurrence of the state's sequence."""
        found = self.seen.get(state)
        if found is None:
            found, todo = [], [state]
            while todo:
                v = todo.pop()
                found += self.ends[v]
                todo += self.children[v]
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[state] = found
        return found

    def seeds(self, doc: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches of at least SEED words that don't go on at every occurrence.

        Besides the longest match also those of its end that more items hold, so that the longest
        match of each single item is among them.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v = n = 0
        for p, c in enumerate([*doc, -1]):
            w, m = v, n
            while m >= SEED:
                to = nxt[w].get(c)
                if to is None or count[to] < count[w]:
                    yield p, m, w
                w = link[w]
                m = length[w]
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(c)
            if to is None:
                v = n = 0
            else:
                v = to
                n += 1

    def leaked(self, text: str) -> list[int]:
        """Ids of the items of whose wording the text holds a passage."""
        return self.leaked_words(self.ids_of(text))

    def leaked_words(self, doc: list[int], items: set[int] | None = None) -> list[int]:
        """The same for a text's words, among ``items``."""
        found: set[int] = set()
        tried: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, state in self.seeds(doc):
            for k, last in self.places(state):
                if (items is not None and k not in items) or k in found or self._goes_on(doc, end, n, k, last + 1):
                    continue
                if n >= PASSAGE or self._passage(doc, end - n, end, k, last + 1 - n, last + 1):
                    found.add(k)
                else:
                    tried.setdefault(k, []).append((end, n, last + 1))
        if self.weak:
            for p, c in enumerate(doc):
                for gram, k, end in self.weak.get(c, ()):
                    if doc[p : p + len(gram)] == gram and (items is None or k in items):
                        tried.setdefault(k, []).append((p + len(gram), len(gram), end))
        at: dict[int, list[int]] = {}
        for k, seeds in tried.items():
            if k in found or len(self.sentences[k]) < 2:
                continue
            if not at:
                for d, c in enumerate(doc):
                    at.setdefault(c, []).append(d)
            if all(any(i - n < b and a < i and self._sentence(doc, d - n, d, k, i - n, i, a, b) for d, n, i in seeds) or self._looked_up(doc, at, k, a, b) for a, b in self.sentences[k]):
                found.add(k)
        return sorted(self.ids[k] for k in found)

    def _goes_on(self, doc: list[int], end: int, n: int, k: int, i: int) -> bool:
        """Whether the match is part of a longer one with the same item."""
        seq = self.sequences[k]
        return (end < len(doc) and i < len(seq) and doc[end] == seq[i]) or (end > n and i > n and doc[end - n - 1] == seq[i - n - 1])

    def _passage(self, doc: list[int], d0: int, d1: int, k: int, i0: int, i1: int) -> bool:
        # a passage of twice PASSAGE words has a half that is one itself, so longer ones need no search
        seq, most = self.sequences[k], (2 * PASSAGE - 1) // PER_EDIT
        n = i1 - i0
        right = reach(doc, d1, len(doc), 1, seq, i1, len(seq), most)
        left = reach(doc, d0 - 1, -1, -1, seq, i0 - 1, -1, most)
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                if n + x + y >= PASSAGE and (a + b) * PER_EDIT <= n + x + y:
                    return True
        return False

    def _sentence(self, doc: list[int], d0: int, d1: int, k: int, i0: int, i1: int, a: int, b: int) -> bool:
        """All of sentence [a, b) of the item is there, but for one word in nine."""
        seq = self.sequences[k]
        most = (b - a) // PER_EDIT
        if i0 < a:
            d0, i0 = d0 + a - i0, a
        if i1 > b:
            d1, i1 = d1 - (i1 - b), b
        right = reach(doc, d1, len(doc), 1, seq, i1, b, most)
        left = reach(doc, d0 - 1, -1, -1, seq, i0 - 1, a - 1, most)
        n = i1 - i0
        return any(n + x + y + (most - e - f) >= b - a for e, x in enumerate(left) for f, y in enumerate(right) if e + f <= most)

    def _looked_up(self, doc: list[int], at: dict[int, list[int]], k: int, a: int, b: int) -> bool:
        """The same for a sentence without a seed. Of one part more than it may have edits, one is exact."""
        seq = self.sequences[k]
        for x, y in pieces(a, b):
            for d in at.get(seq[x], ()):
                if doc[d : d + y - x] == seq[x:y] and self._sentence(doc, d, d + y - x, k, x, y, a, b):
                    return True
        return False


def reach(doc: list[int], d: int, d_end: int, step: int, seq: list[int], i: int, i_end: int, most: int) -> list[int]:
    """Words of the item passed from (d, i) in direction ``step`` with 0, 1, .. ``most`` edits, ending on a match.

    Furthest-reaching points per diagonal: an edit moves on by a changed, an added or a left-out word.
    """
    best, far = [0], {0: 0}  # diagonal (document minus item words): item words passed
    total_i, total_d = (i_end - i) * step, (d_end - d) * step
    for e in range(most + 1):
        ended, moved = best[-1], {}
        for diag, x in far.items():
            y = x
            while x < total_i and x + diag < total_d and seq[i + x * step] == doc[d + (x + diag) * step]:
                x += 1
            moved[diag] = x
            if x > y or e == 0:
                ended = max(ended, x)
        if e:
            best.append(ended)
        else:
            best[0] = ended
        far = {}
        for diag, x in moved.items():
            for to, y in ((diag, x + 1), (diag + 1, x), (diag - 1, x + 1)):
                if y <= total_i and 0 <= y + to <= total_d and far.get(to, -1) < y:
                    far[to] = y
        if not far:
            break
    return best


_BUILT: dict[str, Automaton] = {}


def automaton(packed: bytes) -> Automaton:
    """One automaton per block of items and worker process."""
    key = hashlib.sha256(packed).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(pickle.loads(packed))
    return _BUILT[key]


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[bytes]:
    """Packed blocks of (item, own wording), at least one."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    heads = rows.select("i", F.split(F.trim("t"), r"\r?\n[ \t]*\r?\n", 2).alias("h"), "t")
    shared = heads.where("size(h) > 1").groupBy(F.trim(F.col("h")[0]).alias("head")).agg(F.countDistinct("i").alias("n")).where("n > 1")
    bodies = heads.withColumn("head", F.when(F.size("h") > 1, F.trim(F.col("h")[0]))).join(shared, "head", "left").select("i", F.when(F.col("n").isNotNull(), F.col("h")[1]).otherwise(F.col("t")).alias("t")).orderBy("i", "t")
    block, size, given = [], 0, False
    for row in bodies.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= block_chars:
            yield pickle.dumps(block)
            block, size, given = [], 0, True
    if block or not given:
        yield pickle.dumps(block)


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of an item's own wording.

    A passage is PASSAGE or more words of the item in a row of which at most one in PER_EDIT is
    changed, added or left out, or all sentences of the item (two or more) in any order, each
    within that measure. Case, punctuation, markup, layout and Unicode forms don't matter. A first
    paragraph that several items share is an instruction and no own wording. Every passage has
    SEED exact words in a row, or, where no sentence of an item is sure to have as many, one of
    the pieces of its surest sentence. The items a text may hold are told by counts of common
    sequences of GRAM words along the diagonals; for those each longest match is extended both ways.

    The items are the small, held-out side: they come to the driver in blocks of ``block_chars``
    characters, each block is broadcast and takes one pass over the documents. Null and empty
    texts hold nothing; repeated rows count once.
    """
    spark = docs.sparkSession
    ship(spark)
    pages = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0))
    item_kind = to_arrow_type(items.schema[item_id].dataType)
    kinds = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}"

    def search(block: bytes) -> DataFrame:
        packed = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = automaton(packed.value)
            for batch in batches:
                at, hits = [], []
                for n, words, may in auto.batch(batch.column("text").to_pylist()):
                    for item in auto.leaked_words(words, may):
                        at.append(n)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(hits, item_kind)], names=["doc_id", "item_id"])

        return pages.mapInArrow(run, kinds)

    out = None
    for block in _blocks(items, item_id, item_text, block_chars):
        found = search(block)
        out = found if out is None else out.unionByName(found)
    return out.distinct().toDF(doc_id, item_id)


_RUN = regex.compile(r"(<[^<>\s][^<>]*>|\]\([^()\s]*\))|&[#\w]+;|[\p{L}\p{N}\p{M}\p{Cf}\p{So}]+")


def spans(text: str) -> list[tuple[str, int, int]]:
    """Words of a text in the items' form, with the place each has in the text as it stands."""
    out = []
    for m in _RUN.finditer(text):
        if m[1] is None:
            out += [(w, m.start(), m.end()) for w in _WORD.findall(plain(m[0]))]
    return out


def removal(longest: int, coverage: float) -> Callable[[Automaton, str], tuple[str | None, int]]:
    """Cuts what one block of items matches out of a text: (text or None if dropped, words matched)."""

    def cut(auto: Automaton, text: str) -> tuple[str | None, int]:
        runs = auto.matched(auto.ids_of(text))
        if not len(runs) or runs.max() < min(SEED, longest):
            return text, 0
        words = spans(text)
        runs = auto.matched([auto.words.get(w, -1) for w, _, _ in words])
        hit, near = np.zeros(len(words), bool), np.zeros(len(words), bool)
        for p in np.flatnonzero(runs >= min(SEED, longest)).tolist():
            near[p - runs[p] + 1 : p + 1] = True
            if runs[p] >= longest:
                hit[p - runs[p] + 1 : p + 1] = True
        if near.sum() > coverage * max(1, len(words)):
            return None, int(near.sum())
        out, at = [], 0
        for p in np.flatnonzero(hit).tolist():
            if words[p][1] >= at:
                joined = p and hit[p - 1]
                out.append("" if joined else text[at : words[p][1]])
            at = max(at, words[p][2])
        return "".join([*out, text[at:]]), int(hit.sum())

    return cut


def without_leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", longest: int = LONGEST, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, text, removed, dropped): every document without the items' own wording.

    Runs of ``longest`` or more words in a row that an item has are cut out of the text as it
    stands, and counted in ``removed``; a text more than ``coverage`` of whose words lie in runs of
    SEED or more is dropped (``text`` null). Markup and case don't matter to the match and stay
    where nothing is cut. Blocks of items are worked off one after the other. Null and empty texts
    and texts without such runs come out as they are; repeated rows stay.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = removal(longest, coverage)
    kind = f"doc_id {dict(docs.dtypes)[doc_id]}, text string, removed long, dropped boolean"
    out = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "text", F.lit(0).cast("long").alias("removed"), F.lit(False).alias("dropped"))
    for block in _blocks(items, item_id, item_text, block_chars):
        packed = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            auto = automaton(packed.value)
            for batch in batches:
                texts, removed, dropped = (batch.column(c).to_pylist() for c in ("text", "removed", "dropped"))
                for n in range(batch.num_rows):
                    if texts[n]:
                        texts[n], more = cut(auto, texts[n])
                        removed[n], dropped[n] = removed[n] + more, texts[n] is None
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(dropped, pa.bool_())], names=["doc_id", "text", "removed", "dropped"])

        out = out.mapInArrow(run, kind)
    return out.toDF(doc_id, text, "removed", "dropped")
