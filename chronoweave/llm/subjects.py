"""Subject areas of documents: labels propagated over a verified graph of similar passages and their documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.runtime import BROADCAST_BYTES, Rounds, broadcast_if_small, measured_bytes, ship, spread

#: Least seed documents of a telling word, and its least information (part of the most there can be).
WORD_DOCS, INFORMATION = 2, 0.3
#: Least share of telling words two linked passages have in common.
ALIKE = 0.5
#: What a share is worth one link further on, and the least change that keeps the rounds going. A
#: change at most halves from round to round, so rounds end by themselves.
DAMPING, CHANGE = 0.5, 0.02
#: Least lead of a passage's first subject over its second, and sentences that make a subject one of several.
LEAD, SEVERAL = 0.25, 3
# Fixed value: letters with marks and what they are compared as.
MARKED, BASE = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"


_CAMEL, _MARKS = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})"), regex.compile(r"\p{M}+")
_PARTS = re.compile("(?<=[.!?])\\s+|[\r\n\u2028\u2029\x85]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_SIMPLE = str.maketrans(MARKED, BASE)


def sentence_words(text: str) -> list[set[str]]:
    """Distinct words of each sentence or line; joined names in code count by their parts."""
    plain = _CAMEL.sub(" ", text).lower()
    if not plain.isascii():
        plain = _MARKS.sub("", plain).translate(_SIMPLE)
    words = (set(_WORD.findall(s)) for s in _PARTS.split(plain))
    return [w for w in words if w]


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, s, word): the words of each sentence, by its number."""
    for batch in batches:
        at, number, out = [], [], []
        for n, text in enumerate(batch.column("text").to_pylist()):
            for s, words in enumerate(sentence_words(text)):
                at += [n] * len(words)
                number += [s] * len(words)
                out += words
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "s", "word"])


def passages(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, t, n): the sets of telling words of each document's sentences, sorted, and their number.

    The words of the hand-labelled documents are sent to the workers where their counted rows fit;
    beyond that they are joined.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if measured_bytes(table, 64) > BROADCAST_BYTES:
        words = docs.mapInArrow(_all_words, f"doc_id {kind}, s int, word string").join(table, "word")
        return words.groupBy("doc_id", "s").agg(F.array_sort(F.collect_list("word")).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in table.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = sent.value
        for batch in batches:
            at, sets, counts = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                held = Counter(tuple(sorted(t)) for w in sentence_words(text) if (t := w & telling))
                at += [n] * len(held)
                sets += held.keys()
                counts += held.values()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([list(t) for t in sets], pa.list_(pa.string())), pa.array(counts, pa.int64())], names=["doc_id", "t", "n"])

    return docs.mapInArrow(run, f"doc_id {kind}, t array<string>, n long")


def telling_words(words: DataFrame, seeds: DataFrame, subjects: list[str]) -> DataFrame:
    """(word) of (doc_id, word): those whose seed documents agree on few subjects.

    Shares are weighed by the subjects' sizes, so a large subject has no advantage. Words of passing
    remarks and names occur with every subject and drop out; what is left verifies the links.
    """
    k = len(subjects)
    sums = [F.sum(F.when(F.col("subject") == s, F.col("share")).otherwise(0.0)) for s in subjects]
    t = [x or 0.0 for x in seeds.agg(*[c.alias(f"t{i}") for i, c in enumerate(sums)]).first()]
    mean = sum(t) / max(1, sum(x > 0 for x in t))
    seen = words.join(seeds, "doc_id").groupBy("word").agg(F.sum("share").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(sums)]).where(F.col("n") >= WORD_DOCS - 1e-9)
    rates = [F.col(f"c{i}") / F.lit(t[i] + 0.1 * mean or 1.0) for i in range(k)]
    whole = reduce(lambda a, b: a + b, rates)
    shares = [(F.col("n") * r / whole + 1.0 / k) / (F.col("n") + 1.0) for r in rates]
    information = reduce(lambda a, b: a + b, [q * F.log(q * k) for q in shares])
    return seen.where(information >= INFORMATION * math.log(k)).select("word")


def similar_passages(passages: DataFrame, least: float = ALIKE) -> DataFrame:
    """(p, q, alike) both ways: classes of passages (p, t: distinct words) with a share of ``least`` of their words in common.

    Words are ordered from the rarest to the commonest. A pair that is alike shares its first word
    within the first n - ceil(least * n) + 1 of either side, so only those are joined on, and the
    pair is kept at its first shared word alone: the commonest words bring no pairs together.
    """
    often = passages.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("often"))
    each = passages.select("p", F.explode("t").alias("w")).join(broadcast_if_small(often, 64), "w")
    sets = each.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "w"))), lambda x: x["w"]).alias("t"))
    size = F.size("t")
    first = sets.select("p", "t", F.explode(F.slice("t", F.lit(1), size - F.ceil(size * least).cast("int") + 1)).alias("w"))
    a, b = first.select("w", "p", F.col("t").alias("x")), first.select("w", F.col("p").alias("q"), F.col("t").alias("y"))
    both = F.array_intersect("x", "y")
    shared = F.size(both)
    pairs = a.join(b, "w").where("p < q").where(both[0] == F.col("w")).select("p", "q", (shared / (F.size("x") + F.size("y") - shared)).alias("alike")).where(F.col("alike") >= least)
    return pairs.unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"), "alike"))


def propagate(run: Rounds, links: DataFrame, seeds: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(p, subject, f): how much of each passage is about each subject, 1 for a clamped one.

    ``links`` has (p, q, alike); ``seeds`` (p, held, n): n sentences of passage p in seed documents
    of the subjects ``held``. Each round a passage takes its clamped seed sentences, dealt among the
    subjects their documents hold by what the passage is about so far, and DAMPING times the shares
    of the passages linked to it, so that shares fade with the distance to a seed. Rounds end when
    no share moves by CHANGE. ``state`` is an earlier result to start from.
    """
    weight = links.groupBy("p").agg(F.sum("alike").alias("w")).unionByName(seeds.groupBy("p").agg(F.sum("n").cast("double").alias("w")))
    weight = run.cut(weight.groupBy("p").agg(F.sum("w").alias("w")))
    weight = broadcast_if_small(weight, 64)
    if state is None:
        start = seeds.select("p", "n", F.size("held").alias("k"), F.explode("held").alias("subject")).groupBy("p", "subject").agg(F.sum(F.col("n") / F.col("k")).alias("s"))
        state, seen = run.counted(start.join(weight, "p").select("p", "subject", (F.col("s") / F.col("w")).alias("f")))
    else:
        seen = {"rows": state.count()}
    while True:
        now = F.broadcast(state) if seen["rows"] * 64 <= BROADCAST_BYTES else state
        held = seeds.select("p", "held", "n", F.explode("held").alias("subject")).join(now, ["p", "subject"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)) + 1e-3)
        own = held.select("p", "subject", (F.col("n") * F.col("f") / F.sum("f").over(_within("p", "held"))).alias("s"))
        near = links.join(now.withColumnRenamed("p", "q"), "q").select("p", "subject", (DAMPING * F.col("alike") * F.col("f")).alias("s"))
        was = state.select("p", "subject", F.lit(0.0).alias("s"), F.col("f").alias("g"))
        sums = own.unionByName(near).withColumn("g", F.lit(0.0)).unionByName(was).groupBy("p", "subject").agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
        fresh, seen = run.counted(sums.join(weight, "p").select("p", "subject", (F.col("s") / F.col("w")).alias("f"), "g"), moved=F.abs(F.col("f") - F.col("g")) >= CHANGE)
        run.drop(state)
        state = fresh
        if not seen["moved"]:
            return state.select("p", "subject", "f")


def _within(*keys: str):
    """All rows of a key: at most one per subject."""
    return Window.partitionBy(*keys)


def _held(spoken: DataFrame, shares: DataFrame) -> DataFrame:
    """(doc_id, subjects) of (doc_id, p, n): those most of a document's sentences, or SEVERAL, are about."""
    top = shares.where("f > 0").groupBy("p").agg(F.sort_array(F.collect_list(F.struct("f", "subject")), asc=False).alias("r"), F.sum("f").alias("w"))  # at most one entry per subject
    lead = (F.col("r")[0]["f"] - F.coalesce(F.get("r", F.lit(1))["f"], F.lit(0.0))) / F.col("w")
    told = top.where(lead >= LEAD).select("p", F.col("r")[0]["subject"].alias("subject"))
    counts = spoken.join(broadcast_if_small(told, 64), "p").groupBy("doc_id", "subject").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(_within("doc_id"))
    return counts.withColumn("whole", whole).where((2 * F.col("n") > F.col("whole")) | (F.col("n") >= SEVERAL)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame, *, doc_id: str = "doc_id", text: str = "text", subject: str = "subject") -> DataFrame:
    """(doc_id, subject): the subjects most of a document's sentences, or at least SEVERAL, are about.

    Documents are linked by their passages. A passage is the set of telling words of a sentence, a
    class that all documents with such a sentence belong to; two classes are linked if at least
    ALIKE of their words are shared, which is verified on the sets themselves, and words count only
    where the seed documents they link agree. The graph is built once; hand labels are clamped
    seeds, and shares of subjects spread over it until they stand still. Seeds that their own text
    denies are not trusted: they are taken out and the rest is spread again. A document keeps
    several subjects; a trusted seed has its labels.

    Null, empty and blank texts, and texts of words that tell nothing, have no subject. Labels of
    unknown subjects or documents are void, repeated ones count once. Without labels no document
    has a subject. The list of subjects is a small fixed table and comes to the driver; the tables of
    words and passages are broadcast only if their measured size allows.
    """
    spark = docs.sparkSession
    ship(spark)
    run = Rounds(spark, "subjects")
    names = [r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().orderBy(subject).collect()]
    kept = docs.where(F.length(F.trim(text)) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    seeds = labels.select(F.col(doc_id).alias("doc_id"), F.col(subject).alias("subject")).where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).distinct()
    seeds = run.cut(seeds.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("held")))  # at most one entry per subject
    shares = seeds.select("doc_id", F.explode("held").alias("subject"), (1.0 / F.size("held")).alias("share"))
    own = kept.join(broadcast_if_small(seeds.select("doc_id"), 16), "doc_id", "left_semi")
    own = spread(own).mapInArrow(_all_words, f"doc_id {dict(kept.dtypes)['doc_id']}, s int, word string").select("doc_id", "word").distinct()
    table = run.cut(telling_words(own, shares, names))
    spoken = run.cut(passages(spread(kept), table).withColumn("p", F.md5(F.array_join("t", " "))))
    links = run.cut(similar_passages(run.cut(spoken.groupBy("p").agg(F.first("t").alias("t")))))
    clamped, told, state = seeds, None, None
    for _ in range(2):
        sown = run.cut(spoken.join(broadcast_if_small(clamped, 128), "doc_id").groupBy("p", "held").agg(F.sum("n").alias("n")))
        state = propagate(run, links, sown, state)
        told = run.cut(_held(spoken.select("doc_id", "p", "n"), state), keep=True)
        clamped = run.cut(seeds.join(told, "doc_id").where(F.col("held") == F.col("subjects")).select("doc_id", "held"), keep=True)
    rest = told.join(broadcast_if_small(clamped.select("doc_id"), 16), "doc_id", "left_anti")
    return clamped.withColumnRenamed("held", "subjects").unionByName(rest).select(F.col("doc_id").alias(doc_id), F.explode("subjects").alias(subject))
