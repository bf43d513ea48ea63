import os
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.llm.near_dup import indexed_pairs, near_pairs, words


def share(a, b, n=3):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed=1, families=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(dict.fromkeys(out))]


@pytest.mark.parametrize("hot", [500, 2])
def test_pairs_equal_brute_force(spark, hot):
    texts = corpus() + [(1000, "only two"), (1001, "")]
    got = {(min(a, b), max(a, b)) for a, b, _ in rows(near_pairs(spark.createDataFrame(texts, "cid long, w string"), hot_key=hot))}
    want = {(a, b) for a, x in texts for b, y in texts if a < b and share(x, y) >= 0.5}
    assert got <= want and len(want) > 20
    assert len(got) >= (1.0 if hot == 500 else 0.97) * len(want)


def test_texts_in_hot_keys_lose_no_pair(spark):
    base = "the same long notice goes out to every reader of the house each morning".split()
    family = [" ".join(base[:i] + [f"x{i}", f"y{j}"] + base[i + 1 :]) for i in range(len(base)) for j in range(3)]
    texts = list(enumerate(family)) + [(i + 100, t) for i, t in corpus(3, 8)]
    got = {(a, b) for a, b, _ in rows(near_pairs(spark.createDataFrame(texts, "cid long, w string"), hot_key=1))}
    assert got == {(a, b) for a, x in texts for b, y in texts if a < b and share(x, y) >= 0.5} and len(got) > 100


def test_index_tells_off_texts_with_too_little_in_common(spark):
    rng = random.Random(5)
    parts = [" ".join(f"p{k}w{i}" for i in range(9)) for k in range(12)]
    texts = [" ".join([*rng.sample(parts, 4), *(f"own{n}x{i}" for i in range(12))]) for n in range(120)]
    texts = list(enumerate(texts + [t.replace("x11", "y11") for t in texts[:20]]))
    found = [tuple(r) for r in indexed_pairs(spark.createDataFrame(texts, "cid long, w string"), 3, 0.5).collect()]
    want = {(a, b) for a, x in texts for b, y in texts if a < b and share(x, y) >= 0.5}
    assert len(found) == len(set(found)) and want <= set(found)
    assert len(found) <= 3 * len(want)  # of 9730 pairs, most of which share a passage


def test_shuffles_of_written_tables_take_no_disk(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def held():
        return {f: os.path.getsize(os.path.join(at, f)) for d in dirs for at, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    texts = spark.createDataFrame(corpus(3, 8), "cid long, w string")
    before, set_to = held(), spark.conf.get(setting, None)
    pairs = near_pairs(texts, hot_key=1)
    for _ in range(50):  # they are deleted in the background
        after = held()
        left = sum(after[f] for f in after.keys() - before.keys())
        if left < 2000:  # counts of rows
            break
        time.sleep(0.2)
    assert left < 2000
    assert spark.conf.get(setting, None) == set_to and pairs.count() > 0


def test_words(spark):
    df = spark.createDataFrame([("It's  A_b", "Über-42"), (None, "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(words(F.col("a"), F.col("b"))).collect()] == ["it s a b über 42", "x", ""]


def test_no_texts(spark):
    assert rows(near_pairs(spark.createDataFrame([], "cid long, w string"))) == []


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((find(x), x) for x in up)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)]
    star = [("hub", f"s{i:02d}") for i in range(60)]
    noise = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)]
    pairs = chain + star + noise + noise[:20] + [(b, a) for a, b in noise[:20]] + [("x", None), (None, "y"), ("z", "z")]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(*p, "l") for p in pairs], "a string, b string, label string")
    assert rows(components(df, "a", "b")) == union_find(pairs)
    assert rows(components(df.limit(0), "a", "b")) == []


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    from chronoweave.runtime import Rounds

    written, cut = [], Rounds.cut
    monkeypatch.setattr(Rounds, "cut", lambda self, df, keep=False: written.append(1) or cut(self, df, keep))
    n = 4000
    df = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(n)], "a string, b string")
    got = components(df, "a", "b")
    assert got.where("group_id = '00000'").count() == n + 1 and got.count() == n + 1
    assert len(written) <= 15
