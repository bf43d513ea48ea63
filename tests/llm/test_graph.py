import random

from conftest import rows
from pyspark.sql import functions as F

from chronoweave.llm.subjects import ALIKE, similar_passages, subject_areas


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    sets = {frozenset(rng.sample("abcdefghijkl", rng.randrange(1, 6))) for _ in range(120)}
    passages = [(str(i), sorted(s)) for i, s in enumerate(sorted(sets, key=sorted))]
    want = {(p, q) for p, x in passages for q, y in passages if p != q and len(set(x) & set(y)) >= ALIKE * len(set(x) | set(y))}
    got = similar_passages(spark.createDataFrame(passages, "p string, t array<string>"))
    assert {(p, q) for p, q, _ in rows(got)} == want and len(want) > 100 and got.count() == len(want)


def test_trusted_seeds_keep_their_labels_and_denied_ones_lose_them(spark):
    sport, law = "the goal and the striker met", "the court and the verdict met"
    docs = [(i, ". ".join([sport if i % 2 else law] * 4)) for i in range(40)] + [(50, f"{sport}. {law}"), (51, "nothing here"), (52, f"{law}. {sport}. {sport}")]
    labels = [(i, "sport" if i % 2 else "law") for i in range(16)] + [(16, "sport"), (50, "sport"), (50, "law")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    s = spark.createDataFrame([("sport",), ("law",)], "subject string")
    got = dict(tuple(r) for r in subject_areas(d, l, s).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("subject")), " ")).collect())
    assert {i: got[i] for i in range(40)} == {i: "sport" if i % 2 else "law" for i in range(40)}
    assert 51 not in got and got[52] == "sport"
