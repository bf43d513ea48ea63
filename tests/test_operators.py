from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import evidence, graph, integrity, retrieval, rules, temporal
from chronoweave.operators.dedup import exact_groups, greedy_survivors
from chronoweave.sources.providers import backfill, chunks, hashing_embedder

SPAN = "id string, valid_from int, valid_to int"


def spans(spark, data):
    return spark.createDataFrame(data, SPAN)


def test_predicates_are_half_open(spark):
    df = spans(spark, [("a", 0, 5), ("b", 5, None), ("c", None, 5), ("d", 6, None), ("e", 5, 5)])
    assert rows(temporal.as_of(df, F.lit(5)), "id") == [("b",)]
    assert rows(temporal.overlapping(df, F.lit(5), F.lit(5)), "id") == [("a",), ("b",), ("e",)]
    assert rows(temporal.diff_in_range(df, F.lit(5), F.lit(6)), "id", "change") == [("a", "removed"), ("b", "added"), ("c", "removed"), ("e", "added"), ("e", "removed")]


def test_state_changes(spark):
    df = spans(spark, [("a", 0, None), ("a", 1, 3), ("b", 0, None)])
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert rows(temporal.close(df, keys, ["id"], F.lit(9))) == [("a", 0, 9), ("a", 1, 3), ("b", 0, None)]
    assert rows(temporal.close(df, keys, ["id"], F.lit(9), open_only=False)) == [("a", 0, 9), ("a", 1, 9), ("b", 0, None)]
    assert len(rows(temporal.append_absent(df, spans(spark, [("b", 7, 7), ("c", 7, 7), ("c", 7, 7)]), ["id"]))) == 4
    assert rows(temporal.patch(spans(spark, [("a", 1, 2)]), spans(spark, [("a", None, 8)]), ["id"], ["valid_from", "valid_to"])) == [("a", 1, 8)]
    m = spark.createDataFrame([("a", "z")], "old string, new string")
    assert rows(temporal.remap(df, m, "id", "old", "new"), "id") == [("b",), ("z",), ("z",)]
    assert rows(temporal.latest(df, ["id"], [F.col("valid_from")])) == [("a", 1, 3), ("b", 0, None)]


def test_text_functions(spark):
    c = F.col("t")
    df = spark.createDataFrame([("Retries must never exceed 3. RETRY again",), ("",), (None,), ("über x" * 9000,)], "t string")
    got = df.select(tx.term_frequency(c, ["retr"]).alias("n"), tx.distinct_terms(c, ["retr", "zz"]).alias("k"), tx.polarity(c).alias("p"), F.size(tx.tokens(c)).alias("s"), F.length(tx.snippet(c, 5)).alias("l")).collect()
    assert [tuple(r) for r in got] == [(2, 1, "must_not", 7, 6), (0, 0, None, 0, 0), (0, 0, None, 0, None), (0, 0, None, 3, 6)]
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(c)).first()[0]
    assert one("a  b\n c ", tx.normal) == "a b c"
    assert one("see ADR-7, rfc 12 and DR-0008, adr 0042; ADR--00012", tx.document_references) == ["0007", "0042", "0012"]
    for text, kind in [("Order state must never be mutated in place", "must_not"), ("Queries must use parameterized statements", "must"), ("Writes are prohibited on replicas", "must_not"), ("The service is event driven", None), ("Sharing tokens is forbidden", "must_not"), ("It should retry", None)]:
        assert one(text, tx.polarity) == kind
    assert one("PaymentServices_API", tx.entity_key) == "payment api" and one("billing-modules", tx.entity_key) == one("Billing", tx.entity_key) and one("Services", tx.entity_key) == "service"
    assert one("Merge pull request #42 from x/y", tx.merged_reference) == "42" and one("Fix it (#7)", tx.merged_reference) == "7"
    assert one("Fix (#7) early", tx.merged_reference) == "" and one("x\n\nSee merge request a/b!9", tx.merged_reference) == "9"
    assert one("git@host:own/name.git", tx.remote_owner) == "own/name" and one("https://u@host/own/name", tx.remote_owner) == "own/name"


def test_edit_classes_and_dispositions(spark):
    df = spark.createDataFrame([("a b", " a  b"), ("a b", "x a b y"), ("a b c d e", "a b c d z"), ("a", "b"), (None, "b")], "o string, n string")
    assert [r[0] for r in df.select(evidence.edit_class(F.col("o"), F.col("n"))).collect()] == ["unchanged", "shifted", "affected", "deleted", None]
    claims = spark.createDataFrame([("n",), ("f",), ("m",), ("l",)], "claim string")
    anchors = spark.createDataFrame([("f", False, True), ("m", True, True), ("m", False, True), ("l", True, False)], "claim string, stale boolean, relocated boolean")
    d = evidence.dispositions(claims, anchors, "claim")
    assert rows(d) == [("f", "unaffected"), ("l", "unprovable"), ("m", "affected"), ("n", "unprovable")]
    assert rows(evidence.manifest(d)) == [("affected", 1), ("unaffected", 1), ("unprovable", 2)]
    reads = spark.createDataFrame([("c", "code", "u", None), ("c", "code", "u", "p"), ("c", "code", "v", "p"), ("c", "adr", "u", None)], "claim string, kind string, uri string, subpath string")
    cover = spark.createDataFrame([("c", "code", "u", ""), ("c", "code", "v", "q")], "claim string, kind string, uri string, subpath string")
    assert rows(evidence.uncovered(reads, cover), "kind", "uri") == [("adr", "u"), ("code", "v")]


def test_rules(spark):
    data = [("d1", "g", "Every ledger entry must stay in partition order. Fine."), ("d2", "g", "A ledger entry must not stay in partition order."), ("d3", "h", "A ledger entry must not stay in partition order."), ("d4", "g", None)]
    found = rules.constraints(spark.createDataFrame(data, "id string, grp string, text string"), "id", "text", ["grp"])
    assert rows(found, "id", "n", "polarity") == [("d1", 0, "must"), ("d2", 0, "must_not"), ("d3", 0, "must_not")]
    assert rows(rules.contradictions(found, "grp", "id"), "a", "b") == [("d1#0", "d2#0")]
    files = spark.createDataFrame([("src/ledger/entry.rs",), ("src/other.rs",)], "file string")
    assert {r[0] for r in rows(rules.violations(files, found, "id"))} == {"src/ledger/entry.rs"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "a"), ("a", None), ("a", "b")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    near = graph.reachable(e, seed, 3)
    assert rows(near) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert graph.truncated(e, near, 3).first()[0] is True
    assert graph.truncated(e, graph.reachable(e, seed, 9), 9).first()[0] is False
    items = spark.createDataFrame([(g, i) for g in (1, 2) for i in ("x", "y")] + [(1, "x"), (3, "z"), (None, "x")], "g int, i string")
    assert rows(graph.cochange(items, "g", "i")) == [("x", "y", 2)]
    two = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    labels = dict(rows(graph.label_propagation(two, 10)))
    assert len({labels[n] for n in "abc"}) == 1 == len({labels[n] for n in "xyz"}) and labels["a"] != labels["x"]


def test_search_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.1]), (4, []), (5, None), (6, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = rows(retrieval.cosine_search(v, v.where("vec_id in (1, 5)"), "vec_id", "embedding", 0.5), "query", "hit")
    assert got == [(1, 3)]
    lists = {"x": spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank long"), "y": spark.createDataFrame([("b", 1)], "k string, rank long")}
    assert [r[0] for r in retrieval.fuse(lists, "k", 5).collect()] == ["b", "a"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, " a  b", 3), (3, "c", 1), (4, None, 1), (2, " a  b", 3)], "id int, t string, o int")
    assert rows(exact_groups(df, "id", "t", "o")) == [(1, 2, 2), (2, 2, 2)]
    pairs = spark.createDataFrame([(0, "a", "b", 0.9), (0, "b", "c", 0.95), (0, "c", "f", 0.92)], "group int, a string, b string, similarity double")
    members = spark.createDataFrame([(0, n, i, n == "f") for i, n in enumerate("abcf")], "group int, id string, seq int, fixed boolean")
    assert rows(greedy_survivors(pairs, members)) == [("b", "a"), ("c", "f")]


def test_multisets(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "key string")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "key string")
    assert rows(integrity.surplus(a, b, "key")) == [("x", 2, 1), ("z", 0, 1)]
    assert integrity.verdict(integrity.surplus(a, a, "key")).first()[0] == "clean"


def test_providers(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma " * 900), (1, "alpha beta")], "id int, t string")
    none, warning = backfill(df, "id", "t", None, None)
    assert none.isEmpty() and warning
    done, _ = backfill(df, "id", "t", None, hashing_embedder(8), chunk=100)
    assert [(i, len(v)) for i, v in rows(done)] == [(1, 8), (3, 8)]
    assert backfill(df, "id", "t", done, hashing_embedder(8))[0].isEmpty()
    assert chunks("", 3) == [""] and chunks("abcd", 3) == ["abc", "d"]


def test_literal_instant(spark):
    df = spark.createDataFrame([(datetime(2023, 6, 1), None)], "valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert temporal.as_of(df, temporal.instant("2023-06-01 00:00:00")).count() == 1


def test_cosines_of_mixed_lengths(spark):
    data = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [1.0, 0.0, 0.0]), ("d", []), ("e", None), ("f", [0.0, 0.0]), ("g", [1.0, 0.0, 0.1])]
    v = spark.createDataFrame(data, "k string, v array<float>")
    found = {(q, h): round(c, 3) for q, h, c in rows(retrieval.cosine_search(v, v.where("k IN ('a', 'c')"), "k", "v", -1.0))}
    assert len(found) == 12 and found["a", "b"] == 0.995 == found["c", "g"] and {found["a", x] for x in "cdefg"} == {0.0}
    assert {(q, h) for q, h, _ in rows(retrieval.cosine_search(v, v.where("k IN ('a', 'c')"), "k", "v", 0.5))} == {("a", "b"), ("c", "g")}
    top = retrieval.nearest(retrieval.cosine_search(v, v.where("k = 'a'"), "k", "v", -1.0, best=2), 2)
    assert rows(top, "hit", "rank") == [("b", 1), ("c", 2)]
