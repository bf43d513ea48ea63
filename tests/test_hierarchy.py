from conftest import rows
from pyspark.sql import functions as F

from chronoweave.operators.hierarchy import descendants, hierarchy, reference_number

KEYS = "child string, parent string"


def frames(spark, links, names="abcdefghij"):
    nodes = spark.createDataFrame([(n, n.upper(), 1, 2) for n in names], "node string, name string, parent int, depth int")
    return spark.createDataFrame(links, KEYS), nodes


def test_reference_forms(spark):
    forms = ["ADR-0006", "Adr0006", "ADR‑0006", " adr_6 ", "[ADR-0006](0007-x.md)", "./0006-y2.md", "docs/v2/0006-y.md", "#6", "000006", "none", "-", "", None, "0"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, f string").select("i", reference_number(F.col("f")))
    assert [x for _, x in rows(df)] != []
    assert dict(tuple(r) for r in df.collect()) == {**dict.fromkeys(range(9), "6"), 9: None, 10: None, 11: None, 12: None, 13: "0"}


def test_trees_cycles_and_ways_into_them(spark):
    # b and c under a, d under b; e <-> f with g leading in; h to itself; i alone
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "b"), ("e", "f"), ("f", "e"), ("g", "e"), ("h", "h"), ("i", None), (None, "i"), ("i", "zz"), ("yy", "i")]
    tree = hierarchy(*frames(spark, links))
    got = {r["node"]: (r["root_name"], r["depth"], r["path"]) for r in tree.collect()}
    assert got == {
        "a": ("A", 0, "A"), "b": ("A", 1, "A/B"), "c": ("A", 1, "A/C"), "d": ("A", 2, "A/B/D"),
        "e": ("E", -1, ""), "f": ("E", -1, ""), "g": ("E", -2, ""), "h": ("H", -1, ""),
    }
    assert rows(descendants(tree)) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d")]
    span = {r["node"]: (r["entry"], r["exit"], r["descendants"]) for r in tree.where("depth >= 0").collect()}
    assert span["a"] == (0, 7, 3) and span["b"][2] == 1
    inside = {(x, y) for x in span for y in span if span[x][0] < span[y][0] < span[x][1]}
    assert inside == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d")}


def test_long_chain_and_several_parents(spark):
    n = 150
    links = [(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("000", "150")]
    nodes = spark.createDataFrame([(f"{i:03d}", f"{i:03d}") for i in range(n + 1)], "node string, name string")
    got = {r["node"]: (r["depth"], r["path"].count("/")) for r in hierarchy(spark.createDataFrame(links, KEYS), nodes).collect()}
    assert got["000"] == (n, n) and got["150"] == (0, 0)


def test_empty(spark):
    assert rows(hierarchy(*frames(spark, []))) == []


def test_hot_parent_is_sliced(spark):
    links = [(f"{i:03d}", "root") for i in range(60)]
    nodes = spark.createDataFrame([(f"{i:03d}", f"{i:03d}") for i in range(60)] + [("root", "root")], "node string, name string")
    got = hierarchy(spark.createDataFrame(links, KEYS), nodes, slice_rows=10).collect()
    assert len(got) == 61 and {r["depth"] for r in got} == {0, 1}
    assert sorted(x for r in got for x in (r["entry"], r["exit"])) == list(range(122))


def test_hot_parent_of_text_keys_equals_the_unsliced_result(spark):
    links = [(f"repo|{i}", "repo|0") for i in range(1, 30)] + [(f"repo|{i + 30}", f"repo|{i}") for i in range(1, 25)] + [(f"repo|{i + 60}", f"repo|{i + 59}") for i in range(1, 20)]
    nodes = spark.createDataFrame([(f"repo|{i}", f"{i:03d}") for i in range(90)], "node string, name string")
    df = spark.createDataFrame(links, KEYS)
    columns = ["node", "root_name", "depth", "path", "descendants"]
    whole = hierarchy(df, nodes)
    assert rows(hierarchy(df, nodes, slice_rows=5), *columns) == rows(whole, *columns)
    assert rows(hierarchy(df, nodes, slice_rows=5), "node", "ancestors") == rows(whole, "node", "ancestors")
    assert whole.count() == 30 + 24 + 20
