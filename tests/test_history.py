import random

from conftest import rows

from chronoweave.operators.history import attribute_history
from chronoweave.operators.references import existence_deltas, orphans, references

KINDS = "id string, name string, kind string, valid_from int, valid_to int, ingested_at int, _from int"


def test_versions(spark):
    data = [
        ("a", "x", "k", 0, None, 1, 9), ("a", "x", "k", 0, None, 1, 9), ("a", "w", "k", 0, None, 0, 9),  # restated earlier
        ("a", "x", "m", 5, 8, 5, 9), ("a", "x", "m", 8, 10, 8, 9), ("a", "x", "m", 11, 12, 9, 9),  # gap at 10
        ("a", "y", "m", 12, 12, 9, 9),  # holds for no time
        ("b", None, "k", 3, None, 3, 9), ("b", None, "k", 4, None, 3, 9), ("b", "z", "k", 5, None, None, 9),
        (None, "q", "k", 1, 2, 1, 9), ("c", "q", "k", None, 2, 1, 9),
    ]
    df = spark.createDataFrame(data, KINDS)
    assert rows(attribute_history(df, "id", ["name"])) == [("a", "x", 0, 10), ("a", "x", 11, 12), ("b", "z", 5, None), ("b", None, 3, 5)]
    assert rows(attribute_history(df, "id", ["name", "kind"])) == [("a", "x", "k", 0, 5), ("a", "x", "m", 11, 12), ("a", "x", "m", 5, 10), ("b", "z", "k", 5, None), ("b", None, "k", 3, 5)]
    assert rows(attribute_history(df.limit(0), "id", ["name"])) == []


def test_sliced_like_unsliced(spark):
    rng = random.Random(5)
    data = [("hot", rng.choice("xyz"), rng.choice("km"), rng.randrange(400), rng.choice([None, rng.randrange(400)]), i, 0) for i in range(300)]
    df = spark.createDataFrame(data, KINDS)
    for attrs in (["name"], ["name", "kind"]):
        assert rows(attribute_history(df, "id", attrs)) == rows(attribute_history(df, "id", attrs, slice_rows=25))


def brute(refs, targets):
    out = set()
    for row, key, t in refs:
        if key is None or t is None:
            continue
        own = [(f, u) for k, f, u in targets if k == key and f is not None]
        if not any(f <= t and (u is None or t < u) for f, u in own):
            out.add((row, "missing" if not own else "late" if all(f > t for f, _ in own) else "deleted", t))
    return sorted(out)


def test_orphans_against_definition(spark):
    rng = random.Random(7)
    key = lambda: rng.choice(["a", "b", "c", "hot", "hot", "hot", None])
    refs = [(f"r{i}", key(), rng.choice([None, *range(20)])) for i in range(200)] * 2
    targets = [(rng.choice(["a", "b", "hot", None]), rng.choice([None, *range(20)]), rng.choice([None, *range(20)])) for _ in range(60)]
    r = spark.createDataFrame([(*x, "s") for x in refs], "id string, k string, t int, field string")
    e = spark.createDataFrame([(*x, "s") for x in targets], "k string, f int, u int, delta string")
    made = references(r, "x", "id", "k", "t"), existence_deltas(e, "x", "k", "f", "u")
    assert rows(orphans(*made), "row_id", "kind", "t") == brute(refs, targets)
    assert rows(orphans(*made, slice_rows=15), "row_id", "kind", "t") == brute(refs, targets)
    assert rows(orphans(made[0].limit(0), made[1])) == []
    assert {k for _, k, _ in rows(orphans(made[0], made[1].limit(0)), "row_id", "kind", "t")} == {"missing"}
