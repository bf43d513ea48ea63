import os

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from chronoweave.sources.code import extract, extract_files, ignored
from chronoweave.sources.markdown import parse_record, read_records
from chronoweave.streaming.incremental import PartedState, VersionedState, file_stream, run_into, run_into_parts, sliding_counts, upsert_latest, windowed_counts, without_repeats

RECORD = """# ADR-0012: Keep the ledger
Date: 2021-03-04

## Status
Accepted
Supersedes ADR-0003 and RFC 7

## Context
See `src/app/main.rs`.
```
# not a heading
```
## Decision
- Writers must never skip the journal.
- Short.

## Consequences
Every reader should check `lib/x.py` first.
"""


def test_record():
    r = parse_record("docs/0012-ledger.md", RECORD)
    assert (r["adr_id"], r["title"], r["status"], r["date"]) == ("ADR-0012", "Keep the ledger", "Accepted", "2021-03-04")
    assert r["supersedes"] == ["ADR-0003", "RFC-7"] and r["mentions"] == ["lib/x.py", "src/app/main.rs"]
    assert r["constraints"] == ["Writers must never skip the journal."] and r["errors"] == []
    bare = parse_record("docs/0044-x.md", None)
    assert bare["adr_id"] == "ADR-0044" and bare["errors"] == ["no title", "no status", "no decision"]


def test_reader(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "0012-a.md").write_text(RECORD)
    (tmp_path / "docs" / "0013-b.md").write_text("\n")
    (tmp_path / "docs" / "x.txt").write_text(RECORD)
    assert rows(read_records(spark, str(tmp_path)), "adr_id", "title") == [("ADR-0012", "Keep the ledger"), ("ADR-0013", None)]


def test_code(spark):
    py = "import os\nfrom a.b import c as d\n\nclass A(B):\n    def f(self):\n        return g(1)\n\n@app.get('/x')\ndef g(n):\n    pass\n"
    got = {(r[1], r[2], r[3], r[6], r[7]) for r in extract("x/m.py", py)}
    assert {("symbol", "A", "class", None, None), ("edge", None, "contains", "A", "f"), ("edge", None, "inherits", "A", "B"), ("edge", None, "calls", "f", "g"), ("import", "d", "imports", "__module__", "a.b:c"), ("route", "/x", "get", None, None)} <= got
    rs = extract("m.rs", "pub fn one() {\n  two();\n}\n\nfn two() {}\npub struct S;\n")
    assert [(r[1], r[2], r[3]) for r in rs] == [("symbol", "one", "function"), ("edge", None, "calls"), ("symbol", "two", "function"), ("symbol", "S", "struct")]
    assert extract("m.py", "def broken(:") == [] and extract("m.bin", "x") == [] and extract("m.py", None) == []
    assert extract("a.ts", "app.post('/v1/items', h)\nexport const go = async () => 1\n")[0][2:4] == ("go", "constant")
    assert ignored("a/node_modules/x.js") and not ignored("a/b.js")
    df = spark.createDataFrame([("m.rs", "fn one() {}"), ("target/m.rs", "fn two() {}"), ("n.rs", None)], "path string, text string")
    assert rows(extract_files(df), "name") == [("one",)]


SCHEMA = StructType([StructField("id", StringType()), StructField("v", IntegerType()), StructField("at", IntegerType())])


def test_stream_equals_batch(spark, tmp_path):
    """Incremental state over files in any order equals one batch over all rows, and re-running adds nothing."""
    parts = [[("a", 1, 1), ("b", 1, 5)], [("a", 2, 0), ("b", 2, 6)], [("a", 3, 9), ("c", 1, 1), ("c", 1, 1)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = VersionedState(spark, str(tmp_path / "state"), SCHEMA)
        q = run_into(file_stream(spark, str(tmp_path / "in"), SCHEMA, 1), state, lambda s, b: upsert_latest(s, b, ["id"], ["at", "v"]), str(tmp_path / "cp"))
        q.awaitTermination(120)
    full = upsert_latest(spark.createDataFrame([], SCHEMA), spark.createDataFrame(sum(parts, []), SCHEMA), ["id"], ["at", "v"])
    assert rows(state.read()) == rows(full) == [("a", 3, 9), ("b", 2, 6), ("c", 1, 1)]
    before = state.version()
    run_into(file_stream(spark, str(tmp_path / "in"), SCHEMA, 1), state, lambda s, b: upsert_latest(s, b, ["id"], ["at", "v"]), str(tmp_path / "cp")).awaitTermination(120)
    assert state.version() == before
    assert len([n for n in os.listdir(tmp_path / "state") if not n.endswith((".done", ".crc"))]) <= 2


def test_windows_and_repeats(spark, tmp_path):
    data = [("2024-01-01 00:00:10", "x"), ("2024-01-01 00:00:10", "x"), ("2024-01-01 00:03:00", "y"), ("2024-01-01 02:00:00", "z")]
    df = spark.createDataFrame(data, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    df.write.parquet(str(tmp_path / "in"))
    s = without_repeats(file_stream(spark, str(tmp_path / "in"), df.schema), ["t", "k"], "t", "10 minutes")
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 3
    w = windowed_counts(file_stream(spark, str(tmp_path / "in"), df.schema), "t", "5 minutes", ["k"], "10 minutes")
    q = w.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["k"], r["n"]) for r in spark.table("counts").collect()} == {("x", 2), ("y", 1)}


def test_parts_are_rewritten_only_where_touched(spark, tmp_path):
    parts = [[(f"k{i}", i, 1) for i in range(20)], [("k3", 99, 9), ("new", 1, 1)], [("k3", 5, 2)]]
    change = lambda s, b: upsert_latest(s, b, ["id"], ["at", "v"])
    state = PartedState(spark, str(tmp_path / "state"), SCHEMA, ["id"], parts=8)
    assert rows(state.read()) == [] and state.manifest() == (-1, {})
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_into_parts(file_stream(spark, str(tmp_path / "in"), SCHEMA, 1), state, change, str(tmp_path / "cp")).awaitTermination(120)
    full = upsert_latest(spark.createDataFrame([], SCHEMA), spark.createDataFrame(sum(parts, []), SCHEMA), ["id"], ["at", "v"])
    assert rows(state.read()) == rows(full) and len(rows(full)) == 21
    version, held = state.manifest()
    assert version == 2 and 0 in held.values() and len(held) <= 8
    state.apply(spark.createDataFrame([("k1", 7, 70)], SCHEMA), 2, change)  # a batch that comes again
    assert rows(state.read()) == rows(full)


def test_sliding_windows(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:07:00", "x"), ("2024-01-01 00:12:00", "x"), ("2024-01-01 03:00:00", "z")], "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k")
    df.write.parquet(str(tmp_path / "in"))
    s = sliding_counts(file_stream(spark, str(tmp_path / "in"), df.schema), "t", "10 minutes", "5 minutes", ["k"], "10 minutes")
    s.writeStream.format("memory").queryName("slides").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {(str(r["start"])[11:16], r["n"]) for r in spark.table("slides").collect()} == {("00:00", 1), ("00:05", 2), ("00:10", 1)}
