"""Reads and changes of the knowledge tables beyond what the registered queries compare with SQL."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronoweave.functions.parse import extract_json_array, hinted_end, labelled_lead
from chronoweave.operators import ingest, rules, verification
from chronoweave.operators.merging import last_survivors
from chronoweave.plans import changes, checks, fixtures
from chronoweave.plans.store import Store
from chronoweave.sources.schema import COLUMNS, schema

NOW = "2024-01-20 00:00:00"


@pytest.fixture(scope="module")
def store(spark):
    return fixtures.store(spark)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_every_table_has_a_schema_and_reads_back(spark, store, tmp_path):
    assert set(fixtures.ROWS) == set(COLUMNS)
    store.table("claims").write.parquet(f"{tmp_path}/claims")
    assert rows(Store.read(spark, str(tmp_path), ["claims"]).table("claims"), "id") == rows(store.table("claims"), "id")
    assert rows(Store(spark).decision_view()) == [] == rows(Store(spark).find_stale_decisions(NOW))
    assert rows(store.table_columns("commits"), "column", "key")[0] == ("author", False) and store.table_count("commits").first()[0] == 4
    with pytest.raises(ValueError):
        store.table_count("nothing")


def test_documents_and_decisions(spark, store):
    assert [rows(store.find_adr_by_adr_id_flex("r1", x), "id") for x in ("ADR-3", "3", "0003", "ADR-0003", "9", "x")] == [[("a3",)]] * 4 + [[], []]
    assert rows(store.find_adr_by_adr_id("r1", "adr-0003")) == [] and rows(store.find_adr_document_by_adr_id("r1", "ADR-0003"), "id") == [("a3",)]
    assert rows(store.find_current_adr("u1"), "id") == [("a1",)] and store.next_adr_number("r1").first()[0] == 7
    assert [r["id"] for r in store.find_decisions_by_ids(["d6", "d1", "zz", "d2"]).collect()] == ["d6", "d1"]
    assert [r["id"] for r in store.list_all_decisions("r1").collect()] == ["d1", "d3", "d6", "d7", "d4"]
    assert rows(store.find_decision_for_adr("a1"), "id") == [("d1",)] and rows(store.find_decision_with_embedding("d2")) == []
    assert rows(store.decision_ids_linked_under_path_segment("SRC\\queue")) == [("d5",)] and rows(store.file_mentions_for_decision("d2")) == [("src/cache.py",)]
    assert rows(store.find_constraint_facts_for_adr("a2"), "text") == [("Reads must use the cache",)] and rows(store.open_constraints_for_decision("d2")) == []
    assert rows(store.supersession_pairs_with_status("r1"), "superseder", "superseded") == [("ADR-0003", "ADR-0002"), ("ADR-0005", "ADR-0006"), ("ADR-0006", "ADR-0005")]
    assert rows(store.get_supersession_predecessors("a3")) == [("a2", 1)] and rows(store.get_supersession_successors("a2")) == [("a3", 1)]
    assert rows(store.find_constraints_for_decisions(ids(spark, "d2")), "id") == [("c3",)] and rows(store.find_constraints_for_decisions(ids(spark, "d2"), open_only=True)) == []


def test_symbols_and_git(spark, store):
    assert rows(store.find_symbol_ref_by_name("post"), "id") == [("s1",)] and rows(store.find_symbol_ref_by_name("nothing")) == []
    assert rows(store.fetch_symbol_edges(ids(spark, "s1"), "both"), "from_id", "to_id") == [("s1", "s3"), ("s3", "s1"), ("s4", "s1")]
    assert rows(store.symbol_has_edges(ids(spark, "s5", "s4"))) == [("s4",)] and store.has_symbol_edges()
    assert [tuple(r) for r in store.fetch_file_symbols_brief("src/ledger.py").select("name", "line").collect()] == [("Ledger", 5), ("post", 10)]
    assert rows(store.resolve_symbol_span("r1", "push")) == [] and rows(store.resolve_symbol_span("r1", "post")) == [("src/ledger.py", 10, 20)]
    assert rows(store.find_symbol_id_by_type_and_name()) == [("r1", "Queue", "size", "s7")] and rows(store.find_files_with_symbol("push")) == [("src/queue/api.ts",), ("src/queue/index.ts",)]
    assert rows(store.files_with_open_edges_to_names(spark.createDataFrame([("flush",), ("size",)], "n string"))) == [("f4", "src/queue/index.ts")]
    assert rows(store.fetch_unresolved_symbol_edges(), "id") == [("x4",)] and rows(store.find_routes_for_repo("r1"), "id") == [("q1",), ("q3",)]
    assert rows(store.find_commit_id_by_sha(spark.createDataFrame([("r2", "aaa")], "repo_id string, sha string")), "id") == [("k4",)]
    assert rows(store.table("pull_requests").select(store.pr_label(F.col("pr_ref")))) == [("#12",), ("x/3",)]
    assert rows(store.expand_callers(spark.createDataFrame([("src/ledger.py",)], "path string"))) == [("src/ledger.py",), ("src/queue/api.ts",)]
    assert rows(store.find_entity_nodes_by_name("r1", "QUEUE", "service"), "id") == [("n2",)] and rows(store.decision_ids_mentioning_entities(ids(spark, "n1"))) == [("d3",)]
    assert store.cached_freshness_manifest("r1", "query", "v", "aaa").first()[0] == "{2}" and store.count_open_temporal_edges_of_type("imposes").first()[0] == 3
    assert rows(store.latest_verification("bbb"), "anchor_id", "edit_class") == [("w1", "unchanged"), ("w2", "affected"), ("w3", "affected")]
    assert rows(store.diff_decisions_in_range("2024-01-09 00:00:00", "2024-01-10 00:00:00")) == [("d2", "removed"), ("d3", "added")]


def test_vectors_and_search(spark, store):
    s = store.update_embeddings("decisions", spark.createDataFrame([("d4", [0.0, 1.0])], "id string, embedding array<float>"))
    assert ("d4",) not in rows(s.without_embeddings("decisions"), "id") and ("d4",) in rows(store.without_embeddings("decisions"), "id")
    assert store.semantic_decisions_if_available(None, "r1") is None
    assert [r["id"] for r in store.semantic_decisions_if_available([1.0, 0.0], "r1").orderBy("rank").collect()] == ["d1", "d6", "d3"]
    new = spark.createDataFrame([("n1", " Warm  the cache first", None), ("n2", "else", [0.59, 0.81]), ("n3", "else", [-1.0, 0.0])], "key string, text string, embedding array<float>")
    assert [(k, i) for k, i, _ in rows(checks.nearest_decision(store, "r1", new))] == [("n1", "d4"), ("n2", "d3")]
    assert {r["kind"] for r in checks.propose_links(store, "r1", ["ledger", "push"]).collect()} == {"decision", "commit", "symbol", "route"}
    assert [tuple(r)[1:] for r in checks.timeline(store, "post", "2024-01-01 00:00:00", "2024-01-28 00:00:00").collect()][:2] == [("constraint", "c1"), ("decision", "d1")]


def test_changes(spark, store):
    with pytest.raises(ValueError):
        changes.insert_decision(store, spark.createDataFrame([("x", "a1", "e1")], "id string, adr_id string, episode_id string"))
    s = changes.update_pull_request_enrichment(store, spark.createDataFrame([("p1", None, "B", "me", "merged")], "id string, title string, body string, author string, state string"))
    assert rows(s.table("pull_requests"), "id", "title", "body", "state", "enriched") == [("p1", "Ledger order", "B", "merged", True), ("p2", None, "Text", "open", True)]
    s = changes.retract_episode_facts(store, ids(spark, "e1"), NOW)
    assert rows(changes.closed(store, s, ["decisions", "constraints"])) == [("constraints", 1), ("decisions", 1)]
    again = changes.retract_episode_facts(s, ids(spark, "e1"), NOW)
    assert {n for _, n in rows(changes.closed(s, again, ["decisions", "constraints", "claims"]))} == {0}
    s = changes.insert_retraction_episode(store, "d4", "wrong", NOW)
    assert s.table("episodes").where("source = 'retraction' AND repo_id IS NULL").count() == 1
    s = changes.upsert_file(changes.retire_files_where(store, spark.createDataFrame([("r1", "src/ledger.py")], "repo_id string, path string"), NOW), spark.createDataFrame([("r1", "src/ledger.py")], "repo_id string, path string"), "2024-01-21 00:00:00")
    back = s.table("files").where("id = 'f1'").first()
    assert back["valid_to"] is None and str(back["valid_from"]) == "2024-01-21 00:00:00" and back["content_hash"] is None
    assert rows(s.open("file_imports").where("id = 'i1'"), "target_file_id", "target_symbol_id") == [(None, None)]
    s = changes.backdate_symbol_valid_from(store, "f1", "post", "2023-01-01 00:00:00")
    assert str(s.table("symbols").where("id = 's1'").first()["valid_from"]) == "2023-01-01 00:00:00"
    s = changes.close_stale_symbols_for_file(store, spark.createDataFrame([("f1", "post", "function")], "file_id string, name string, kind string"), ids(spark, "f1"), NOW)
    assert rows(s.open("symbols").where("file_id = 'f1'"), "id") == [("s1",)]
    s = changes.upsert_repository(store, spark.createDataFrame([("\\\\?\\/a", "again"), ("/c", "three")], "path string, name string"))
    assert rows(s.table("repositories"), "path") == [("/a",), ("/b",), ("/c",)]
    assert rows(store.tables["repositories"], "path") == [("/a",), ("/b",)]


def test_chains_of_merges(spark):
    m = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a"), ("a", "b")] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(70)]
    got = dict(rows(last_survivors(spark.createDataFrame(m, "loser_id string, survivor_id string"))))
    assert {k: got[k] for k in "abc"} == dict.fromkeys("abc", "d") and not set("xyzs") & set(got)
    assert all(got[f"{i:03d}"] == "070" for i in range(70))


def test_paths_and_edges(spark):
    one = lambda f, *v: spark.createDataFrame([v], [f"c{i}" for i in range(len(v))]).select(f(*[F.col(f"c{i}") for i in range(len(v))])).first()[0]
    assert [one(ingest.folded_path, p) for p in ("a/b/../c", "./a//b", "../x", "a\\b", "")] == ["a/c", "a/b", "x", "a/b", ""]
    assert [one(ingest.escapes_root, p) for p in ("a/../b", "../a", "a/../../b/c", "/a", "a/b")] == [False, True, True, True, False]
    assert one(ingest.module_candidates, "src/q/a.ts", "../b")[:3] == ["src/b", "src/b.ts", "src/b.tsx"] and one(ingest.module_candidates, "src/a.ts", "pkg/m")[0] == "pkg/m"
    edges = spark.createDataFrame([("1", "r", "f", "main", "run", "calls", "job", None)], "edge_id string, repo_id string, file_id string, from_name string, to_name string, edge_type string, recv string, spec string")
    symbols = spark.createDataFrame([("t", "r", "g", "Job"), ("m", "r", "g", "run"), ("o", "r", "h", "run")], "id string, repo_id string, file_id string, name string")
    files = spark.createDataFrame([("f", "r", "a.py")], "file_id string, repo_id string, path string")
    held, bound = spark.createDataFrame([("t", "m")], "from_id string, to_id string"), spark.createDataFrame([("f", "main", "job", "Job")], "file_id string, owner string, name string, type string")
    assert rows(ingest.resolve_edges(edges, symbols, files, contains=held, bindings=bound)) == [("1", "m", 0.9, "receiver-type")]
    assert rows(ingest.resolve_edges(edges, symbols, files)) == [("1", None, 0.3, "unresolved")]


def test_spans_nest_alike_with_and_without_cells(spark, monkeypatch):
    rng = random.Random(4)
    data = [("f", f"s{i}", a, a + rng.choice([0, 3, 300, 900])) for i in range(60) for a in [rng.randrange(1, 2000)]]
    df = spark.createDataFrame(data, "file_id string, id string, line int, end_line int")
    want = sorted(("f", o, i) for _, o, a, z in data for _, i, b, y in data if a < b and z >= y)
    assert rows(ingest.nested_spans(df)) == want
    monkeypatch.setattr(ingest, "SLICE_ROWS", 5)
    assert rows(ingest.nested_spans(df)) == want


def test_spans_of_passages():
    def slow(text, needle):
        lines = text.splitlines()
        for a in range(len(lines)):
            acc = ""
            for n, line in enumerate(lines[a : a + 80]):
                acc += (" " if acc else "") + " ".join(line.split())
                if needle and needle in acc:
                    return a + 1, a + n + 1
                if len(acc) > len(needle) + 512:
                    break
        return None

    rng = random.Random(1)
    for _ in range(200):
        text = "\n".join(" ".join(rng.choice("ab cd".split()) * rng.randrange(1, 30) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 30)))
        flat = " ".join(text.split())
        i = rng.randrange(len(flat))
        needle = " ".join(flat[i : i + rng.randrange(1, 80)].split())
        assert verification.find_span(text, needle) == slow(text, needle)
    assert verification.find_span("a\nb", "") is None and verification.find_span("", "x") is None


def test_written_answers(spark):
    assert extract_json_array('Sure:\n```json\n[{"a": 1}]\n```') == [{"a": 1}] == extract_json_array('{"leads": [{"a": 1}]}') == extract_json_array('text [{"a": 1}] more')
    assert extract_json_array('{"choices": [{"message": {"content": "[1, 2]"}}]}') == [1, 2] and extract_json_array("none") == [] == extract_json_array(None) and extract_json_array('{"x": 1}') == [{"x": 1}]
    lead = labelled_lead("**TITLE: One\nPATTERN: p\nmore\nFILES: - a.py, b.py\nCONFIDENCE: 0.5\nTITLE: Two")
    assert lead == {"title": "Two", "observed_pattern": "p\nmore", "rationale": None, "affected_files": ["a.py", "b.py"], "confidence": 0.5}
    assert labelled_lead(None)["title"] is None and labelled_lead("CONFIDENCE: high")["confidence"] is None
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t, x FROM VALUES ('This Sprint '), ('later'), (NULL) AS v(x)")
    assert [str(r[0]) for r in df.select(hinted_end(F.col("x"), F.col("t"))).collect()] == ["2024-01-15 00:00:00", "None", "None"]


def test_changes_against_rules(spark, store):
    found = spark.createDataFrame([("c1", "The ledger must balance"), ("c2", "Cats sleep"), ("c3", None)], "id string, text string")
    files = spark.createDataFrame([("src/subledgers/x.py",), ("led/ger.py",)], "file string")
    assert rows(rules.touched(files, found, "id", "text")) == [("c1", ["src/subledgers/x.py"], False)]
    assert rows(rules.touched(files.limit(0), found, "id", "text", "dreaming dogs, ledgers")) == [("c1", [], True)]
    got = checks.inspect_change(store, "r1", spark.createDataFrame([("src/cache.py",)], "path string"), "order of the partition")
    assert {(r["constraint_id"], r["tier"]) for r in got.collect()} >= {("c1", "medium")}
    label = verification.context_hash(F.lit("a\nb\nc"), F.lit(2), F.lit(2))
    assert spark.range(1).select(label == F.sha2(F.lit("a b c"), 256)).first()[0]
