import pytest
from conftest import rows

from chronoweave.plans.tools import Workspace
from chronoweave.sources.providers import hashing_embedder


@pytest.fixture(scope="module")
def ws(spark, data):
    return Workspace(spark, data)


def test_retrieval_tools(ws):
    found = ws.query("ledger balance and refund", top_k=7).collect()
    assert 0 < len(found) <= 7 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    assert {r["step"] for r in ws.explain_answer("ledger balance").collect()} <= {"keyword", "graph"}
    assert all(0 < r["score"] <= 1 for r in ws.propose_links("ledger index").collect())
    with pytest.raises(ValueError):
        ws.query("a b")


def test_code_tools(ws):
    edge = ws._edges().orderBy("src", "dst").first()
    name = ws.table("symbol_span").where(f"id = '{edge['src']}'").first()
    assert ws.impact_of(edge["dst"], 1).where(f"node = '{edge['src']}'").count() == 1
    assert ws.focused_file_brief(name["file_path"]).columns == ["section", "name", "kind", "file_path", "confidence"]
    assert ws.trace_symbol_history(name["id"], "2000-01-01 00:00:00", "2100-01-01 00:00:00").count() >= 1
    assert ws.get_graph_snapshot(name["name"], 1).count() <= ws.get_graph_snapshot().count()
    assert ws.trace_call_path(name["name"], "both", 1, 0.0).count() >= 0
    assert ws.find_orphaned_code("pkg/").columns[0] == "id"
    live = ws.find_orphaned_code().first()["name"]
    named = ws.spark.createDataFrame([(live,), (None,)], "symbol string")
    assert ws.find_orphaned_code("", named).where(f"name = '{live}'").isEmpty() and not ws.find_orphaned_code("", named).isEmpty()
    assert ws.find_decisions_for_code("docs/adr").count() > 0


def test_rule_and_document_tools(ws, spark):
    assert {r[0] for r in ws.verify_claims().select("disposition").distinct().collect()} <= {"unprovable", "unaffected", "affected"}
    lost = ws.verify_claims(reachable=spark.createDataFrame([], "sha string"))
    assert {"unprovable", "unaffected"} == {r[0] for r in lost.select("disposition").distinct().collect()} and lost.where("stale > 0").count() > 0 == ws.verify_claims().where("stale > 0").count()
    assert ws.find_stale_decisions("2025-01-01 00:00:00", 0.7).where("confidence < 0.7").isEmpty()
    live = ws.table("adr_document", "repo_id", "adr_id", "title", "valid_to").where("valid_to IS NULL")
    assert ws.verify_index_integrity(live).first()["verdict"] == "clean"
    assert ws.verify_index_integrity(live.limit(3)).first()["verdict"] == "divergent"
    top = ws.hierarchies().where("depth = 1").first()
    repo, number = top["node"].split("|")
    kin = rows(ws.adr_lineage(repo, number), "number", "side", "hops")
    assert (top["ancestors"][0].split("|")[1], "successor", 1) in kin
    assert ws.validate_adr("x.md", "nothing") and "ADR-" in ws.generate_adr_draft(repo, "t", "c")
    assert ws.generate_adr_patch("x", "a\n", "b\n").startswith("--- a/x")
    assert ws.inspect_change(["src/ledger.rs"]).columns == ["file", "id", "matched"]


def test_administration_and_ingestion(ws, spark, tmp_path):
    repo = ws.list_repos().first()["id"]
    assert all(df.where(f"repo_id = '{repo}'").isEmpty() for df in ws.delete_repo(repo).values())
    assert ws.get_graph_schema().where("table = 'decision'").count() == 10
    assert ws.index_status().count() == 9
    d = ws.table("decision").where("episode_id IS NOT NULL AND valid_to IS NULL").first()
    assert ws.retract(d["episode_id"], "2030-01-01 00:00:00").where(f"id = '{d['id']}' AND valid_to IS NULL").isEmpty()
    assert ws.record_decision_episode(ws.table("decision").where(f"id = '{d['id']}'")).count() == ws.table("decision").count()
    log = spark.createDataFrame([("s1", "Apply ADR-12 (#4)"), ("s2", "none"), ("s3", None)], "sha string, message string")
    assert rows(ws.sync_commits(log)) == [("s1", "0012", 0.95)] and rows(ws.sync_prs(log)) == [("s1", "4")]
    (tmp_path / "m.rs").write_text("fn one() {}\n")
    assert rows(ws.ingest_symbols(str(tmp_path)), "name") == [("one",)]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    known = ws.sync_incremental(files, spark.createDataFrame([], "path string, hash string"))
    assert ws.sync_incremental(files, known).isEmpty() and known.count() == 2
    vectors, warning = ws.embed_all(hashing_embedder(4))
    assert warning is None and vectors.count() > 0
