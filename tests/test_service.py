"""Ingestion runs: what an incremental run leaves equals what a run from scratch gives."""

from conftest import rows
from pyspark.sql import functions as F

from chronoweave.plans import service
from chronoweave.plans.store import Store

T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
V1 = {
    "app/ledger.py": "from .store import save\n\nclass Ledger:\n    def post(self):\n        save(1)\n        check()\n\ndef check():\n    pass\n",
    "app/store.py": "def save(x):\n    return x\n",
    "app/old.py": "def gone():\n    pass\n\ndef caller():\n    gone()\n",
    "app/web.js": "app.get('/ledger', show)\nfunction show() {\n}\n",
}
V2 = {
    "app/ledger.py": "from .store import save\n\nclass Ledger:\n    def post(self):\n        save(1)\n        flush()\n        gone()\n",
    "app/store.py": "def save(x):\n    return x\n\ndef flush():\n    pass\n",
    "app/web.js": "app.get('/ledgers', show)\nfunction show() {\n}\n",
}
A1 = "# ADR-0001: Keep the ledger\n\n## Status\n\nAccepted\n\n## Decision\n\nWriters must never skip the ledger journal.\nSee `app/ledger.py`.\n"
A2 = "# ADR-0002: Split the ledger\n\n## Status\n\nAccepted\nSupersedes ADR-0001\n\n## Decision\n\nWriters shall use two journals always.\n"


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def repo(spark):
    return Store(spark, {"repositories": spark.sql("SELECT 'r' AS id, '/r' AS path, 'r' AS name, timestamp_ntz'2024-01-01' AS ingested_at")})


def test_symbols_incremental_and_rebuilt(spark):
    first = service.ingest_symbols(repo(spark), "r", frame(spark, V1), T1)
    assert rows(first.open("symbol_edges").where("edge_type = 'calls'"), "to_name", "resolution") == [("check", "same-file"), ("gone", "same-file"), ("save", "import")]
    assert rows(first.open("symbol_edges").where("edge_type = 'contains'"), "to_name") == [("post",)]
    second = service.ingest_symbols(first, "r", frame(spark, V2), T2)
    fresh = service.ingest_symbols(repo(spark), "r", frame(spark, V2), T2)
    assert rows(service.verify_index(second, fresh, "r"), "lane", "verdict") == [("documents", "clean"), ("symbols", "clean")]
    assert rows(second.open("symbol_edges").where("edge_type = 'calls'"), "to_name", "resolution") == [("flush", "unique-name"), ("gone", "unresolved"), ("save", "import")]
    assert rows(second.open("files"), "path") == [("app/ledger.py",), ("app/store.py",), ("app/web.js",)]
    assert rows(second.open("routes"), "path") == [("/ledgers",)]
    again = service.ingest_symbols(second, "r", frame(spark, V2), "2024-03-01 00:00:00")
    assert again.table("symbols").count() == second.table("symbols").count() and again.table("symbol_edges").count() == second.table("symbol_edges").count()
    broken = second.with_tables(symbols=second.table("symbols").where("name <> 'flush'"))
    assert ("symbols", "divergent") in rows(service.verify_index(broken, fresh, "r"), "lane", "verdict")
    found = service.detect_communities(second, "r", T2)
    assert found.get_communities_for_repo("r").agg(F.sum(F.size("symbols"))).first()[0] >= 4


def test_documents_commits_and_episodes(spark):
    s = service.sync_documents(repo(spark), "r", frame(spark, {"docs/1.md": A1}), T1)
    assert rows(s.open("claims"), "kind", "polarity") == [("constraint", "must_not"), ("decision", "must_not")]
    assert rows(s.find_decisions_for_file("app/ledger.py", T2), "title") == [("Keep the ledger",)]
    same = service.sync_documents(s, "r", frame(spark, {"docs/1.md": A1}), T2)
    assert same.table("adr_documents").count() == 1 and same.table("decisions").count() == 1
    s = service.sync_documents(s, "r", frame(spark, {"docs/1.md": A1.replace("Accepted", "Superseded"), "docs/2.md": A2}), T2)
    assert rows(s.table("adr_documents").groupBy("adr_id").count()) == [("ADR-0001", 2), ("ADR-0002", 1)]
    assert rows(s.supersession_pairs_with_status("r"), "superseder", "superseded", "status") == [("ADR-0002", "ADR-0001", "Accepted"), ("ADR-0002", "ADR-0001", "Superseded")]
    assert s.open("decisions").count() == 2 and s.open("constraints").count() == 2
    log = spark.sql("SELECT * FROM VALUES ('a', 'x', 'Apply ADR-2 (#7)', timestamp_ntz'2024-02-02', array('app/ledger.py')), ('b', 'x', 'Keep ledger tidy, Keep calm', timestamp_ntz'2024-02-03', array('app/ledger.py', 'app/store.py')), ('c', NULL, NULL, NULL, NULL) AS v(sha, author, message, source_time, files)")
    s = service.sync_requests(service.sync_commits(s, "r", log, T2), "r", log, T2)
    twice = service.sync_commits(s, "r", log, T2)
    assert s.table("commits").count() == 3 == twice.table("commits").count() and s.table("commit_files").count() == 3 == twice.table("commit_files").count()
    assert rows(s.table("decision_git_links"), "confidence") == [(0.6,), (0.95,)] and rows(s.table("pull_requests"), "pr_ref") == [("7",)]
    ep = spark.sql("SELECT 'e1' AS id, 'chat' AS source, 'x' AS content, timestamp_ntz'2024-02-05' AS occurred_at")
    facts = spark.createDataFrame([("e1", "t", "Writers shall use  two journals always.", None, None, 0.7), ("e1", "u", "Freeze it", "this sprint", None, 0.7)], "episode_id string, title string, text string, hint string, embedding array<float>, confidence double")
    s = service.record_episode(s, "r", ep, facts, T2)
    assert rows(s.table("decisions").where("episode_id = 'e1'"), "text") == [("Freeze it",)]
    assert str(s.table("decisions").where("episode_id = 'e1'").first()["valid_to"]) == "2024-02-19 00:00:00"
    assert rows(s.table("temporal_edges").where("edge_type = 'supports'"), "source_id") == [("e1",)]
