"""Cases in which a query once did less than its whole job."""

import os
import re
from collections import Counter, defaultdict

import pytest
from conftest import rows

from chronoweave.functions import text as tx
from chronoweave.operators import rules
from chronoweave.plans import knowledge, temporal
from chronoweave.plans.tools import Workspace
from chronoweave.sources.tables import table


def _pairs_by_hand(spark, data):
    """(a, b, shared) by comparing all constraints of a repository one by one."""
    def repos(name):
        return {r["id"]: r["repo_id"] for r in table(spark, data, name, "id", "repo_id").collect()}

    docs, episodes, found = repos("adr_document"), repos("episode"), defaultdict(set)
    for r in table(spark, data, "decision").collect():
        repo = docs.get(r["adr_id"]) or episodes.get(r["episode_id"])
        for n, s in enumerate(re.split(r"(?<=[.!?])[ \t\r\n]+", r["text"])):
            low = s.lower()
            no, must = (any(m in low for m in marks) for marks in (tx.PROHIBITION, tx.OBLIGATION))
            if repo and (no or must):
                words = {w for w in re.split(r"[\W_]+", low) if len(w.encode()) > 3} - set(tx.STOP)
                found[repo].add((r["source_uri"], f"{r['source_uri']}#{n}", no, frozenset(words)))
    out = set()
    for group in found.values():
        for u, a, no_a, x in group:
            for v, b, no_b, y in group:
                if u != v and not no_a and no_b and len(x & y) >= 2 and 2 * len(x & y) >= min(len(x), len(y)):
                    out.add((a, b, len(x & y)))
    return out


def test_contradictions_across_the_documents_of_a_repository(spark, data):
    data = os.path.join(os.path.dirname(data), "sf0.1")  # the smaller tables hold no contradiction
    if not os.path.isdir(data):
        pytest.skip("no larger test tables here")
    got = rows(knowledge.contradictions(spark, data), "a", "b", "shared")
    want = _pairs_by_hand(spark, data)
    assert want and got == sorted(want, key=repr)
    assert not Workspace(spark, data).check_consistency().isEmpty()


@pytest.mark.parametrize("seed", [1, 2])
def test_contradictions_of_random_sets(spark, seed):
    import random

    rng = random.Random(seed)
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "sigma", "theta", "omega"]
    data = []
    for i in range(120):
        own = rng.sample(words, rng.randint(1, 7))
        data.append((f"d{i}", rng.choice("gh"), f"It {rng.choice(['must', 'must not'])} {' '.join(own)}"))
    found = rules.constraints(spark.createDataFrame(data, "id string, grp string, text string"), "id", "text", ["grp"])
    want = []
    for a, g, s in data:
        for b, h, t in data:
            x, y = (set(v.split()) & set(words) for v in (s, t))
            if g == h and "not" not in s and "not" in t and len(x & y) >= 2 and 2 * len(x & y) >= min(len(x), len(y)):
                want.append((f"{a}#0", f"{b}#0", len(x & y)))
    assert rows(rules.contradictions(found, "grp", "id"), "a", "b", "shared") == sorted(want, key=repr)


def test_communities_run_twenty_rounds(spark, data):
    near = defaultdict(set)
    for r in table(spark, data, "symbol_edge", "from_id", "to_id", "edge_type").where("edge_type IN ('calls', 'imports') AND to_id IS NOT NULL AND from_id <> to_id").collect():
        near[r["from_id"]].add(r["to_id"])
        near[r["to_id"]].add(r["from_id"])
    labels = {n: n for n in near}
    for _ in range(20):
        labels = {n: min((-k, v) for v, k in Counter(labels[x] for x in near[n]).items())[1] for n in near}
    assert rows(knowledge.communities(spark, data), "node", "label") == sorted(labels.items(), key=repr)


def test_numbers_of_five_digits_stay_whole(spark, tmp_path):
    doc = spark.createDataFrame([(1, "r", "See ADR-10234, adr 7 and ADR-00012")], "doc_id long, repo_id string, text string")
    assert rows(doc.select(tx.document_references(doc["text"]))) == [(["10234", "0007", "0012"],)]
    doc.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("r", "ADR-10234"), ("r", "ADR-1023"), ("r", "ADR-0007")], "repo_id string, adr_id string").write.parquet(f"{tmp_path}/adr_document.parquet")
    assert rows(knowledge.explicit_links(spark, str(tmp_path)), "doc_id", "adr_id") == [(1, "ADR-0007"), (1, "ADR-10234")]
    log = spark.createDataFrame([("s", "Apply ADR-10234")], "sha string, message string")
    assert rows(Workspace(spark, str(tmp_path)).sync_commits(log), "sha", "number") == [("s", "10234")]


def test_lists_are_fused_whole(spark, data):
    docs = table(spark, data, "documents", "doc_id", "title", "text", "created_at", "n_chars").collect()
    score = {id(r): sum(f"{r['title'] or ''} {r['text'] or ''}".lower().count(w) for w in knowledge.WORDS) for r in docs}
    lists = {
        "keyword": sorted((r for r in docs if score[id(r)]), key=lambda r: (-score[id(r)], r["doc_id"])),
        "newest": sorted(sorted((r for r in docs if r["created_at"]), key=lambda r: r["doc_id"]), key=lambda r: r["created_at"], reverse=True),
        "longest": sorted((r for r in docs if r["n_chars"] is not None), key=lambda r: (-r["n_chars"], r["doc_id"])),
    }
    steps = [(name, r["doc_id"], n) for name, each in lists.items() for n, r in enumerate(each, 1)]
    assert len(steps) > 150 and rows(knowledge.explain_steps(spark, data), "step", "doc_id", "rank") == sorted(steps, key=repr)
    total = defaultdict(float)
    for _, doc, n in steps:
        total[doc] += 1 / (60 + n)
    want = sorted((-round(s, 9), doc) for doc, s in total.items())[:40]
    assert [(-r["score"], r["doc_id"]) for r in knowledge.rrf_fusion(spark, data).collect()] == want


def test_query_ranks_more_than_it_returns(spark, data):
    ws = Workspace(spark, data)
    found = ws._ranked("ledger record", "9999-12-31 23:59:59", 1, 0.0)
    assert all(df.count() > 5 for df in found.values())
    for df in found.values():
        assert sorted(r["rank"] for r in df.collect()) == list(range(1, df.count() + 1))


def test_a_wrong_increment_is_found(spark, data, monkeypatch):
    assert temporal.incremental_equals_full(spark, data).first()["verdict"] == "clean"
    monkeypatch.setattr(temporal, "upsert_latest", lambda state, batch, keys, recorded: state)
    assert temporal.incremental_equals_full(spark, data).first()["verdict"] == "divergent"
