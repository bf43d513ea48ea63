"""Cutting evaluation wording out of texts, and items of short or edited sentences in another order."""

import random

from conftest import rows

from chronoweave.llm.leakage import SEED, Automaton, exact_run, leaks, removal, spans, without_leaks


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def test_sentences_without_a_sure_seed():
    five = [" ".join(words(n, i)) for i, n in enumerate((11, 5, 11, 4, 10))]
    auto = Automaton([(7, ". ".join(five) + ".")])
    assert max(exact_run(len(s.split())) for s in five) < SEED and auto.weak
    assert auto.leaked(". ".join(five[i] for i in (3, 0, 4, 2, 1))) == [7]
    edited = [s.split() for s in five]
    for s in (edited[0], edited[2], edited[4]):
        s[5] = "changed"
    assert auto.leaked(". ".join(" ".join(edited[i]) for i in (3, 0, 4, 2, 1))) == [7]
    assert auto.leaked(". ".join(" ".join(edited[i]) for i in (3, 0, 4, 2))) == []


def test_hashes_pass_over_no_leak(spark):
    item = words(60, 1)
    texts = [" ".join(words(30, 2) + item[10:30] + words(30, 3)), " ".join(words(80, 4)), "", " ".join(item[:SEED]), " ".join(words(5, 5) + item[40:49] + ["odd"] + item[50:60])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    auto = Automaton([(1, " ".join(item))])
    assert rows(leaks(docs, items)) == [(n, k) for n, t in enumerate(texts) for k in auto.leaked(t)] == [(0, 1), (4, 1)]


def test_spans_are_cut_where_they_stand(spark):
    item = words(40, 6)
    own, more = " ".join(words(50, 7)), " ".join(words(9, 8))
    docs = [(1, f"{own}. <b>{' '.join(item[:20]).upper()}</b>! {more}"), (2, own), (3, " ".join(item)), (4, None), (5, ""), (6, f"{own} {' '.join(item[:15])}"), (7, f"{' '.join(item[:16])} x {' '.join(item[20:36])} {own} {own}")]
    got = {r["doc_id"]: tuple(r)[1:] for r in without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got[1] == (f"{own}. <b></b>! {more}", 20, False)
    assert got[2] == (own, 0, False) and got[4] == (None, 0, False) and got[5] == ("", 0, False)
    assert got[3] == (None, 40, True) and got[6] == (docs[5][1], 0, False)
    assert got[7][1:] == (32, False) and got[7][0].split() == ["x", *own.split(), *own.split()]


def test_words_of_spans_are_those_of_the_plain_text():
    from chronoweave.llm.leakage import _WORD, plain

    for t in ("A_b Über-42 &amp; café <i class='x'>so</i> [x](http://y/z) ​q", "", "ﬁne ①"):
        assert [w for w, _, _ in spans(t)] == _WORD.findall(plain(t))
        assert all(0 <= a < b <= len(t) for _, a, b in spans(t))
    assert removal(16, 0.5)(Automaton([]), "any text") == ("any text", 0)


def test_counts_leave_out_no_passage():
    rng = random.Random(11)
    items = [words(rng.randrange(20, 70), 100 + i) for i in range(12)]
    texts = [" ".join(w if rng.random() > 0.1 else w + "." for w in ws) for ws in items]
    auto = Automaton(list(enumerate(texts)))
    docs = []
    for n in range(250):
        own = list(auto.sequences[rng.randrange(12)])
        a = rng.randrange(len(own))
        part = own[a : a + rng.randrange(10, 36)]
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(part) + 1)
            part[i : i + rng.randrange(2)] = [-1] * rng.randrange(2)
        docs.append([-1] * rng.randrange(30) + part + [-1] + rng.choice(auto.sequences)[:9])
    names = {i: w for w, i in auto.words.items()}
    written = [" ".join(names.get(w, "zz") for w in d) for d in docs]
    narrowed = {n: auto.leaked_words(d, may) for n, d, may in auto.batch(written)}
    want = [auto.leaked(t) for t in written]
    assert [narrowed.get(n, []) for n in range(len(docs))] == want and sum(map(bool, want)) > 60
