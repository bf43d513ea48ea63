"""Items that were once lost: short sentences in another order, wording shared between items."""

import random

from chronoweave.llm.leakage import SEED, Automaton

A, B, C = "Blue kites rise above quiet fields today", "Grey boats drift along narrow canals slowly", "Red carts roll past empty markets daily"


def test_sentences_that_stay_side_by_side():
    assert Automaton([(1, f"{A}. {B}. {C}.")]).leaked(f"{C}. {A}. {B}.") == [1]
    assert Automaton([(1, f"{A}. {B}. {C}.")]).leaked(f"{A}. {B}.") == []


def test_sentences_too_short_for_a_seed():
    item = f"{A}. Nobody came. Old rivers keep names. {B}."
    assert Automaton([(1, item)]).leaked(f"Nobody came. {B} again. Old rivers keep names, so {A}.") == [1]
    assert Automaton([(1, item)]).leaked(f"Nobody stayed. {B} again. Old rivers keep names, so {A}.") == []
    edited = "One tall clerk sorts the purple stamps by harbour"
    assert Automaton([(1, f"{edited}. {A}.")]).leaked(f"{A}. {edited.replace('the', 'all')}.") == [1]


def test_items_of_few_words():
    assert Automaton([(1, f"{A}. Nobody came.")]).leaked(f"Nobody came. Then {A}.") == [1]
    assert Automaton([(1, "Nobody came.")]).leaked("Nobody came.") == []


def test_items_within_items():
    w = [f"w{i}" for i in range(40)]
    a = Automaton([(1, " ".join(w[:30])), (2, " ".join(w[4:24])), (3, " ".join(w[10:32]))])
    assert a.leaked(" ".join(w[:30])) == [1, 2, 3]


def test_each_item_has_its_own_longest_matches():
    rng = random.Random(3)
    for _ in range(30):
        seqs = [[rng.choice("abc") for _ in range(40)] for _ in range(3)]
        a = Automaton([(i, " ".join(s)) for i, s in enumerate(seqs)])
        doc = [rng.choice("abc") for _ in range(60)] + seqs[0][5:30]
        code = [a.words.get(x, -1) for x in doc]
        got = {(end, n, k, last) for end, n, v in a.seeds(code) for k, last in a.places(v) if not a._goes_on(code, end, n, k, last + 1)}
        want = set()
        for k, s in enumerate(seqs):
            for i in range(len(s)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(s) and d + n < len(doc) and s[i + n] == doc[d + n]:
                        n += 1
                    if n >= SEED and not (i and d and s[i - 1] == doc[d - 1]):
                        want.add((d + n, n, k, i + n - 1))
        assert got == want
